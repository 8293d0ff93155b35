"""SGD updates, as columns for single steps and as numpy functions for the kernel.

A kernel update takes arrays of one row per rating, of which no two share a user
or an item, and returns both sides' new vectors from the old ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import axpy, dot


class Updater(Protocol):
    def next_factors(self, r, u, v, omega_u, omega_v): ...

    def delta(self, r, u, v): ...


@dataclass(frozen=True)
class SGD:
    """Plain SGD: e = r - u.v, u + eta e v, v + eta e u."""

    eta: float

    def delta(self, r, u, v):
        e = self.eta * (r - (u * v).sum(-1))[..., None]
        return e * v, e * u

    def next_factors(self, r, u, v, omega_u=None, omega_v=None):
        du, dv = self.delta(r, u, v)
        return u + du, v + dv

    def delta_columns(self, r: Column, u: Column, v: Column, rank: int | None = None) -> tuple[Column, Column]:
        e = F.lit(self.eta) * (r - dot(u, v, rank))
        return F.transform(v, lambda x: e * x), F.transform(u, lambda x: e * x)

    def next_columns(self, r: Column, u: Column, v: Column, rank: int | None = None) -> tuple[Column, Column]:
        e = F.lit(self.eta) * (r - dot(u, v, rank))
        return axpy(e, v, u), axpy(e, u, v)


@dataclass(frozen=True)
class RegularizedSGD:
    """SGD with a penalty that is shared out over an id's ratings: p - eta (penalty / omega p - e q)."""

    eta: float
    penalty: float

    def delta(self, r, u, v, omega_u=1.0, omega_v=1.0):
        e = (r - (u * v).sum(-1))[..., None]
        a, b = np.asarray(omega_u, float)[..., None], np.asarray(omega_v, float)[..., None]
        return -self.eta * (self.penalty / a * u - e * v), -self.eta * (self.penalty / b * v - e * u)

    def next_factors(self, r, u, v, omega_u=1.0, omega_v=1.0):
        du, dv = self.delta(r, u, v, omega_u, omega_v)
        return u + du, v + dv


class Mock:
    """A double for tests: vectors stay as they are, and the delta is the vectors themselves."""

    def next_factors(self, r, u, v, omega_u=None, omega_v=None):
        return u, v

    def delta(self, r, u, v):
        return u, v
