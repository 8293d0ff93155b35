"""Initial vectors of ids, as columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import lcg_uniforms

Initialiser = Callable[[Column], Column]


def pseudo_random(rank: int, seed: int = 0, side: int = 0) -> Initialiser:
    """Uniform in [0, 1), a function of the id (and seed) alone; ``side`` makes users and items of equal id differ."""
    return lambda key: lcg_uniforms(key.cast("long").bitwiseXOR(F.lit(seed ^ side).cast("long")), rank)


def unseeded(rank: int, seed: int | None = None) -> Initialiser:
    """Uniform from the session's generator; the frame must be stored before it is used twice."""
    return lambda key: F.array(*[F.rand(None if seed is None else seed + i) for i in range(rank)])


def custom(f: Callable[[int], list[float]]) -> Initialiser:
    """Any Python function of the id, in Arrow batches; null for a null id."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def each(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: None if pd.isna(i) else [float(x) for x in f(int(i))])

    return lambda key: each(key)
