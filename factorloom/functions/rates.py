"""Learning rates by (eta0, t, penalty); t counts sweeps from 1."""

from __future__ import annotations

from collections.abc import Callable

Rate = Callable[[float, int, float], float]


def default(eta0: float, t: int, penalty: float) -> float:
    return eta0 / t**0.5


def constant(eta0: float, t: int, penalty: float) -> float:
    return eta0


def bottou(start: float) -> Rate:
    return lambda eta0, t, penalty: 1 / (penalty * (start + t - 1))


def inverse_scaling(decay: float) -> Rate:
    return lambda eta0, t, penalty: eta0 / t**decay


def xu(decay: float) -> Rate:
    return lambda eta0, t, penalty: eta0 * (1 + penalty * eta0 * t) ** -decay


def sweep_of(step: int, blocks: int, compat: bool = False) -> int:
    """The sweep, from 1, that a sub-step (from 0) belongs to; compat counts sub-steps from 1 and so goes on one early."""
    return (step + compat) // blocks + 1
