"""The sequential SGD kernel over one slot's ratings and vectors.

Ratings are applied in the order given. Ratings without a common user or item
commute, so each is put on the first level after those of its user and item, and a
level is one numpy step: the result is that of the sequential order, bit for bit of
each update. Finding a rating's level takes two dictionary look-ups in Python.
"""

from __future__ import annotations

import numpy as np


class Diverged(ArithmeticError):
    """A vector is no longer finite."""


def levels(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    """For each rating, in order, the length of the longest chain of common users or items that ends there."""
    of_user, of_item, out = {}, {}, np.empty(len(users), np.int64)
    for n, (u, i) in enumerate(zip(users.tolist(), items.tolist(), strict=True)):
        k = max(of_user.get(u, 0), of_item.get(i, 0)) + 1
        of_user[u] = of_item[i] = out[n] = k
    return out


def sweep(users, items, ratings, u, v, update, omega_u=None, omega_v=None, trace=None) -> None:
    """Apply ratings, in order, to the rows of u and v in place; users and items are places of rows.

    trace, if given, gets (place of the rating, user's vector, item's vector) after each.
    """
    if not len(users):
        return
    level = levels(users, items)
    order = np.argsort(level, kind="stable")
    ends = np.flatnonzero(np.diff(level[order], append=level.max() + 1)) + 1
    start = 0
    for end in ends:
        at = order[start:end]
        a, b = users[at], items[at]
        w = (omega_u[a], omega_v[b]) if omega_u is not None else (None, None)
        u[a], v[b] = update(ratings[at], u[a], v[b], *w)
        if trace is not None:
            trace += [(int(n), x, y) for n, x, y in zip(at, u[a], v[b], strict=True)]
        start = end
    if not (np.isfinite(u).all() and np.isfinite(v).all()):
        raise Diverged("SGD diverged: lower the learning rate or scale the ratings")
