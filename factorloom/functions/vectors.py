"""Array, hash and random-number expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MULTIPLIER, INCREMENT = 0x5DEECE66D, 11
LOW24, LOW48 = (1 << 24) - 1, (1 << 48) - 1


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def dot(u: Column, v: Column, rank: int | None = None) -> Column:
    """u . v, from left to right. With the rank known the sum is written out and stays in generated code."""
    if rank:
        return reduce(lambda a, b: a + b, [F.get(u, F.lit(i)) * F.get(v, F.lit(i)) for i in range(rank)])
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def squared_norm(u: Column, rank: int | None = None) -> Column:
    return dot(u, u, rank)


def axpy(scale: Column, x: Column, y: Column) -> Column:
    """scale * x + y."""
    return F.zip_with(x, y, lambda a, b: scale * a + b)


def block_of(key: Column, blocks: int) -> Column:
    """The block of an id: non-negative for every 32-bit id, the smallest one included."""
    return F.pmod(F.abs(key.cast("long")), F.lit(blocks)).cast("int")


def shifted(block: Column, shift: int, blocks: int) -> Column:
    return F.pmod(block + shift, F.lit(blocks)).cast("int")


def rating_block(user_block: Column, item_block: Column, blocks: int) -> Column:
    return user_block * blocks + item_block


def next_block(current: Column, blocks: int, user_side: bool) -> Column:
    """The rating block that a side goes to next: one column on for users, one row back for items."""
    row, column = F.floor(current / blocks), F.pmod(current, F.lit(blocks))
    row, column = (row, F.pmod(column + 1, F.lit(blocks))) if user_side else (F.pmod(row - 1, F.lit(blocks)), column)
    return (row * blocks + column).cast("int")


def first_block(block: Column, blocks: int) -> Column:
    """The diagonal, where both sides begin."""
    return block * (blocks + 1)


def _lcg_next(state: Column) -> Column:
    """One step of the 48-bit generator, multiplied in halves of 24 bits so that no product leaves 64."""
    low, high = state.bitwiseAND(_long(LOW24)), F.shiftright(state, 24)
    m_low, m_high = MULTIPLIER & LOW24, MULTIPLIER >> 24
    bottom = low * m_low + INCREMENT
    middle = (high * m_low + low * m_high + F.shiftright(bottom, 24)).bitwiseAND(_long(LOW24))
    return F.shiftleft(middle, 24).bitwiseOR(bottom.bitwiseAND(_long(LOW24)))


def lcg_uniforms(seed: Column, n: int) -> Column:
    """n doubles in [0, 1) of the 48-bit linear congruential generator with this seed, as an array.

    The state is threaded through ``aggregate``, so the expression has one size whatever n.
    """
    start = F.struct(seed.cast("long").bitwiseXOR(_long(MULTIPLIER)).bitwiseAND(_long(LOW48)).alias("s"), F.array().cast("array<double>").alias("out"))

    def step(done, _):
        one = _lcg_next(done["s"])
        # The second step needs the first as a value, not as an expression to be evaluated over and over.
        return F.aggregate(F.array(one), F.struct(done["s"].alias("s"), done["out"].alias("out")), lambda d, a: _double(d, a))

    def _double(done, a):
        return F.aggregate(F.array(_lcg_next(a)), done, lambda d, b: F.struct(b.alias("s"), F.concat(d["out"], F.array((F.shiftright(a, 22).cast("double") * float(1 << 27) + F.shiftright(b, 21).cast("double")) * F.lit(2.0**-53))).alias("out")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda d: d["out"])


def exponential_of(uniform: Column, rate: float) -> Column:
    """Inverse distribution function of the exponential law."""
    return -F.log1p(-uniform) / rate
