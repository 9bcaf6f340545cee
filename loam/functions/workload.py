"""Generators of benchmark workloads: random draws of an index, and column expressions over an index or a draw."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, functions as F

# The prime of the rank scrambler and digits of a key.
SCRAMBLE, KEY_DIGITS = 4294967291, 16


def key(n: Column) -> Column:
    return F.lpad(n.cast("string"), KEY_DIGITS, "0")


def missing_key(n: Column) -> Column:
    return F.concat(key(n), F.lit("."))


# The step and the two multipliers of SplitMix64.
STEP, MIXERS = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_HALF = (1 << 32) - 1


def _masked(c: Column, mask: int = _HALF) -> Column:
    return c.bitwiseAND(F.lit(mask))


def _bound(made: Column, use) -> Column:
    """use(made), with made computed once: a name in the expression, whichever plan it ends up in."""
    return F.transform(F.array(made), use)[0]


def _times(low: Column, factor: int) -> tuple[Column, Column]:
    """(lower, upper 32 bits) of low * factor, both below 2**32; no step leaves a bigint."""
    first = _masked(low, 0xFFFF) * F.lit(factor)
    second = F.shiftright(low, 16) * F.lit(factor)
    total = first + F.shiftleft(_masked(second, 0xFFFF), 16)
    return _masked(total), F.shiftright(total, 32) + F.shiftright(second, 16)


def _multiplied(z: Column, factor: int) -> Column:
    """z * factor modulo 2**64, on structs of the halves (hi, lo)."""
    high, low = factor >> 32, factor & _HALF

    def made(z: Column) -> Column:
        lower, carry = _times(z["lo"], low)
        upper = carry + _times(z["lo"], high)[0] + _times(z["hi"], low)[0]
        return F.struct(_masked(upper).alias("hi"), lower.alias("lo"))

    return _bound(z, made)


def _mixed(z: Column, by: int) -> Column:
    """z ^ z >> by."""

    def made(z: Column) -> Column:
        down = F.shiftright(z["lo"], by).bitwiseOR(_masked(F.shiftleft(z["hi"], 32 - by)))
        return F.struct(z["hi"].bitwiseXOR(F.shiftright(z["hi"], by)).alias("hi"), z["lo"].bitwiseXOR(down).alias("lo"))

    return _bound(z, made)


def uniform(index: Column, seed: int = 0) -> Column:
    """A number in [0, 1) of 53 bits: the draw of that (non-negative) index of the SplitMix64 sequence of seed.

    64-bit products are made of 32-bit halves, as ANSI bigints don't wrap.
    """
    start = _bound((index + 1).cast("long"), lambda n: F.struct(F.shiftright(n, 32).alias("hi"), _masked(n).alias("lo")))

    def seeded(z: Column) -> Column:
        low = z["lo"] + F.lit(seed & _HALF)
        return F.struct(_masked(z["hi"] + F.lit(seed >> 32 & _HALF) + F.shiftright(low, 32)).alias("hi"), _masked(low).alias("lo"))

    z = _bound(_multiplied(start, STEP), seeded)
    for by, factor in zip((30, 27), MIXERS):
        z = _multiplied(_mixed(z, by), factor)
    return _bound(_mixed(z, 31), lambda z: (z["hi"] * F.lit(1 << 21) + F.shiftright(z["lo"], 11)) * F.lit(2.0**-53))


def uniform_sql(index: str, seed: int = 0) -> str:
    """The same number in DuckDB's SQL, by its unsigned 128-bit integers."""
    wrap = f"{1 << 64}::UHUGEINT"
    z = f"((({index}) + 1)::UHUGEINT * {STEP}::UHUGEINT + {seed}::UHUGEINT) % {wrap}"
    for by, factor in zip((30, 27), MIXERS):
        z = f"list_transform([{z}], lambda z: (xor(z, z >> {by}::UHUGEINT) * {factor}::UHUGEINT) % {wrap})[1]"
    return f"list_transform([{z}], lambda z: (xor(z, z >> 31::UHUGEINT) >> 11::UHUGEINT)::DOUBLE * {2.0**-53!r}::DOUBLE)[1]"


@cache
def zeta(n: int, theta: float, exact: int = 1 << 20) -> float:
    """Sum of rank ** -theta; beyond `exact` terms by the Euler-Maclaurin formula (error far below a double's)."""
    m = min(n, exact)
    total = float((np.arange(1, m + 1, dtype=float) ** -theta).sum())
    if n > m:
        total += (n ** (1 - theta) - m ** (1 - theta)) / (1 - theta) + (n**-theta - m**-theta) / 2
    return total


def zipf_rank(u: Column, n: int, theta: float = 0.99) -> Column:
    zn = zeta(n, theta)
    if n <= 2:
        return F.when(u * zn < 1, 0).otherwise(1).cast("long")
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta(2, theta) / zn)
    tail = F.least(F.floor(F.lit(float(n)) * F.pow(F.lit(eta) * u - F.lit(eta) + 1, F.lit(1 / (1 - theta)))), F.lit(n - 1))
    return F.when(u * zn < 1, 0).when(u * zn < 1 + 0.5**theta, 1).otherwise(tail).cast("long")


def scramble(rank: Column, n: int) -> Column:
    return F.pmod((rank + 1) * F.lit(SCRAMBLE), F.lit(n))


def gap_ns(u: Column, rate: float) -> Column:
    """Nanoseconds to the next arrival of a Poisson process of `rate` a second."""
    return F.floor(-F.log1p(-u) * (1e9 / rate)).cast("long")


def is_read(u: Column, share: float) -> Column:
    """Mixed workloads: reads take this share of operations."""
    return u < share


def value(pool: Column, offset: Column, size: int) -> Column:
    """A window of `size` characters into a pool of printable text."""
    return F.substring(pool, F.pmod(offset, F.length(pool) - size) + 1, F.lit(size))
