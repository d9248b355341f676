"""Deterministic integer mixing for generators and salts.

Plain 64-bit integer arithmetic that any SQL engine repeats exactly (no
engine-specific hash), kept below 2**62 so ANSI overflow checks never fire.
A Lehmer step ``x -> x * 48271 mod (2**31 - 1)`` followed by an xor-shift
is the mixing primitive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.functions.util import as_col

# Modulus and multiplier of the Lehmer (MINSTD) generator.
MODULUS = 2147483647
MULTIPLIER = 48271


def lehmer(x, rounds: int = 1) -> Column:
    """``rounds`` of (Lehmer step, then xor with itself shifted right by 11)
    on a non-negative integer column; values stay below 2**31.  The xor-shift
    breaks the linear relation a plain Lehmer step keeps between nearby ids."""
    c = F.pmod(as_col(x).cast("bigint"), F.lit(MODULUS)) + 1
    for _ in range(rounds):
        c = F.pmod(c * MULTIPLIER, F.lit(MODULUS))
        c = c.bitwiseXOR(F.shiftright(c, 11))
    return c


def uniform_int(id_col, stream: int, low: int, high: int, seed: int = 0) -> Column:
    """Deterministic pseudo-uniform integer in ``[low, high]`` for row ``id``.

    ``stream`` picks an independent sequence per generated column.
    """
    base = F.pmod(as_col(id_col).cast("bigint") * 7919 + stream * 1000003 + seed * 15485863, F.lit(MODULUS))
    return F.pmod(lehmer(base, rounds=3), F.lit(high - low + 1)) + low


def det_salt(n_salts: int, *cols) -> Column:
    """Salt in ``[0, n_salts)`` from a hash of row columns.

    Deterministic (unlike ``rand``), so a retried task re-sends each row to
    the same reducer.
    """
    return F.pmod(F.xxhash64(*[as_col(c) for c in cols]), F.lit(n_salts)).cast("int")
