"""Reproducible pseudo-random numbers.

``rand()`` depends on the partitioning and is not repeatable after a lost executor, so every random
choice is an arithmetic hash of the row's own key: the same row gets the same draw in any plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 4294967295


def _mix(x: Column) -> Column:
    # Fixed value: the multiplier of the public 32-bit integer finaliser.
    x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(73244475)).bitwiseAND(F.lit(MASK))
    x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(73244475)).bitwiseAND(F.lit(MASK))
    return F.shiftright(x, 16).bitwiseXOR(x)


def hash32(key: Column, draw: Column | int = 0, seed: int = 0) -> Column:
    """Uniform integer in [0, 2^32) of a non-negative key and a draw number."""
    key = key.cast("bigint")
    draw = (F.lit(draw) if isinstance(draw, int) else draw).cast("bigint")
    low = key.bitwiseAND(F.lit(2147483647)) * F.lit(2654435761)
    high = F.shiftright(key, 31) * F.lit(40503)
    start = low + high + draw * F.lit(668265263) + F.lit(seed * 374761393)
    return _mix(start.bitwiseAND(F.lit(MASK)))


def uniform(key: Column, draw: Column | int = 0, seed: int = 0) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(key, draw, seed) / F.lit(4294967296.0)


def hash32_sql(key: str, draw: str | int = 0, seed: int = 0) -> str:
    """The same hash as SQL text, for cross-checks in other engines."""

    def mix(x: str) -> str:
        once = f"((xor(({x}) >> 16, {x}) * 73244475) & {MASK})"
        twice = f"((xor(({once}) >> 16, {once}) * 73244475) & {MASK})"
        return f"xor(({twice}) >> 16, {twice})"

    start = (
        f"((({key})::BIGINT & 2147483647) * 2654435761 + (({key})::BIGINT >> 31) * 40503"
        f" + ({draw})::BIGINT * 668265263 + {seed * 374761393}) & {MASK}"
    )
    return mix(f"({start})")


def uniform_sql(key: str, draw: str | int = 0, seed: int = 0) -> str:
    return f"(({hash32_sql(key, draw, seed)}) / 4294967296.0::DOUBLE)"
