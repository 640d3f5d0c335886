"""Integer helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_pow2(x: Column) -> Column:
    """Smallest power of two that is at least ``x``; 1 for x <= 1. Exact for 64-bit values."""
    bits = F.length(F.bin((x - 1).cast("long")))
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")))


def log2_floor(x: Column) -> Column:
    """Position of the highest set bit of a positive integer, else null."""
    return F.when(x > 0, F.length(F.bin(x.cast("long"))) - 1)


def ceil_div(a: Column, b: Column) -> Column:
    """a / b rounded up, for b > 0, without floating point."""
    return F.call_function("div", a, b) + F.when(F.pmod(a, b) > 0, 1).otherwise(0) + F.when((a < 0) & (F.pmod(a, b) > 0), -1).otherwise(0)


def unsigned(x: Column) -> Column:
    """The 64-bit pattern of a long read as an unsigned number, DECIMAL(20,0)."""
    value = x.cast("decimal(20,0)")
    return F.when(x < 0, (value + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(value)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a is less than, equal to or greater than b; null if either is."""
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def block_of(pos: Column, total: Column, parts: int, convention: str = "floor") -> Column:
    """The block that owns a position when ``total`` rows are cut into ``parts`` blocks.

    ``floor``: block r begins at floor(r * total / parts); ``ceil``: at ceil(r * total / parts).
    """
    if convention == "floor":
        return F.call_function("div", (pos + 1) * parts - 1, total)
    if convention == "ceil":
        return F.call_function("div", pos * parts, total)
    raise ValueError(f"unknown convention {convention!r}")
