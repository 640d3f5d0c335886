"""Explicit range buckets: splitters from a bounded sample, found by binary search.

Buckets depend on the rows' values alone, so any part of a plan can be computed again after a
loss and agree with the rest; ``spark_partition_id`` would not promise that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import unused

#: Rows sampled for each bucket.
SAMPLE_PER_BUCKET = 32
#: Most splitters that are written as nested conditions.
MOST_NESTED = 64


def sample_splitters(df: DataFrame, keys: list[str], buckets: int) -> list[tuple]:
    """At most ``buckets - 1`` increasing key tuples (nulls smallest) that cut ``df`` evenly.

    The sample holds the keys of the rows with the smallest hashes (of all columns): at most
    ``buckets * SAMPLE_PER_BUCKET`` rows.
    """
    if buckets < 2:
        return []
    (draw,) = unused(df, "_draw")
    hashed = df.select(*keys, F.xxhash64(*df.columns, F.lit(17)).alias(draw))
    drawn = hashed.orderBy(draw, *keys).limit(buckets * SAMPLE_PER_BUCKET).select(*keys)
    rows = [tuple(r) for r in drawn.orderBy(*keys).collect()]
    if not rows:
        return []
    cuts = [rows[len(rows) * i // buckets] for i in range(1, buckets)]
    return list(dict.fromkeys(cuts))


def literal_tuple(df: DataFrame, keys: list[str], values: tuple) -> Column:
    return F.struct(*(F.lit(v).cast(df.schema[k].dataType).alias(f"k{i}") for i, (k, v) in enumerate(zip(keys, values, strict=True))))


def range_bucket(df: DataFrame, keys: list[str], splitters: list[tuple]) -> Column:
    """Number of splitters that are at most the row's key tuple, by binary search.

    A few splitters become nested conditions, which compile. More of them would outgrow a compiled
    method, so they stay one constant array, and a fold over the halving steps searches it.
    """
    own = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(own < literal_tuple(df, keys, splitters[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    if len(splitters) <= MOST_NESTED:
        return search(0, len(splitters))
    cuts = F.array(*(literal_tuple(df, keys, s) for s in splitters))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))))

    def further(at: Column, step: Column) -> Column:
        fits = (at + step <= len(splitters)) & (F.get(cuts, at + step - 1) <= own)
        return F.when(fits, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def with_tie(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with a hash of the row, and ``keys`` followed by its name: rows that tie spread over ranges."""
    (tie,) = unused(df, "_tie")
    return df.withColumn(tie, F.xxhash64(*df.columns)), [*keys, tie]
