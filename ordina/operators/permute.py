"""Random ids, buckets of fixed capacity, permutations and exact samples.

Randomness is a hash of stable columns and a seed, so results do not depend on partitioning.
Padding and permuting hide sizes and order before an exchange; that is all they hide: access to
memory is not oblivious here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import unused
from ..functions.random import draw
from .ordering import with_position

CAPACITY = 512


def assign_ids(df: DataFrame, stable: list[str], seed: int = 11, name: str = "rid", method: str = "xxhash64") -> DataFrame:
    """``df`` with a random-looking id made of the columns ``stable``."""
    return df.withColumn(name, draw(stable, seed, method))


def route_buckets(df: DataFrame, value, buckets: int, name: str = "bucket") -> DataFrame:
    """``df`` with the low bits of ``value`` as bucket; ``buckets`` is a power of two."""
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    return df.withColumn(name, value.bitwiseAND(F.lit(buckets - 1)).cast("int"))


def bucket_count(rows: int, ranks: int, capacity: int = CAPACITY) -> int:
    """Buckets that hold ``rows`` rows half full, at least two for each rank."""
    power = 1
    while power < rows:
        power *= 2
    return max(2 * power // capacity, 2 * ranks)


def pad_buckets(df: DataFrame, buckets: int, capacity: int = CAPACITY, bucket: str = "bucket", check: bool = True) -> DataFrame:
    """``df`` with ``is_dummy`` and dummies that fill every bucket to ``capacity`` rows.

    A bucket with more rows raises an error when the plan runs; nothing is dropped.
    """
    count, free, i = unused(df, "_n", "_free", "_i")
    counts = df.groupBy(bucket).agg(F.count(F.lit(1)).alias(count))
    all_buckets = df.sparkSession.range(buckets).select(F.col("id").cast(df.schema[bucket].dataType).alias(bucket))
    missing = all_buckets.join(counts, bucket, "left").withColumn(count, F.coalesce(count, F.lit(0)))
    left = F.lit(capacity) - F.col(count)
    if check:
        left = F.when(F.col(count) > capacity, F.raise_error(F.concat(F.lit("overfull bucket "), F.col(bucket).cast("string"))).cast("bigint")).otherwise(left)
    missing = missing.withColumn(free, left)
    dummies = missing.where(F.col(free) > 0).select(bucket, F.explode(F.sequence(F.lit(1).cast("long"), F.col(free))).alias(i)).drop(i)
    return df.withColumn("is_dummy", F.lit(False)).unionByName(dummies.withColumn("is_dummy", F.lit(True)), allowMissingColumns=True)


def drop_padding(df: DataFrame) -> DataFrame:
    """The real rows of a padded frame."""
    return df.where(~F.col("is_dummy")).drop("is_dummy")


def permute_buckets(df: DataFrame, parts: int, bucket: str = "bucket", rid: str = "rid") -> DataFrame:
    """Real rows, bucket by bucket, in random order inside each bucket."""
    real = drop_padding(df) if "is_dummy" in df.columns else df
    return real.repartition(parts, bucket).sortWithinPartitions(bucket, rid)


def random_permutation(df: DataFrame, stable: list[str], seed: int = 13, name: str = "pos", method: str = "xxhash64") -> DataFrame:
    """``df`` with its place in a random order, a bijection on 0..n-1, the same for every plan."""
    (rid,) = unused([*df.columns, name], "_rid")
    return with_position(df.withColumn(rid, draw(stable, seed, method)), [rid, *stable], name).drop(rid)


def mark_exact(df: DataFrame, stable: list[str], count: int | None = None, seed: int = 19, name: str = "marked", method: str = "xxhash64") -> DataFrame:
    """``df`` with exactly ``count`` rows marked at random (half of them by default)."""
    wanted = df.count() // 2 if count is None else count
    (place,) = unused([*df.columns, name], "_draw")
    return random_permutation(df, stable, seed, place, method).withColumn(name, F.col(place) < wanted).drop(place)
