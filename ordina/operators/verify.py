"""Checks that raise: order, permutation and partition laws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import unused
from ..functions.integers import block_of


class LawBroken(AssertionError):
    """A result breaks the law it was checked against."""


def order_violations(df: DataFrame, keys: list[str], pos: str = "pos", block: int = 1 << 16) -> DataFrame:
    """(violations): adjacent positions whose keys fall, also across the borders of blocks.

    Positions are cut into blocks of ``block``; a block compares its own rows, and a second, small
    comparison takes the last row of each block and the first of the next.
    """
    key = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    rows = df.select(F.expr(f"{pos} div {block}").alias("b"), F.col(pos).alias("p"), key.alias("k"))
    inside = rows.withColumn("before", F.lag("k").over(Window.partitionBy("b").orderBy("p")))
    within = inside.agg(F.coalesce(F.sum((F.col("k") < F.col("before")).cast("long")), F.lit(0)).alias("n"))
    ends = rows.groupBy("b").agg(F.min_by("k", "p").alias("first"), F.max_by("k", "p").alias("last"))
    nexts = ends.select((F.col("b") - 1).alias("b"), F.col("first").alias("next"))
    across = ends.join(nexts, "b").agg(F.coalesce(F.sum((F.col("next") < F.col("last")).cast("long")), F.lit(0)).alias("n"))
    return within.unionByName(across).agg(F.sum("n").cast("long").alias("violations"))


def assert_sorted(df: DataFrame, keys: list[str], pos: str = "pos") -> None:
    found = order_violations(df, keys, pos).first()["violations"]
    if found:
        raise LawBroken(f"{found} positions are out of order by {keys}")


def assert_physically_sorted(df: DataFrame, keys: list[str]) -> None:
    """The rows as they lie, partition after partition, are in order.

    Neighbours are compared inside each partition, and the ranges of keys across partitions.
    """
    key = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    rows = df.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"), key.alias("k"))
    inside = F.lag("k").over(Window.partitionBy("p").orderBy("at"))
    spans = rows.withColumn("falls", F.coalesce(F.col("k") < inside, F.lit(False))).groupBy("p").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.bool_or("falls").alias("falls"))
    before = F.max("hi").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    if spans.withColumn("before", before).where("falls OR lo < before").count():
        raise LawBroken(f"the rows do not lie in order of {keys}")


def assert_permutation(result: DataFrame, source: DataFrame) -> None:
    """Both hold the same rows equally often."""
    columns = source.columns
    (n,) = unused(columns, "_n")
    count = lambda df, sign: df.select(*columns).groupBy(*columns).agg((F.count(F.lit(1)) * sign).alias(n))
    both = count(result, 1).unionByName(count(source, -1)).groupBy(*columns).agg(F.sum(n).alias(n)).where(F.col(n) != 0)
    if both.limit(1).count():
        raise LawBroken("the result is no permutation of its source")


def assert_partition_law(df: DataFrame, parts: int, convention: str = "floor", pos: str = "pos", rank: str = "rank") -> None:
    """Positions are 0..n-1, once each, and every row is in the block that owns its position."""
    shape = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(pos).alias("d"), F.min(pos).alias("lo"), F.max(pos).alias("hi")).first()
    if shape["n"] and (shape["n"], 0, shape["n"] - 1) != (shape["d"], shape["lo"], shape["hi"]):
        raise LawBroken("positions are not 0..n-1")
    if df.where(F.col(rank) != block_of(F.col(pos), F.lit(max(1, shape["n"])), parts, convention)).limit(1).count():
        raise LawBroken(f"a row is outside its {convention} block")
