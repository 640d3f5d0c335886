"""Scans in row order: running counts, carried values, compaction, lower bounds, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import unused
from ..session import default_partitions
from .ordering import with_position
from .ranges import range_bucket, sample_splitters, with_tie


def running_count(df: DataFrame, marked: Column, keys: list[str], name: str = "prefix", inclusive: bool = False) -> DataFrame:
    """``df`` with how many rows before it (or up to it) are marked, in order of ``keys``.

    Two levels: counts inside range buckets, shifted by the totals of the buckets before.
    """
    columns = df.columns
    df, keys = with_tie(df, keys)
    bucket, one, total, start, within = unused([*df.columns, name], "_bucket", "_one", "_total", "_start", "_inside")
    splitters = sample_splitters(df, keys, default_partitions(df.sparkSession))
    tagged = df.withColumn(bucket, range_bucket(df, keys, splitters)).withColumn(one, F.coalesce(marked.cast("long"), F.lit(0)))
    totals = tagged.groupBy(bucket).agg(F.sum(one).alias(total))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = totals.select(bucket, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(bucket).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    counted = tagged.withColumn(within, F.coalesce(F.sum(one).over(inside), F.lit(0)))
    return counted.join(F.broadcast(starts), bucket).select(*columns, (F.col(start) + F.col(within)).cast("long").alias(name))


def compact(df: DataFrame, marked: Column, keys: list[str], name: str = "new_pos") -> DataFrame:
    """``df`` with its place when marked rows move to the front and all keep their order."""
    (last,) = unused([*df.columns, name], "_last")
    tagged = df.withColumn(last, ~F.coalesce(marked, F.lit(False)))
    return with_position(tagged, [last, *keys], name).drop(last)


def carry_forward(df: DataFrame, value: Column, keys: list[str], by: list[str] | None = None, name: str = "carried") -> DataFrame:
    """``df`` with the last non-null ``value`` before the row, per ``by`` or over all rows.

    Over all rows it works on two levels, like ``running_count``; the value that enters a bucket
    is the last one of the buckets before. Pass a struct to carry rows whose fields may be null.
    """
    if by:
        own = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(own))
    columns = df.columns
    df, keys = with_tie(df, keys)
    bucket, held, last, enter, within = unused([*df.columns, name], "_bucket", "_value", "_last", "_entering", "_inside")
    splitters = sample_splitters(df, keys, default_partitions(df.sparkSession))
    tagged = df.withColumn(bucket, range_bucket(df, keys, splitters)).withColumn(held, value)
    order = F.struct(*keys)
    lasts = tagged.where(F.col(held).isNotNull()).groupBy(bucket).agg(F.max_by(held, order).alias(last))
    buckets = df.sparkSession.range(len(splitters) + 1).select(F.col("id").cast("int").alias(bucket))
    entering = F.last(last, ignorenulls=True).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.join(lasts, bucket, "left").select(bucket, entering.alias(enter))
    inside = Window.partitionBy(bucket).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    scanned = tagged.withColumn(within, F.last(held, ignorenulls=True).over(inside))
    return scanned.join(F.broadcast(starts), bucket).select(*columns, F.coalesce(within, enter).alias(name))


def lower_bound(probes: DataFrame, probe: str, data: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """``probes`` with the number of data keys below each: the index of the first one at or above.

    Data keys get their position; probes and keys are then scanned together, range by range.
    """
    kind = data.schema[key].dataType
    left = probes.select(F.col(probe).cast(kind).alias("_k"), F.lit(0).alias("_side"), F.struct(*probes.columns).alias("_row"))
    right = data.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    if name.lower() in {c.lower() for c in probes.columns}:
        raise ValueError(f"the probes have a column {name!r} already")
    both = running_count(left.unionByName(right), F.col("_side") == 1, ["_k", "_side"], name)
    return both.where("_side = 0").select(*(F.col("_row")[c].alias(c) for c in probes.columns), name)


def first_seen(df: DataFrame, message: list[str], arrival: list[str], name: str = "copy") -> DataFrame:
    """``df`` with the number of the row among equal messages: 1 the first time, then 2, ..."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*message).orderBy(*arrival)).cast("long"))
