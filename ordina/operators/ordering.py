"""Global order: positions, interchangeable sort strategies, runs and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import unused
from ..session import default_partitions
from .ranges import range_bucket, sample_splitters, with_tie
from .verify import assert_physically_sorted

STRATEGIES = ("native", "bucket", "permute", "columnsort")


def with_position(df: DataFrame, keys: list[str], name: str = "pos", buckets: int | None = None, descending: bool = False) -> DataFrame:
    """``df`` with its 0-based position in ascending order of ``keys`` (nulls first), or in the reverse of it.

    Range buckets are numbered on their own and shifted by the sizes of those before, so no
    window spans the table. Rows that tie on all keys are ordered by a hash of the row, so a key
    that most rows have fills many buckets; list more keys to settle ties otherwise. One shuffle of
    the rows; counts are combined before theirs.
    """
    buckets = buckets or default_partitions(df.sparkSession)
    columns = df.columns
    df, keys = with_tie(df, keys)
    in_bucket, n, start, total, nth = unused([*df.columns, name], "_bucket", "_n", "_start", "_total", "_nth")
    bucket = range_bucket(df, keys, sample_splitters(df, keys, buckets))
    counts = df.select(bucket.alias(in_bucket)).groupBy(in_bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(in_bucket).rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    everything = Window.orderBy(in_bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(in_bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start), F.sum(n).over(everything).alias(total))
    own = Window.partitionBy(in_bucket).orderBy(*keys)
    numbered = df.withColumn(in_bucket, bucket).withColumn(nth, F.row_number().over(own))
    place = F.col(start) + F.col(nth) - 1
    return numbered.join(F.broadcast(starts), in_bucket).select(*columns, (F.col(total) - 1 - place if descending else place).cast("long").alias(name))


def sort_global(df: DataFrame, keys: list[str], strategy: str = "native", seed: int = 7, descending: bool = False) -> DataFrame:
    """``df`` in ascending order of ``keys`` (nulls first), or descending (nulls last); all strategies agree on total keys.

    native: a range exchange and a local sort. bucket: rows are first dealt at random to hash
    buckets, then range-partitioned by (keys, random id), which spreads rows that tie.
    permute: a random permutation first, then the same. columnsort: eight rounds of sorting
    columns and moving entries, for rows that fit ``columns``; see ``columnsort_position``.
    """
    way = F.desc if descending else F.asc
    tie, pos = unused(df, "_tie", "_pos")
    if strategy == "native":
        return df.orderBy(*map(way, keys))
    if strategy == "columnsort":
        return columnsort_position(df, keys, pos).orderBy(way(pos)).drop(pos)
    parts = default_partitions(df.sparkSession)
    tied = df.withColumn(tie, F.xxhash64(*df.columns, F.lit(seed)))
    if strategy == "bucket":
        dealt = tied.repartition(parts, F.pmod(tie, F.lit(2 * parts)))
    elif strategy == "permute":
        dealt = tied.repartitionByRange(parts, tie).sortWithinPartitions(tie)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    order = [*map(way, keys), tie]
    return dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop(tie)


def columnsort_shape(rows: int) -> tuple[int, int]:
    """(columns, rows of a column): the most columns W with n >= 2 (W - 1)^2, n even."""
    columns = 1
    while True:
        wider = columns + 1
        n = -(-rows // wider)
        n += n % 2
        if n < 2 * (wider - 1) ** 2 or wider > rows:
            break
        columns = wider
    n = -(-rows // columns) if rows else 0
    return columns, n + n % 2


def columnsort_position(df: DataFrame, keys: list[str], name: str = "pos") -> DataFrame:
    """Positions by columnsort; any number of rows (padding rows sort last and are dropped).

    A column is sorted by one task; there are about (rows / 2)^(1/3) of them.
    """
    total = df.count()
    columns, n = columnsort_shape(total)
    # Deal rows to columns evenly: number them inside hash groups, which needs no order.
    groups = 4 * columns
    # The user's columns are inside one struct: no name clashes, and no condition of the plan names them all.
    rows = df.select(F.struct(*df.columns).alias("_row"))
    tagged = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    sizes = tagged.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_group").orderBy(*(F.col(f"_row.{k}") for k in keys)))
    dealt = tagged.withColumn("_nth", nth).join(F.broadcast(starts), "_group")
    dealt = dealt.select("_row", F.lit(False).alias("_pad"), (F.col("_start") + F.col("_nth") - 1).alias("_at"))
    pads = df.sparkSession.range(total, columns * n).select(F.lit(None).cast(dealt.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_pad"), F.col("id").alias("_at"))
    order = [F.col("_pad"), *(F.col(f"_row.{k}") for k in keys)]

    def sorted_columns(frame: DataFrame, column) -> DataFrame:
        frame = frame.select("_row", "_pad", column.alias("_col"))
        return frame.withColumn("_i", F.row_number().over(Window.partitionBy("_col").orderBy(*order)) - 1)

    frame = sorted_columns(dealt.unionByName(pads), F.expr(f"_at % {columns}"))
    frame = sorted_columns(frame, F.expr(f"(_col * {n} + _i) % {columns}"))
    frame = sorted_columns(frame, F.expr(f"(_i * {columns} + _col) div {n}"))
    half = n // 2
    frame = sorted_columns(frame, F.expr(f"(_col * {n} + _i + {half}) div {n}"))
    place = F.when(F.col("_col") == 0, F.col("_i")).otherwise(F.col("_col") * n - half + F.col("_i"))
    return frame.where("NOT _pad").select(*(F.col("_row")[c].alias(c) for c in df.columns), place.cast("long").alias(name))


def local_sort(df: DataFrame, run, keys: list[str], runs: int | None = None, name: str = "run") -> DataFrame:
    """Rows of each run together in one partition, in order of ``keys``: sorted runs."""
    parts = runs or default_partitions(df.sparkSession)
    return df.withColumn(name, run).repartition(parts, name).sortWithinPartitions(name, *keys)


def run_positions(df: DataFrame, run, keys: list[str], name: str = "run_pos") -> DataFrame:
    """``df`` with its run and 0-based place in the sorted run."""
    tagged = df.withColumn("run", run)
    nth = F.row_number().over(Window.partitionBy("run").orderBy(*keys))
    return tagged.withColumn(name, (nth - 1).cast("long"))


def merge_runs(runs: list[DataFrame], keys: list[str], name: str = "pos", check: bool = True) -> DataFrame:
    """All rows of several sorted runs with their global position.

    A frame whose rows do not lie in order of ``keys`` is no run and raises an error (``check``).
    The exchange hands on each run's share of a range in order, and the sorter of a range, which
    looks for ascending stretches, merges them.
    """
    if check:
        for run in runs:
            assert_physically_sorted(run, keys)
    return with_position(reduce(DataFrame.unionByName, runs), keys, name)


def order_statistics(df: DataFrame, keys: list[str], targets: list[int]) -> DataFrame:
    """(target, keys): the rows at the given 0-based positions; positions outside are absent.

    Only sizes of range buckets are counted over all rows; the rows of buckets that hold a target
    are then sorted. Rows that tie are ordered by a hash of their keys.
    """
    frame, order = with_tie(df.select(*keys), keys)
    bucket = range_bucket(frame, order, sample_splitters(frame, order, 4 * default_partitions(df.sparkSession)))
    (in_bucket,) = unused([*frame.columns, "target"], "_bucket")
    frame = frame.withColumn(in_bucket, bucket)
    sizes = {r[0]: r[1] for r in frame.groupBy(in_bucket).count().collect()}  # a row for each bucket
    starts, at = {}, 0
    for b in sorted(sizes):
        if any(at <= t < at + sizes[b] for t in targets):
            starts[b] = at
        at += sizes[b]
    start = reduce(lambda other, b: F.when(F.col(in_bucket) == b, F.lit(starts[b])).otherwise(other), starts, F.lit(None).cast("long"))
    nth = F.row_number().over(Window.partitionBy(in_bucket).orderBy(*order)) - 1
    placed = frame.where(F.col(in_bucket).isin([*starts])).select((start + nth).cast("long").alias("target"), *keys)
    return placed.where(F.col("target").isin(targets))
