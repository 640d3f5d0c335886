"""Exact duplicates by sorting content.

Texts are normalised by deleting ``[\\x20\\x09-\\x0D]``. Spark samples splitters of the
normalised bytes and range-partitions on them, its external sorter puts equal texts next to
each other, and the window operator compares each row's whole normalised text with its
neighbour's to find where a run of equals ends. Everything is SQL functions.

A text that very many rows carry would fill one range. Such texts are found by an exact
count of 64-bit hashes (combined before the shuffle); their rows are spread over slices, and
the slices' leaders are merged by SHA-256. There are at most ``8 * partitions`` of them, so
the joins on that list may broadcast it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, plain

#: Characters of normalised text that the range splitters look at.
SPLITTER_CHARS = 48
#: Texts with a common beginning are dealt over so many sub-ranges by their hash, or over as many
#: as there are partitions.
SUB_RANGES = 64


def normalised(text):
    """The text without space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Of equal texts the row with the most code points in its original text stays, then the
    one with the smallest id (a null id counts as the largest). Null text is the empty
    text, so nulls, empty and blank texts form one group. Of rows that share the id as well,
    one is kept. Columns ``carry`` of each row (no name that is used here) follow; others are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    slices = partitions(spark)
    sub_ranges = max(SUB_RANGES, slices)
    rows = docs.select(
        plain(id_col).alias("_id"),
        F.length(F.coalesce(plain(text_col), F.lit(""))).alias("_points"),
        normalised(plain(text_col)).alias("_norm"),
        *carry,
    ).select("*", F.xxhash64("_norm").alias("_hash"))

    counts = docs.select(F.xxhash64(normalised(plain(text_col))).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    total = docs.count()
    heavy = counts.where(F.col("_n") > F.greatest(F.lit(32), F.lit(total // (8 * slices)))).select("_hash", F.lit(True).alias("_heavy"))

    rows = rows.join(F.broadcast(heavy), "_hash", "left").select(
        "_id",
        "_points",
        "_norm",
        F.coalesce("_heavy", F.lit(False)).alias("_heavy"),
        F.substring("_norm", 1, SPLITTER_CHARS).alias("_prefix"),
        F.when(F.col("_heavy"), F.lit(sub_ranges) + F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(4 * slices)))
        .otherwise(F.pmod("_hash", F.lit(sub_ranges)))
        .alias("_slice"),
        *carry,
    )
    run = Window.partitionBy("_prefix", "_slice", "_norm")
    in_order = run.orderBy(F.desc("_points"), F.asc_nulls_last("_id"))
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranged = rows.repartitionByRange(slices, "_prefix", "_slice")
    runs = ranged.select(
        "_id",
        "_heavy",
        F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"),
        F.row_number().over(in_order).alias("_nth"),
        F.first("_id").over(whole).alias("_lead"),
        F.first("_points").over(whole).alias("_lead_points"),
        F.count(F.lit(1)).over(whole).alias("_size"),
        *carry,
    )
    runs = materialise(runs, "runs")  # no texts in it
    # The leaders of a heavy text's slices: at most 4 * partitions rows for each of them.
    merged = (
        runs.where("_heavy AND _nth = 1")
        .groupBy("_sha")
        .agg(
            F.min(F.struct((-F.col("_lead_points")).alias("p"), F.col("_lead").isNull().alias("z"), F.col("_lead").alias("i"))).alias("_best"),
            F.sum("_size").alias("_all"),
        )
        .select("_sha", F.lit(True).alias("_heavy"), F.col("_best.i").alias("_keep"), "_all")
    )
    out = runs.join(F.broadcast(merged), ["_sha", "_heavy"], "left")
    keep = F.when(F.col("_all").isNotNull(), F.col("_keep")).otherwise(F.col("_lead"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_all", "_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(keep) & (F.col("_nth") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *carry,
    )
