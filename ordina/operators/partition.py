"""Which part, rank or block a row belongs to, and layouts with a partition for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import unused
from ..functions.integers import block_of, ceil_div
from ..session import default_partitions
from .ordering import order_statistics, with_position
from .ranges import range_bucket, sample_splitters, with_tie


def pivot_partition(df: DataFrame, keys: list[str], pivots: list[tuple], name: str = "part") -> DataFrame:
    """``df`` with the number of pivots at or below its key: part i holds [pivot i-1, pivot i)."""
    return df.withColumn(name, range_bucket(df, keys, sorted(set(pivots))))


def range_exchange(df: DataFrame, keys: list[str], parts: int | None = None, spread_ties: bool = True, seed: int = 3) -> DataFrame:
    """Range-partition and sort by ``keys``; rows that tie are spread by a hash of the row."""
    parts = parts or default_partitions(df.sparkSession)
    if not spread_ties:
        return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    (tie,) = unused(df, "_tie")
    tied = df.withColumn(tie, F.xxhash64(*df.columns, F.lit(seed)))
    return tied.repartitionByRange(parts, *keys, tie).sortWithinPartitions(*keys, tie).drop(tie)


def range_parts(df: DataFrame, keys: list[str], parts: int, name: str = "part") -> DataFrame:
    """``df`` with a range number below ``parts`` that follows the order of ``keys``."""
    return df.withColumn(name, range_bucket(df, keys, sample_splitters(df, keys, parts)))


def balance(df: DataFrame, keys: list[str], parts: int, convention: str = "floor", name: str = "rank") -> DataFrame:
    """``df`` with its position and the block that owns it; blocks differ by one row at most."""
    total = df.count()
    return with_position(df, keys).withColumn(name, block_of(F.col("pos"), F.lit(total), parts, convention))


def samplesort(df: DataFrame, keys: list[str], parts: int, convention: str = "floor") -> DataFrame:
    """``df`` sorted over exactly ``parts`` partitions whose sizes differ by one row at most.

    Ranges by sampled splitters, a sort inside each, then every row to the partition that owns its
    position, in order there.
    """
    pos, rank = unused(df, "_pos", "_rank")
    total = df.count()
    placed = with_position(df, keys, pos).withColumn(rank, block_of(F.col(pos), F.lit(total), parts, convention).cast("int"))
    return placed.repartitionById(parts, F.col(rank)).sortWithinPartitions(pos).drop(pos, rank)


def quickselect_sort(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``df`` sorted over ``parts`` partitions cut at exact order statistics, without a balancing step.

    Partition r begins with the row at position r * rows // parts. Rows that tie on all keys are
    cut by a hash of the row; equal rows stay together.
    """
    tied, order = with_tie(df, keys)
    total = df.count()
    targets = sorted({total * r // parts for r in range(1, parts)} - {0})
    found = {r["target"]: tuple(r)[1:] for r in order_statistics(tied.select(*order), order, targets).collect()}  # parts - 1 rows
    cuts = [found[t] for t in targets]
    # Without a row for each partition some begin at the same place: those before it are empty.
    number = [max(r for r in range(parts) if total * r // parts == t) for t in targets]
    (part,) = unused(tied, "_part")
    bucket = range_bucket(tied, order, cuts)
    empty = max((r for r in range(parts) if total * r // parts == 0), default=0)
    ranks = F.element_at(F.lit([empty, *number]).cast("array<int>"), bucket + 1)
    return tied.withColumn(part, ranks).repartitionById(parts, F.col(part)).sortWithinPartitions(*order).drop(part, order[-1])


def hash_distribute(df: DataFrame, bucket, ranks: int, name: str = "rank") -> DataFrame:
    """Buckets dealt to ranks in turn."""
    return df.withColumn(name, F.pmod(bucket, F.lit(ranks)))


def _block(pos: str, total: int, parts: int):
    """(rank, place in its block, rows of the block) of a position, by the ceil convention."""
    rank = block_of(F.col(pos), F.lit(max(1, total)), parts, "ceil")
    start = ceil_div(rank * total, F.lit(parts))
    return rank, F.col(pos) - start, ceil_div((rank + 1) * total, F.lit(parts)) - start


def transpose(df: DataFrame, parts: int, total: int, inverse: bool = False, pos: str = "pos", name: str = "dest") -> DataFrame:
    """Destination of each of ``total`` positions, cut into ``parts`` blocks (any number): stride, or back again."""
    _, local, size = _block(pos, total, parts)
    dest = F.call_function("div", local * parts, size) if inverse else local % parts
    return df.withColumn(name, dest.cast("long"))


def half_shift(df: DataFrame, parts: int, total: int, inverse: bool = False, pos: str = "pos", name: str = "dest") -> DataFrame:
    """The second half of each block (the smaller one) goes to the next block, the last one's to the first; or back."""
    rank, local, size = _block(pos, total, parts)
    half = F.call_function("div", size, F.lit(2))
    dest = F.when(local < half, rank - 1).otherwise(rank) if inverse else F.when(local < size - half, rank).otherwise(rank + 1)
    return df.withColumn(name, F.pmod(dest, F.lit(parts)).cast("long"))


def partition_sizes(df: DataFrame, part: str) -> DataFrame:
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("n"))


def compare_exchange(df: DataFrame, stride: int, pos: str = "pos", key: str = "key") -> DataFrame:
    """Each pair of positions that differ in the bit ``stride``: the smaller key goes first.

    ``stride`` is a power of two; positions without a partner stay. The two rows of a pair meet
    by their common position.
    """
    pair, size, nth = unused(df, "_pair", "_size", "_nth")
    own = Window.partitionBy(pair)
    frame = df.withColumn(pair, F.col(pos) - F.col(pos).bitwiseAND(F.lit(stride)))
    frame = frame.withColumn(size, F.count(F.lit(1)).over(own)).withColumn(nth, F.row_number().over(own.orderBy(key, pos)))
    moved = F.when(F.col(size) == 2, F.col(pair) + (F.col(nth) - 1) * stride).otherwise(F.col(pos))
    return frame.withColumn(pos, moved.cast("long")).select(*df.columns)
