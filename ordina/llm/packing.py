"""Best-fit packing of token pieces by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. A
configuration is a multiset of lengths that fits one sequence. The covering program over
configurations is solved by multiplicative weights: a length's weight falls with the part of
it that is covered, a knapsack dynamic program over the weights of the lengths that still lack
cover gives the next configuration, and that is taken until one of its lengths is covered. So
there are at most as many rounds as lengths, and the program ends with all of them covered.
Every round also gives a lower bound of the program's value by duality. Rounding takes whole
multiples of the configurations and packs what is left by best fit, on the histogram as well.
Pieces then get their place from their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode
from .common import column, materialise, owning, partitions

#: Rate of multiplicative weights, and how much more a token of a piece of full length is worth
#: (long pieces first: short ones fill what they leave).
RATE, LONGER = 0.5, 0.5


@dataclass
class Plan:
    """Where the pieces of each length go.

    For each length (slot arrays sorted by length, then first rank): the first rank of the
    slot, pieces of the length per sequence, number of the first sequence, offset of the first.
    """

    length: np.ndarray
    first_rank: np.ndarray
    per_sequence: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    #: Lower bound and value of the program, the share of its solution that was taken, and the
    #: pieces that its configurations placed (best fit placed the others).
    bound: float
    program: float
    share: float
    by_program: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        span = int(max(self.first_rank.max(initial=0), rank.max(initial=0))) + 1
        at = np.searchsorted(self.length.astype(object) * span + self.first_rank if span > 1 << 50 else self.length * span + self.first_rank, length * span + rank, side="right") - 1
        inside = rank - self.first_rank[at]
        return self.first_sequence[at] + inside // self.per_sequence[at], self.offset[at] + inside % self.per_sequence[at] * length


def knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """Pieces of each length (index) of the most valuable configuration; 0 for worthless ones."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    items = np.flatnonzero(value > 0)
    worth = value[items]
    if not len(items):
        return np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(items, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        n = upto[room]
        best[room], choice[room] = best[room - 1], 0
        if n:
            sums = best[room - items[:n]] + worth[:n]
            k = int(sums.argmax())
            if sums[k] > best[room]:
                best[room], choice[room] = sums[k], items[k]
    taken, room = np.zeros(capacity + 1, np.int64), capacity
    while room > 0:
        if choice[room]:
            taken[choice[room]] += 1
            room -= choice[room]
        else:
            room -= 1
    return taken


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best fit by falling length, for all pieces of a length and all sequences alike at once.

    Its work follows the number of lengths and configurations, not the number of pieces.
    """
    by_room: dict[int, list[tuple[np.ndarray, int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(count[length])
        room = length
        while left:
            while room <= capacity and not by_room.get(room):
                room += 1
            if room > capacity:
                by_room.setdefault(capacity, []).append((np.zeros(capacity + 1, np.int64), -(-left // (capacity // length))))
                room = capacity
            taken, n = by_room[room].pop()
            each = min(room // length, left)
            filled = min(n, left // each)
            if n > filled:
                by_room[room].append((taken, n - filled))
            more = taken.copy()
            more[length] += each
            by_room.setdefault(room - each * length, []).append((more, filled))
            left -= filled * each
            room = length
    return [(taken, n) for group in by_room.values() for taken, n in group if taken.any()]


def cover(demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Configurations with their shares that cover all of ``demand``, and a lower bound of their sum."""
    lengths, asked = np.arange(capacity + 1), demand > 0
    covered, weight = np.zeros(capacity + 1), np.ones(capacity + 1)
    shares: dict[bytes, float] = {}
    bound = float((lengths * demand).sum()) / capacity
    open_ = asked.copy()
    while open_.any():
        value = np.where(open_, lengths * weight * (1 + LONGER * lengths / capacity), 0.0)
        taken = knapsack(value, capacity)
        # No configuration is worth more, so the values over its worth are feasible in the dual.
        bound = max(bound, float((value * demand).sum() / (value * taken).sum()))
        used = np.flatnonzero(taken)
        rounds = (1 - covered[used]) * demand[used] / taken[used]
        step = float(rounds.min())
        shares[taken.tobytes()] = shares.get(taken.tobytes(), 0.0) + step
        covered[used] += taken[used] * step / demand[used]
        open_[used[rounds <= step * (1 + 1e-9)]] = False
        if open_.any():
            weight[open_] = np.exp(-RATE * (covered[open_] - covered[open_].min()))
    return [(np.frombuffer(k, np.int64), x) for k, x in sorted(shares.items(), key=lambda p: (-p[1], p[0]))], bound


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """Pack ``histogram`` (pieces by length, 1 to ``capacity``) into sequences."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"no piece of length {length} fits {capacity}")
        count[length] = n
    chosen: list[tuple[np.ndarray, int]] = []
    rest = count.copy()
    if rest[capacity]:
        only = np.zeros(capacity + 1, np.int64)
        only[capacity] = 1
        chosen.append((only, int(rest[capacity])))
        rest[capacity] = 0

    full = int(count[capacity])
    ordered, bound = cover(rest, capacity)

    # Rounding: whole multiples of a share of the solution, best fit for what remains. The
    # share with the fewest sequences wins.
    best, won, placed = None, 0.0, 0
    for share in (1.0, 0.5, 0.0):
        tried, left = [], rest.copy()
        for taken, x in ordered if share else ():
            used = taken > 0
            n = int(min(share * x + 1e-6, (left[used] // taken[used]).min()))
            if n > 0:
                tried.append((taken, n))
                left = left - n * taken
        tried += best_fit(left, capacity)
        if best is None or sum(n for _, n in tried) < sum(n for _, n in best):
            best, won, placed = tried, share, int((rest - left).sum())
    chosen += best

    slots, base, given = [], 0, np.zeros(capacity + 1, np.int64)
    for taken, n in chosen:
        offset = 0
        for length in np.flatnonzero(taken).tolist():
            k = int(taken[length])
            slots.append((length, int(given[length]), k, base, offset))
            given[length] += k * n
            offset += k * length
        base += n
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences=base, bound=full + bound, program=full + sum(x for _, x in ordered), share=won, by_program=full + placed)


def _cut(capacity: int, end_id: int):
    """Arrow function: ids of documents to their pieces."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids_crc32")}
        tail = np.array([end_id], "<u4").tobytes()
        for row, ids in enumerate(column(table, "ids_le")):
            body = (ids.as_py() or b"") + tail
            total = len(body) // 4
            first = total if total <= capacity else (total % capacity or capacity)
            edges = [0, *range(first, total + 1, capacity)]
            for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                for name, value in zip(out, (row, piece, a, b - a, zlib.crc32(body[4 * a : 4 * b])), strict=True):
                    out[name].append(value)
        rows = pa.array(out.pop("row"), pa.int64())
        types = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
        return pa.table([column(table, "_id").take(rows), *(pa.array(v, types[k]) for k, v in out.items())], names=["_id", *types])

    return run


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of documents' ids with ``end_id`` at their end.

    Documents longer than ``capacity`` are cut so that the first piece takes the remainder.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return encode(docs, tokenizer, id_col, text_col, finish=_cut(capacity, end_id), finish_schema=f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _placer(plan: Plan):
    def run(batches):
        for batch in batches:
            sequence, offset = plan.place(column(batch, "length").to_numpy(zero_copy_only=False), column(batch, "_rank").to_numpy(zero_copy_only=False))
            keep = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*keep, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with (sequence_id, offset); needs the columns (id, piece, length).

    Rank among equal lengths: rows are dealt to groups by a hash of (id, piece), numbered in
    their group, and the groups of a length follow one another. Rows that are equal
    throughout get different places. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    groups = 4 * partitions(spark)
    dealt = materialise(pieces.withColumn("_group", F.pmod(F.xxhash64(id_col, "piece"), F.lit(groups)).cast("int")), "pieces")
    sizes = materialise(dealt.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = solve(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    in_group = Window.partitionBy("length", "_group").orderBy(id_col, "piece")
    ranked = dealt.withColumn("_nth", F.row_number().over(in_group)).join(starts, ["length", "_group"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_nth") - 1).cast("long").alias("_rank"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id bigint", "offset bigint"])
    return ranked.mapInArrow(_placer(plan), schema)


@owning("packing")
def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all whole documents.

    A null or empty text is one piece that holds ``end_id`` alone. Rows with equal ids are
    packed one by one. Other columns are ignored.
    """
    return pack(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col), capacity, id_col)
