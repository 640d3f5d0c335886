"""Near duplicates by MinHash over word shingles, confirmed on the full sets.

A document's set holds 64-bit hashes of its distinct word shingles. Documents with equal sets
form one class, and everything below runs on one representative of each class. ``BANDS``
bands of ``ROWS`` universal-hash minima give the buckets. Links are found in passes:

* star passes compare each member of a bucket with one pivot of the bucket (the smallest id,
  then, in buckets of more than ``BLOCK`` members, one drawn by hash) and join what they
  confirm to components;
* the last pass compares, in buckets whose members are still in several components, every
  pair across components, in blocks of about ``BLOCK`` members: those of the bucket's largest
  component with all others, and the others among themselves. A pair that shares several buckets
  is compared in that of its first common band. A set is written as its difference from the set of that component's
  smallest document: which of its shingles are missing, and which others it has (without those
  that no other member has, which no pair can share). Sizes of intersections follow exactly
  from the differences, so only links leave a block.

A pair inside one component cannot change the result and is not compared. Star candidates pass
the signature check (which keeps pairs up to ``SLACK`` standard deviations below the threshold)
and are confirmed on the full sets. There is no cap on buckets, partners or candidates.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, owning, partitions, plain, prepare, rows_of, tidy
from .components import connected_components

#: At similarity 0.8 a pair misses all 28 bands of 5 minima with probability 1.5e-5.
BANDS, ROWS = 28, 5
#: Standard deviations of the estimate below the threshold at which a candidate is dropped.
SLACK = 4.5
#: Members of a block in the last pass, and bytes of difference bits that it unpacks at a time.
BLOCK, CHUNK = 128, 8192
#: Shingles that are hashed at once.
STEP = 512

_GENERATOR = np.random.default_rng(20240229)
_A = _GENERATOR.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _GENERATOR.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = _GENERATOR.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    A-Z are lower-cased; words are runs of other characters than ``[\\x20\\x09-\\x0D]``. A text
    with fewer words than a shingle has its whole sequence as its one shingle.
    """
    found = (text or "").encode().lower().split()  # bytes: only ASCII is lowered and splits
    if not found:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ hashed[i : len(found) - n + 1 + i]) * _MIX[i % len(_MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Minima of all hash functions (multiply-add-shift, 32 bits), ``STEP`` shingles at a time."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    values = np.empty((BANDS * ROWS, min(STEP, len(shingles))), np.uint64)
    for at in range(0, len(shingles), STEP):
        part = shingles[at : at + STEP]
        own = values[:, : len(part)]
        np.multiply(_A[:, None], part, out=own)
        np.add(own, _B[:, None], out=own)
        np.minimum(least, own.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)  # the shift keeps the order


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of each signature.

    Signatures hold 16 bits of each minimum; equal minima give equal keys, and others meet by
    chance too rarely to matter to the checks that follow.
    """
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS))
    for row in np.moveaxis(signatures.reshape(-1, BANDS, ROWS), 2, 0):
        keys = (keys ^ row.astype(np.uint64)) * _MIX[0]
        keys ^= keys >> np.uint64(31)
    return keys


def _features(words: int):
    def run(batches):
        for batch in batches:
            sizes, prints, signatures = [], [], []
            for text in column(batch, "_text").to_pylist():
                shingles = shingle_set(text, words)
                sizes.append(len(shingles))
                prints.append(xxhash.xxh128_digest(shingles.tobytes()) if len(shingles) else None)
                signatures.append(minima(shingles).astype("<u2").tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "_id"), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (prints, signatures))],
                ["_id", "n_shingles", "print", "signature"],
            )

    return run


def _explode_bands(batches):
    for batch in batches:
        keys = band_keys(np.frombuffer(b"".join(column(batch, "signature").to_pylist()), "<u2").reshape(-1, BANDS * ROWS))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), column(batch, "cid").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], ["key", "cid"])


def _floor(threshold: tuple[int, int]) -> float:
    """Least share of equal minima that a candidate keeps."""
    s = threshold[0] / threshold[1]
    return s - SLACK * (s * (1 - s) / (BANDS * ROWS)) ** 0.5


def _likely(floor: float):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(column(batch, n).to_pylist()), "<u2").reshape(batch.num_rows, -1) for n in ("signature_a", "signature_b"))
            keep = (a == b).mean(axis=1) >= floor if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([column(batch, n) for n in ("a", "b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(words: int, threshold: tuple[int, int]):
    top, bottom = threshold

    def run(batches):
        held: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(text: str) -> np.ndarray:
            key = xxhash.xxh128_digest(text.encode())
            if key not in held:
                held[key] = shingle_set(text, words)
                if len(held) > 256:
                    held.popitem(last=False)
            held.move_to_end(key)
            return held[key]

        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "text_a").to_pylist(), column(batch, "text_b").to_pylist(), strict=True):
                p, q = of(x or ""), of(y or "")
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(bool(len(p) and len(q)) and bottom * shared >= top * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([column(batch, n) for n in ("a", "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, words).tobytes() for text in column(batch, "text").to_pylist()]
            prints = [xxhash.xxh128_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([column(batch, "cid"), pa.array(prints, pa.binary()), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["cid", "print", "n_shingles", "shingles"])

    return run


def _elements(batches):
    for batch in batches:
        sets = column(batch, "shingles").to_pylist()
        rows = pa.array(np.repeat(np.arange(len(sets)), [len(s) // 8 for s in sets]))
        yield pa.RecordBatch.from_arrays([column(batch, "cid").take(rows), column(batch, "print").take(rows), pa.array(np.frombuffer(b"".join(sets), np.int64))], ["cid", "print", "element"])


def _differences(batches):
    """Sets as missing shingles of the reference set (bits) and others that some other set has; with all bucket keys."""
    for batch in batches:
        missing, extra = [], []
        for own, reference, alone in zip(*(column(batch, n).to_pylist() for n in ("shingles", "reference", "alone")), strict=True):
            s, t = np.frombuffer(own, np.uint64), np.frombuffer(reference, np.uint64)
            missing.append(np.packbits(~np.isin(t, s, assume_unique=True)).tobytes())
            others = np.setdiff1d(s, t, assume_unique=True)
            extra.append(np.setdiff1d(others, np.array(alone or [], np.int64).view(np.uint64)).tobytes())
        keys = band_keys(np.frombuffer(b"".join(column(batch, "signature").to_pylist()), "<u2").reshape(-1, BANDS * ROWS))
        arrays = [*(column(batch, n) for n in ("cid", "major", "n_shingles", "n_reference")), *(pa.array(x, pa.binary()) for x in (missing, extra, [k.tobytes() for k in keys]))]
        yield pa.RecordBatch.from_arrays(arrays, ["cid", "major", "n_shingles", "n_reference", "missing", "extra", "bands"])


def _both_missing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits are set in both, for all rows of two arrays of packed bits."""
    out = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, x.shape[1], CHUNK):
        p, q = (np.unpackbits(z[:, at : at + CHUNK], axis=1).astype(np.float32) for z in (x, y))
        out += (p @ q.T).astype(np.int64)  # exact below 2^24 bits
    return out


def _across(threshold: tuple[int, int]):
    """Grouped function: links between different components in two blocks of a bucket."""
    top, bottom = threshold

    def side(rows: pa.Table) -> tuple:
        numbers = (rows.column(n).to_numpy() for n in ("comp", "cid", "n_shingles"))
        extra, missing, bands = (rows.column(n).to_pylist() for n in ("extra", "missing", "bands"))
        return *numbers, [np.frombuffer(e, np.uint64) for e in extra], np.frombuffer(b"".join(missing), np.uint8).reshape(len(rows), -1), np.frombuffer(b"".join(bands), np.int64).reshape(len(rows), -1)

    def run(rows: pa.Table) -> pa.Table:
        out = [np.zeros((0, 2), np.int64)]
        key, i, j, t = (rows.column(n)[0].as_py() for n in ("key", "i", "j", "n_reference"))
        same, first = i == j, rows.column("side").to_numpy() == 0
        if first.any() and (same or not first.all()):
            one = side(rows.filter(pa.array(first)))
            comp, ids, n, extras, packed, bands = zip(one, one if same else side(rows.filter(pa.array(~first))), strict=True)
            wanted = comp[0][:, None] != comp[1][None]
            if same:
                wanted &= np.triu(np.ones(wanted.shape, bool), 1)
            common = bands[0][:, None] == bands[1][None]
            wanted &= common.any(axis=2) & (np.take_along_axis(bands[0], common.argmax(axis=2), axis=1) == key)
            lost, size = zip(*((np.bitwise_count(p).sum(axis=1, dtype=np.int64), np.array([*map(len, e)])) for p, e in zip(packed, extras, strict=True)), strict=True)
            inside = t - lost[0][:, None] - lost[1][None] + _both_missing(*packed)
            most = inside + np.minimum(size[0][:, None], size[1][None])
            total = n[0][:, None] + n[1][None]
            for i, j in np.argwhere(wanted & (bottom * most >= top * (total - most))):
                shared = inside[i, j] + len(np.intersect1d(extras[0][i], extras[1][j], assume_unique=True))
                if bottom * shared >= top * (total[i, j] - shared):
                    out.append(np.sort([[ids[0][i], ids[1][j]]], axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


@owning("minhash")
def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, kept).

    Documents are linked when ``threshold[1] * |intersection| >= threshold[0] * |union|`` of
    their shingle sets; ``component_id`` is the smallest id reachable by links, itself
    included, and the document of that id is kept. Documents without words (null, empty,
    blank) have an empty set, link with nothing and are kept. Rows that share an id are one
    document with several texts; all of them are returned. A row with a null id links with
    nothing, has a null component and is kept. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(plain(id_col).cast("long").alias("_id"), plain(text_col).alias("_text"))
    schema = "_id bigint, n_shingles bigint, print binary, signature binary"
    features = materialise(rows.mapInArrow(tidy(_features(shingle_words), "minhash"), schema), "features")

    known = features.where("_id IS NOT NULL AND n_shingles > 0")
    # A row for each set; an id that comes with several texts can lead several of them.
    classes = materialise(known.groupBy("print").agg(F.min("_id").alias("cid"), F.first("signature").alias("signature")), "classes")
    # Members of a class that carry another id than their class are linked by their equal sets.
    members = known.select("_id", "print").join(classes.select("print", "cid"), "print")
    links = members.where("_id != cid").select(F.col("_id").alias("a"), F.col("cid").alias("b"))

    buckets = materialise(classes.mapInArrow(tidy(_explode_bands, "minhash"), "key bigint, cid bigint"), "buckets")
    # Keys are written before they are joined, so that the join can split a large bucket.
    keys = materialise(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("pivot")).where("n > 1"), "keys")
    buckets = materialise(buckets.join(keys, "key"), "shared")

    check = _Checker(rows, classes, shingle_words, threshold)
    found = check(buckets.where("cid != pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct())
    components = materialise(connected_components(links.unionByName(found)), "components")
    mixed = _mixed(buckets, components)
    # Buckets of one block are left to the last pass, which compares every pair in them.
    others = mixed.where((F.col("n") > BLOCK) & (F.col("comp") != F.col("pivot_comp")))
    if not others.isEmpty():
        found = check(others.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct())
        components = materialise(connected_components(_edges(components).unionByName(found)), "components")
        mixed = _mixed(mixed, components)
    if not mixed.isEmpty():
        components = connected_components(_edges(components).unionByName(check.across(mixed)))

    out = features.select("_id", "n_shingles").join(components, F.col("_id") == F.col("node"), "left")
    component = F.coalesce("component", "_id")
    return out.select(
        F.col("_id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


class _Checker:
    """Signature check, then confirmation on the full sets of whole texts."""

    def __init__(self, rows: DataFrame, classes: DataFrame, words: int, threshold: tuple[int, int]):
        self.rows, self.classes, self.words, self.threshold = rows, classes, words, threshold

    def _with(self, pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(table.select(F.col("cid").alias(side), F.col(value).alias(f"{value}_{side}")), side)
        return pairs.select("a", "b", f"{value}_a", f"{value}_b")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        likely = self._with(pairs, self.classes, "signature").mapInArrow(tidy(_likely(_floor(self.threshold)), "minhash"), "a bigint, b bigint")
        return self.confirm(materialise(likely.distinct(), "likely"))

    def _texts(self, ids: DataFrame) -> DataFrame:
        return rows_of(self.rows.select(F.col("_id").alias("cid"), F.col("_text").alias("text")), "cid", ids)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        texts = self._texts(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        confirmed = self._with(pairs, texts, "text").mapInArrow(tidy(_confirm(self.words, self.threshold), "minhash"), "a bigint, b bigint")
        return confirmed.distinct()

    def across(self, rows: DataFrame) -> DataFrame:
        """(a, b), a < b: links across components of every bucket in ``rows``."""
        sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
        major = sizes.groupBy("key").agg(F.max(F.struct("size", F.col("comp").alias("major"))).alias("m"), F.sum("size").alias("all"))
        blocks = lambda members: F.ceil(members / BLOCK).cast("int")
        major = materialise(major.select("key", "m.major", blocks(F.col("m.size")).alias("h"), blocks(F.col("all") - F.col("m.size")).alias("g")), "majors")
        rows = materialise(rows.select("key", "cid", "comp").join(major, "key"), "cross")

        members, references = rows.select("cid").distinct(), rows.select(F.col("major").alias("cid")).distinct()
        texts = self._texts(members.unionByName(references).distinct())
        sets = materialise(texts.mapInArrow(tidy(_sets(self.words), "minhash"), "cid bigint, print binary, n_shingles bigint, shingles binary").dropDuplicates(["cid", "print"]), "sets")
        # Shingles that one set alone has, among the sets of all members of these buckets.
        elements = sets.select("cid", "print", "shingles").mapInArrow(tidy(_elements, "minhash"), "cid bigint, print binary, element bigint")
        alone = elements.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cid", "print")).alias("of")).where("n = 1")
        alone = alone.groupBy("of").agg(F.collect_list("element").alias("alone")).select(F.col("of.cid").alias("cid"), F.col("of.print").alias("print"), "alone")
        # A set that shares too little with all others together links with none of them.
        top, bottom = self.threshold
        shared = F.col("n_shingles") - F.coalesce(F.size("alone"), F.lit(0))
        able = sets.join(members, "cid", "left_semi").join(alone, ["cid", "print"], "left").where(shared * bottom >= F.col("n_shingles") * top)
        able = able.join(self.classes.select("print", "signature"), "print").select("cid", "n_shingles", "shingles", "signature", F.coalesce("alone", F.array().cast("array<bigint>")).alias("alone"))
        reference = sets.groupBy("cid").agg(F.min(F.struct("print", "shingles")).alias("s")).select(F.col("cid").alias("major"), F.col("s.shingles").alias("reference"))
        reference = reference.withColumn("n_reference", F.expr("octet_length(reference) div 8").cast("long"))
        reference = materialise(reference.join(references.withColumnRenamed("cid", "major"), "major", "left_semi"), "references")
        pairs = rows.select("cid", "major").distinct().join(able, "cid").join(reference, "major")
        written = pairs.select("cid", "major", "n_shingles", "n_reference", "shingles", "reference", "alone", "signature")
        written = materialise(written.mapInArrow(tidy(_differences, "minhash"), "cid bigint, major bigint, n_shingles bigint, n_reference bigint, missing binary, extra binary, bands binary"), "differences")

        # Blocks 0 to h - 1 hold the largest component, h to h + g - 1 all others; each pair i <= j
        # with j among the others meets: a row of block i on side 0, one of block j on side 1.
        draw = F.xxhash64("cid")
        block = F.when(F.col("comp") == F.col("major"), F.pmod(draw, F.col("h"))).otherwise(F.col("h") + F.pmod(draw, F.col("g"))).cast("int")
        rows = rows.withColumn("block", block).join(written, ["cid", "major"])
        values = ["cid", "comp", "n_shingles", "n_reference", "missing", "extra", "bands"]
        last = F.col("h") + F.col("g") - 1
        first = rows.select("key", F.col("block").alias("i"), F.explode(F.sequence(F.greatest("block", "h"), last)).alias("j"), *values, F.lit(0).alias("side"))
        second = rows.where("block >= h").select("key", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), *values, F.lit(1).alias("side"))
        # Dealt by number: their work is more than their bytes tell, by which partitions would be united.
        met = first.unionByName(second).repartition(partitions(rows.sparkSession), "key", "i", "j")
        return met.groupBy("key", "i", "j").applyInArrow(_across(self.threshold), "a bigint, b bigint").distinct()


def _edges(components: DataFrame) -> DataFrame:
    return components.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _mixed(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """(key, cid, comp, n, pivot, pivot_comp) of buckets of three members or more in several components.

    In a bucket of two the first pass has compared the only pair. The pivot is drawn by hash, so
    it is another member than that pass had.
    """
    rows = buckets.select("key", "cid").join(components, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("component", "cid").alias("comp"))
    rows = materialise(rows, "joined")
    drawn = F.min(F.struct(F.xxhash64("cid", F.lit(1)).alias("h"), F.col("cid").alias("pivot"), F.col("comp").alias("pivot_comp"))).alias("p")
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), drawn).where("n > 2 AND lo != hi")
    mixed = materialise(mixed.select("key", "n", "p.pivot", "p.pivot_comp"), "mixed")
    return materialise(rows.join(mixed, "key"), "mixed-rows")
