"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features of a whole text, in ``FEATURES`` hash buckets: words and pairs of words (lower case),
and one to three shapes of words in a row (``IN!!`` has the shape ``A!``; a word of more than 64
characters has a shape for each 64 of them), and whether a word
repeats the one before it. Each kind's counts are turned to shares and their square roots taken,
so a text's length has no weight. The score is the sparse dot product through the logistic
function.

Training takes at most ``SAMPLE`` labelled rows with at most ``SAMPLE_FEATURES`` features in all,
in the order of a hash of the id; scoring covers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Made, cache_of, column, ddl, fresh, held_out, learnable, materialise, plain, prepare, tidy, within
from .ftrl import sigmoid, train_binary

#: Hash buckets, most labelled rows to train on, passes over them, penalties and rates.
FEATURES, SAMPLE, EPOCHS = 1 << 18, 6000, 5
#: Most features (8 bytes each in a file of the driver's) of all rows to train on together.
SAMPLE_FEATURES = 1 << 25
RATES = {"alpha": 0.3, "beta": 1.0, "l1": 0.02, "l2": 0.5}
#: Characters of a word that have one shape; a longer word has the shapes of its pieces.
PIECE = 64
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000

_MIX = np.random.default_rng(31).integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def shape(word: str) -> str:
    """Classes of characters, runs taken once: A upper, a other letters, 0 digits, else itself."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class _Words(dict):
    """Word to 48 bits of its lower-case hash and 16 bits of its shape's."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        text = word.decode()
        value = xxhash.xxh64_intdigest(text.lower()) & ~0xFFFF | xxhash.xxh64_intdigest(shape(text[:PIECE])) & 0xFFFF
        self[word] = value
        return value


_WORDS = _Words()
cache_of("quality", _WORDS.clear)


def _with_pieces(found: list[bytes], shapes: np.ndarray) -> np.ndarray:
    """``shapes`` of the words with those of all pieces of long words."""
    out, last = [], 0
    for i, word in enumerate(found):
        if len(word) > PIECE:
            whole = word.decode()
            more = [xxhash.xxh64_intdigest(shape(whole[at : at + PIECE])) & 0xFFFF for at in range(PIECE, len(whole), PIECE)]
            out += [shapes[last : i + 1], np.array(more, np.uint64)]
            last = i + 1
    return np.concatenate([*out, shapes[last:]]) if out else shapes


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct feature numbers, values) of a text; empty for one without words."""
    found = (text or "").encode().split()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    packed = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    words, shapes = packed >> np.uint64(16), _with_pieces(found, packed & np.uint64(0xFFFF))
    kinds = [
        words * _MIX[0],
        shapes * _MIX[1] + np.uint64(1),
        (words[:-1] * _MIX[2] ^ words[1:]) * _MIX[3],
        (shapes[:-1] * _MIX[4] + shapes[1:]) * _MIX[5],
        ((shapes[:-2] * _MIX[6] + shapes[1:-1]) * _MIX[4] + shapes[2:]) * _MIX[7],
        ((words[1:] == words[:-1]).astype(np.uint64) + np.uint64(3)) * _MIX[6],
    ]
    numbers, values = [], []
    for kind in kinds:
        if len(kind):
            at, n = np.unique((kind >> np.uint64(64 - 18)).astype(np.int64), return_counts=True)
            numbers.append(at)
            values.append(np.sqrt(n / len(kind)))
    at, back = np.unique(np.concatenate(numbers), return_inverse=True)
    return at, np.bincount(back, np.concatenate(values))


def _featurise(batches):
    for batch in batches:
        rows = [features(t) for t in column(batch, "_text").to_pylist()]
        made = [pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary()), pa.array([len(a) for a, _ in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays([column(batch, "_label"), column(batch, "_order"), *made], ["_label", "_order", "at", "values", "size"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights from labelled rows that may be learned from; zeros if there are none.

    Rows with a null label or id are ignored; a document labelled both ways counts as 1 if at
    least half of its labels are. Of documents that share an id one is learned from.
    """
    prepare(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL").where(learnable("_id"))
    marks = marks.groupBy("_id").agg((F.avg("_label") >= 0.5).cast("int").alias("_label"))
    sample = marks.select("_id", "_label", F.xxhash64("_id", F.lit(3)).alias("_order")).orderBy("_order", "_id").limit(SAMPLE)
    texts = docs.select(plain(id_col).alias("_id"), plain(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    # One row of each id, however many have it: the one whose text has the smallest hash.
    texts = texts.groupBy("_id", "_label", "_order").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = texts.select("_label", "_order", "_text").mapInArrow(tidy(_featurise, "quality"), "_label int, _order bigint, at binary, values binary, size bigint")
    rows = within(materialise(rows, "training"), SAMPLE_FEATURES, "size", "_order")
    parsed = Made(lambda i: (np.frombuffer(rows.bytes_of("at", i), "<i4").astype(np.int64), np.frombuffer(rows.bytes_of("values", i), "<f4").astype(float)), len(rows))
    return train_binary(parsed, rows["_label"].astype(float), FEATURES, EPOCHS, **RATES)


def _scorer(weights, text: str, names: tuple[str, str]):
    def run(batches):
        for batch in batches:
            scores = []
            for value in column(batch, text).to_pylist():
                at, values = features(value)
                scores.append(float(sigmoid(values @ weights.value[at])))
            kept = [n for n in batch.schema.names if n != text]
            made = [pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in kept), *made], [*kept, *names])

    return run


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns ``keep`` with the score and the prediction, called ``names``, of each whole text.

    Null is the empty text. No column of ``keep`` may have one of ``names``.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    (text,) = fresh([*keep, *names], "_text")
    rows = docs.select(*map(plain, keep), plain(text_col).alias(text))
    schema = f"{ddl(rows.schema[:-1])}, `{names[0]}` double, `{names[1]}` int"
    return rows.mapInArrow(tidy(_scorer(shared, text, names), "quality"), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, held_out, score, predicted).

    Texts without words have the score of no evidence, 0.5, and so do all texts if there is
    nothing to learn from. Null and repeated ids are carried; other columns are ignored.
    """
    rows = docs.select(plain(id_col).alias("_id"), plain(text_col).alias("_text"))
    scored = score(rows, fit(docs, labels, id_col, text_col), ["_id"], "_text")
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", "predicted")
