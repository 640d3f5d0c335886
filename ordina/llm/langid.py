"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Features are one to three letters in a row (lower case, a border before and after each word) in
``FEATURES`` hash buckets: square root of the share times the inverse document frequency,
scaled to length one. Document frequencies cover all rows that may be learned from. Weights come
from FTRL with L1 and L2 penalties on about ``SAMPLE`` rows, spread evenly over all languages, and
one row of each language whatever their number (of the former, those whose features sum to
``SAMPLE_FEATURES`` at most); a fifth of them is held back to fit the
temperature that divides the logits, but never a language's first row. Weights are kept without
their zeros, and training keeps its state in a file once there are many languages.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Made, cache_of, column, ddl, fresh, held_out, learnable, materialise, plain, prepare, tidy, within
from .ftrl import SparseRows, softmax, temperature, train_multinomial

#: Hash buckets, rows to train on (besides one of each language), passes, rates.
FEATURES, SAMPLE, EPOCHS = 1 << 16, 6000, 3
#: Most features (8 bytes each in a file of the driver's) of all rows to train on together.
SAMPLE_FEATURES = 1 << 25
RATES = {"alpha": 0.5, "beta": 1.0, "l1": 0.01, "l2": 0.5}
#: Document frequencies travel in slices of so many numbers.
SLICE = 2048
UNKNOWN = "und"

_MIX = np.random.default_rng(47).integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


cache_of("langid", _letters.cache_clear)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of n-grams by bucket, null if the text has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_letters()[points], points, 0).astype(np.uint64)
    if not points.any():
        return None
    points = np.concatenate([[np.uint64(0)], points, [np.uint64(0)]])
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    pairs = points[:-1] * _MIX[0] + points[1:]
    triples = (pairs[:-1] * _MIX[1] + points[2:])[points[1:-1] != 0]
    hashed = np.concatenate([points[points != 0] * _MIX[3], pairs * _MIX[2], triples * _MIX[3]])
    hashed ^= hashed >> np.uint64(31)
    return np.bincount((hashed * _MIX[0] >> np.uint64(48)).astype(np.int64), minlength=FEATURES)


def vector(n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(n)
    values = np.sqrt(n[at]) * idf[at]
    return at, values / max(np.sqrt((values * values).sum()), 1e-12)


def _frequencies(batches):
    seen, total = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in column(batch, "_text").to_pylist():
            n = counts(text)
            if n is not None:
                seen += n > 0
                total += 1
    slices = [np.array([total]), *seen.reshape(-1, SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(slices) - 1), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in slices], pa.binary())], ["slice", "counts"])


def _add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in rows.column("counts").to_pylist())
    return pa.table({"slice": rows.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: SparseRows
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        n = counts(text)
        if n is None or not self.languages:
            return UNKNOWN, 0.0
        at, values = vector(n, self.idf)
        p = softmax(self.weights.dot(at, values) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows that may be learned from and have a language.

    Of rows that share an id and a language one is learned from.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = rows.where("_lang IS NOT NULL").where(learnable("_id"))
    sums = rows.select("_text").mapInArrow(tidy(_frequencies, "langid"), "slice int, counts binary").groupBy("slice").applyInArrow(_add, "slice int, counts binary")
    parts = {r["slice"]: np.frombuffer(r["counts"], "<i8") for r in sums.collect()}  # FEATURES numbers
    total = int(parts.get(-1, np.zeros(1))[0])
    seen = np.concatenate([parts.get(i, np.zeros(SLICE)) for i in range(FEATURES // SLICE)])
    idf = np.log((1 + total) / (1 + seen)) + 1.0

    # Of each language its size and the first row with a letter in hash order.
    order = F.when(F.col("_text").rlike("\\p{L}"), F.struct(F.xxhash64("_id", F.lit(10)).alias("_order"), "_id"))
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")).collect()
    languages = sorted(r["_lang"] for r in sizes if r["_first"] is not None)
    if not languages:
        return Model([], idf, SparseRows.of(np.zeros((FEATURES, 0))), 1.0)
    quota = max(1, SAMPLE // len(languages))
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["_lang"], min(1.0, 1.3 * quota / r["_n"])) for r in sizes], "_lang string, _share double")
    drawn = rows.select("_id", "_lang", F.xxhash64("_id", F.lit(9)).alias("_order"))
    drawn = drawn.join(F.broadcast(shares), "_lang").where(F.pmod("_order", F.lit(1 << 20)) < F.col("_share") * (1 << 20))
    drawn = drawn.select("_id", "_lang", F.xxhash64("_id", F.lit(10)).alias("_order")).distinct().orderBy("_order", "_id", "_lang").limit(SAMPLE + SAMPLE // 2)
    firsts = spark.createDataFrame([(r["_first"]["_id"], r["_lang"], r["_first"]["_order"]) for r in sizes if r["_first"] is not None], drawn.schema)
    drawn = drawn.withColumn("_always", F.lit(False)).unionByName(firsts.withColumn("_always", F.lit(True)))
    drawn = drawn.groupBy("_id", "_lang", "_order").agg(F.bool_or("_always").alias("_always"))
    sample = rows.join(F.broadcast(drawn), ["_id", "_lang"])
    # One row of each id and language, if it can be one with a letter; then the smallest hash.
    best = F.struct((~F.coalesce(F.col("_text").rlike("\\p{L}"), F.lit(False))).alias("none"), F.xxhash64("_text").alias("hash"))
    sample = sample.groupBy("_id", "_lang", "_order", "_always").agg(F.min_by("_text", best).alias("_text"))
    sample = sample.select("_order", "_lang", "_always", "_text").mapInArrow(tidy(_sparse, "langid"), "_order bigint, _lang string, _always boolean, at binary, n binary, size bigint")
    sample = within(materialise(sample, "training"), SAMPLE_FEATURES, "size", "_order", F.col("_always"))

    number = {name: i for i, name in enumerate(languages)}
    learned = [i for i, (size, name) in enumerate(zip(sample["size"], sample["_lang"], strict=True)) if size and name in number]
    labels = np.array([number[sample["_lang"][i]] for i in learned], np.int64)

    def parsed(i: int) -> tuple[np.ndarray, np.ndarray]:
        where = np.frombuffer(sample.bytes_of("at", learned[i]), "<i4").astype(np.int64)
        values = np.sqrt(np.frombuffer(sample.bytes_of("n", learned[i]), "<i4")) * idf[where]
        return where, values / np.sqrt((values * values).sum())

    back = np.arange(len(learned)) % 5 == 4
    back[np.unique(labels, return_index=True)[1]] = False
    train = np.flatnonzero(~back)
    weights = train_multinomial(Made(lambda i: parsed(train[i]), len(train)), labels[train], FEATURES, len(languages), EPOCHS, **RATES)
    logits = np.array([weights.dot(*parsed(i)) for i in np.flatnonzero(back)]).reshape(-1, len(languages))
    return Model(languages, idf, weights, temperature(logits, labels[back]))


def _sparse(batches):
    for batch in batches:
        at, n = [], []
        for text in column(batch, "_text").to_pylist():
            c = counts(text)
            where = np.flatnonzero(c) if c is not None else np.zeros(0, np.int64)
            at.append(where.astype("<i4").tobytes())
            n.append(c[where].astype("<i4").tobytes() if c is not None else b"")
        made = [pa.array(at, pa.binary()), pa.array(n, pa.binary()), pa.array([len(x) // 4 for x in at], pa.int64())]
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("_order", "_lang", "_always")), *made], ["_order", "_lang", "_always", "at", "n", "size"])


def _predictor(model, text: str, names: tuple[str, str]):
    def run(batches):
        for batch in batches:
            found = [model.value.predict(t) for t in column(batch, text).to_pylist()]
            kept = [n for n in batch.schema.names if n != text]
            made = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in kept), *made], [*kept, *names])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """Columns ``keep`` with the language and its probability, called ``names``, of each whole text.

    No column of ``keep`` may have one of ``names``.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (text,) = fresh([*keep, *names], "_text")
    rows = docs.select(*map(plain, keep), plain(text_col).alias(text))
    schema = f"{ddl(rows.schema[:-1])}, `{names[0]}` string, `{names[1]}` double"
    return rows.mapInArrow(tidy(_predictor(shared, text, names), "langid"), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: (id, held_out, lang_pred, score).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if
    no row can be learned from. Null and repeated ids are carried; other columns are ignored.
    """
    rows = docs.select(plain(id_col).alias("_id"), plain(text_col).alias("_text"))
    found = predict(rows, fit(docs, id_col, text_col, lang_col), ["_id"], "_text")
    return found.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
