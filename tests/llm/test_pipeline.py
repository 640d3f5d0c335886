"""The corpus pipeline against a plain version that works on lists."""

import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ordina.llm import langid, quality

FOLDER = "/root/testdata/sf0.01"
SPACE = re.compile("[\x20\x09-\x0d]+")


def shingles(text, words=5):
    found = [w for w in SPACE.split(text) if w]
    found = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in found]
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def plain_rows(spark, docs, labels):
    """doc_id to text of what the first four stages keep, and how many each of them keeps."""
    texts, left = {r["doc_id"]: r["text"] for r in docs.collect()}, []

    weights = quality.fit(docs, labels)
    for i, text in list(texts.items()):
        at, values = quality.features(text)
        if 1 / (1 + np.exp(-(values @ weights[at]))) < corpus_pipeline.LEAST_QUALITY:
            del texts[i]
    left.append(len(texts))

    model = langid.fit(docs.where(F.col("doc_id").isin(list(texts))))
    for i, text in list(texts.items()):
        name, score = model.predict(text)
        if name == langid.UNKNOWN or score < corpus_pipeline.least_probability(len(model.languages)):
            del texts[i]
    left.append(len(texts))

    best = {}
    for i, text in texts.items():
        key = SPACE.sub("", text)
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(text), i))
    texts = {i: texts[i] for _, i in best.values()}
    left.append(len(texts))

    sets = {i: shingles(t) for i, t in sorted(texts.items())}
    gone, ids = {i: i for i in sets}, list(sets)

    def root(i):
        while gone[i] != i:
            i = gone[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if 100 * small >= 80 * large and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (small + large - both):
                    a, b = sorted((root(i), root(j)))
                    gone[b] = a
    texts = {i: texts[i] for i in ids if gone[i] == i}
    left.append(len(texts))
    return texts, left


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(10**9 + i, t, "en", "odd", 0) for i, t in enumerate([None, "", " \n", "123 456", "🙂 🙂", "a " * 3000])]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    want, left = plain_rows(spark, docs, labels)
    assert docs.count() > left[0] > left[2] > left[3] > 0

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total, at, ends = 0, {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        at.setdefault(r["doc_id"], []).append(r)
    for i, pieces in at.items():
        ids, start = [*tokenizer.encode(want[i], add_special_tokens=False).ids, 2], 0
        for n, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (n, start) and (r["length"] == 1024 or n == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[start : start + r["length"]], "<u4").tobytes())
            start += r["length"]
        assert start == len(ids)
        total += start
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and len(ends) <= 1.05 * total / 1024 + 2


def test_empty_pipeline(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_decide_by_row(spark):
    words = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(6)]
    near = words[4].replace("t4w59", "other")
    rows = [(3, words[0]), (7, words[0]), (7, words[1]), (None, words[2]), (None, words[3]), (None, words[3]), (9, words[4]), (9, words[4]), (8, near), (8, words[5]), (None, None), (11, " ")]
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    order = lambda found: sorted(found, key=str)
    exact = corpus_pipeline.exact_stage(spark, docs, "")
    assert exact.schema.names == schema.names
    want = [(3, words[0]), (7, words[1]), (None, words[2]), (None, words[3]), (9, words[4]), (8, near), (8, words[5]), (11, " ")]
    assert order((r["doc_id"], r["text"]) for r in exact.collect()) == order(want)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in [*want, (None, near), (7, near + " x"), (2, words[2])]], schema)
    want = [(3, words[0]), (7, words[1]), (None, words[2]), (None, words[3]), (7, near + " x"), (8, words[5]), (11, " "), (None, near), (2, words[2])]
    assert order((r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, docs, "").collect()) == order(want)


def test_stages_keep_columns_of_any_name(spark):
    extra = ["score", "predicted", "_text", "lang_pred", "lang_score", "row", "kept_row", "_row", "_id", "cid", "kept", "component_id", "a"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    docs = docs.select("*", *(F.concat(F.lit(n), "doc_id").alias(n) for n in extra))
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.language_stage, corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        found = stage(spark, docs, FOLDER)
        assert found.columns == docs.columns and 0 < len(kept := {tuple(r) for r in found.collect()}) and kept <= {tuple(r) for r in docs.collect()}
