"""A corpus pipeline in five stages; each works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``, and
any others that ``docs`` has, whatever their names. Null texts count as empty, ids may be null or
repeated: stages decide by row. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.llm import common, exact_dedup, langid, minhash, packing, quality
from ordina.llm.common import fresh, plain

#: Documents scored below this are rejected by the quality stage.
LEAST_QUALITY = 0.5
#: How far from chance (1 / languages) to certainty a language's probability must reach. Texts
#: without letters have no language.
LEAST_LANGUAGE = 0.1

#: SQL cannot express the trained stages; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A text without words has the score of no evidence and stays.
    """
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = fresh(docs.columns, "score", "predicted")
    scored = quality.score(docs, weights, docs.columns, names=(score, predicted))
    return scored.where(F.col(score) >= LEAST_QUALITY).select(*map(plain, docs.columns))


def least_probability(languages: int) -> float:
    """What the likeliest of so many languages must reach."""
    chance = 1 / max(1, languages)
    return chance + LEAST_LANGUAGE * (1 - chance) - 1e-9


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; none without letters, none if it knows no language."""
    model = langid.fit(docs)
    lang, score = fresh(docs.columns, "lang_pred", "lang_score")
    found = langid.predict(docs, model, docs.columns, names=(lang, score))
    sure = (F.col(lang) != langid.UNKNOWN) & (F.col(score) >= least_probability(len(model.languages)))
    return found.where(sure).select(*map(plain, docs.columns))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, whatever its id; null and blank texts are one group."""
    row, kept_row = fresh(docs.columns, "row", "kept_row")
    # A row is known by its id and text together; rows that agree in both are copies.
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = docs.withColumn(row, F.md5(whole.cast("binary")))
    found = exact_dedup.exact_groups(rows.select("doc_id", "text", F.col(row).alias("_row")), carry=["_row"])
    kept = found.where("kept").select(F.col("_row").alias(kept_row))
    return rows.dropDuplicates([row]).join(kept, F.col(row) == F.col(kept_row), "left_semi").select(*map(plain, docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows that share an id are compared each by itself, under a 64-bit hash of id and text; of a
    group the smallest id stays. As in the operator, rows with a null id and texts without words
    all stay.
    """
    row, kept_row = fresh(docs.columns, "row", "kept_row")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    known = rows.where("doc_id IS NOT NULL").select(F.col(row).alias("_row"), "doc_id", "text")
    found = minhash.near_duplicates(known.select("_row", "text"), shingle_words=5, threshold=(80, 100), id_col="_row").select("_row", "component_id")
    groups = found.join(known.select("_row", "doc_id"), "_row").groupBy("component_id")
    kept = groups.agg(F.min(F.struct("doc_id", "_row")).alias("_least")).select(F.col("_least._row").alias(kept_row))
    kept = kept.unionByName(rows.where("doc_id IS NULL").select(F.col(row).alias(kept_row)))
    return rows.join(kept, F.col(row) == F.col(kept_row), "left_semi").select(*map(plain, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents that are left; null and empty texts are one piece."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written to the shared folder and read again.

    What a stage has written goes as soon as the next one has read it; the last result goes with
    the application.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return docs
