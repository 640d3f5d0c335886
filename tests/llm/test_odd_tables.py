"""Every query on tables that are empty, or hold nulls, repeated rows and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from ordina.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id", "labels": "doc_id"}
TABLE_OF = {"op1_html_text": "pages", "op6_warc": "pages", "op9_url_filter": "pages", "op8_embedding_dedup": "embeddings"}
#: Names that operators give to columns of theirs.
CLASHES = [
    "_id", "id", "_row", "row", "_text", "score", "predicted", "held_out", "lang_pred", "lang_score", "cid", "kept", "keep_id", "component_id", "n_links",
    "n_tokens", "ids_le", "decoded", "piece", "start", "length", "sequence_id", "offset", "_rank", "_group", "_nth", "host", "path", "rule", "verdict",
    "payload_digest", "record_type", "refers_to", "cell", "unit", "bucket", "print", "_hash", "_norm", "a", "b", "value", "n", "n_chars_", "block", "_index", "pos",
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    none, odd = tmp_path_factory.mktemp("none"), tmp_path_factory.mktemp("odd")
    for name, key in TABLES.items():
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        rows.limit(0).write.parquet(f"{none}/{name}.parquet")
        blank = rows.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))
        no_key = rows.limit(4).withColumn(key, F.lit(None).cast("long"))
        no_rest = rows.limit(5).select(*(F.col(f.name) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))
        rows = rows.unionByName(blank).unionByName(no_key).unionByName(no_rest).unionByName(rows.orderBy(key).limit(30))
        rows.select("*", *(F.lit(c).alias(c) for c in CLASHES if c not in rows.columns)).write.parquet(f"{odd}/{name}.parquet")
    return {"none": str(none), "odd": str(odd)}


@pytest.mark.parametrize("name", [n for n in queries() if n != "pipeline"])
def test_odd_tables(spark, folders, name):
    query, table = queries()[name], TABLE_OF.get(name, "documents")
    assert query(spark, folders["none"]).collect() == []
    found = query(spark, folders["odd"])
    rows = spark.read.parquet(f"{folders['odd']}/{table}.parquet")
    keys = lambda df: sorted((r[0] is None, r[0]) for r in df.select(TABLES[table]).collect())
    if name == "op7_packing":
        found = found.where("piece = 0")
    assert len(set(found.columns)) == len(found.columns)
    assert [str(k) for k in keys(found)] == [str(k) for k in keys(rows)]


def test_pipeline_on_odd_tables(spark, folders):
    assert 0 < queries()["pipeline"](spark, folders["odd"]).count()
