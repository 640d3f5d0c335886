"""Input tables and generated inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import draw


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder; columns and filters are pushed to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def generate_keys(spark: SparkSession, rows: int, seed: int = 1, key_range: int = 1 << 31, payload_bytes: int = 0, method: str = "xxhash64") -> DataFrame:
    """(id, key[, payload]): reproducible keys in [0, key_range), whatever the partitioning."""
    df = spark.range(rows).select("id", F.pmod(draw(["id"], seed, method), F.lit(key_range)).alias("key"))
    if payload_bytes:
        df = df.withColumn("payload", F.repeat(F.lit("\0"), payload_bytes).cast("binary"))
    return df


def generate_lookup_fixture(spark: SparkSession, data_rows: int, requests_per_key: int = 4) -> tuple[DataFrame, DataFrame]:
    """(requests, data): every data key is asked for ``requests_per_key`` times.

    data (key, value), requests (request_id, key). Keys are distinct and fit 63 bits.
    """
    data = spark.range(data_rows).select((F.col("id") * 2).alias("key"), (F.col("id") * 10).alias("value"))
    requests = spark.range(data_rows * requests_per_key).select(F.col("id").alias("request_id"), (F.expr(f"id div {requests_per_key}") * 2).alias("key"))
    return requests, data
