"""URL rules through a blocked Bloom filter and an exact hash join, in SQL functions.

A rule is a host and the beginning of a path, written together (``net/es/``). It fits its
host and all subdomains of it if the url's path begins with the rule's path; of the rules
that fit, the longest wins. A url's candidates are all suffixes of its host at label borders,
joined to the beginnings of its path at the lengths that occur among the rules. The Bloom
filter drops nearly all candidates that are no rule; the join drops the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit words of one block, bits set for a rule inside its block, bits of filter per rule.
BLOCK_WORDS, PROBES, BITS_PER_RULE = 8, 6, 16
#: The filter never has more blocks than this (4 MB); longer lists only pass more candidates on.
MAX_BLOCKS = 1 << 16
#: Up to so many rules the join may broadcast them; beyond it both sides are shuffled.
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) rows of a list such as ``[("net/es/", "block")]``."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def _bits(key, blocks: int):
    """(block, [bit in block, ...]) of a key."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    second = F.xxhash64(key, F.lit("bits"))
    return block, [F.shiftrightunsigned(second, 9 * i).bitwiseAND(F.lit(64 * BLOCK_WORDS - 1)).cast("int") for i in range(PROBES)]


def blocked_bloom(rules: DataFrame, n_rules: int) -> tuple[int, list[int]]:
    """Number of blocks and all filter words. At most ``MAX_BLOCKS * BLOCK_WORDS`` words."""
    blocks = max(1, min(MAX_BLOCKS, -(-n_rules * BITS_PER_RULE // (64 * BLOCK_WORDS))))
    block, bits = _bits(F.col("rule"), blocks)
    words = (
        rules.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
        .select((F.col("block") * BLOCK_WORDS + F.shiftright("bit", 6)).alias("word"), F.expr("shiftleft(1L, bit & 63)").alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .collect()
    )
    table = [0] * (blocks * BLOCK_WORDS)
    for row in words:
        table[row["word"]] = row["mask"]
    return blocks, table


def maybe_listed(key, blocks: int, table: list[int]):
    """True for every listed key and for few others."""
    words = F.lit(table).cast("array<bigint>")
    block, bits = _bits(key, blocks)
    hit = F.lit(True)
    for bit in bits:
        word = F.get(words, block * BLOCK_WORDS + F.shiftright(bit, 6))
        hit = hit & (F.expr("1").isNotNull() & (F.call_function("getbit", word, bit.bitwiseAND(F.lit(63))) == 1))
    return hit


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: (id, host, path, rule, verdict).

    ``rule`` is the longest rule that fits (of equally long ones the smallest text), else
    null with the verdict ``default``. Null urls and urls without ``://`` have empty host and
    path and fit no rule. Repeated rows are all returned. Rules listed twice count once (with
    the smaller verdict); null rules are ignored.
    """
    rules = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.min("verdict").alias("verdict"))
    path_lengths = F.length("rule") - F.length(F.substring_index("rule", "/", 1))
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(path_lengths)).alias("lengths")).first()
    blocks, table = blocked_bloom(rules, shape["n"])

    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    urls = urls.select("_id", "_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    labels = F.size(F.split("_host", "\\."))
    suffixes = F.transform(F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", F.col("_host"), F.lit("."), -k))
    lengths = F.lit([int(x) for x in shape["lengths"]] or [0]).cast("array<int>")
    heads = F.transform(F.filter(lengths, lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    candidates = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(s, h)))))
    passing = F.filter(candidates, lambda key: maybe_listed(key, blocks, table))
    urls = urls.withColumn("_keys", F.when(F.col("_host") != "", passing).otherwise(F.array().cast("array<string>")))

    rows = urls.select("_id", "_url", "_host", "_path", F.greatest(F.size("_keys"), F.lit(1)).alias("_m"), F.explode_outer("_keys").alias("_key"))
    listed = rules.select(F.col("rule").alias("_key"), F.lit(True).alias("_listed"), "verdict")
    joined = rows.join(F.broadcast(listed) if shape["n"] <= BROADCAST_RULES else listed, "_key", "left")
    best = joined.groupBy("_id", "_url", "_host", "_path", "_m").agg(
        F.min(F.when(F.col("_listed"), F.struct((-F.length("_key")).alias("n"), F.col("_key").alias("rule"), F.col("verdict")))).alias("_best"),
        F.count(F.lit(1)).alias("_rows"),
    )
    # Equal input rows have met in one group; give each of them its own row again.
    return best.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.expr("_rows div _m"))).alias("_copy"),
    ).drop("_copy")
