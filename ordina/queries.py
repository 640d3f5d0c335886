"""Named queries over the test tables, and DuckDB SQL with the same rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.integers import ceil_div, compare, log2_floor, next_pow2, unsigned
from .operators import lookup, ordering, partition, permute, scan, verify
from .plans.metrics import rows_by_partition, shuffle_stats
from .sources.tables import generate_keys, generate_lookup_fixture, load
from .streaming.duplicates import first_seen_stream

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

RANKS = 7
LINE_KEYS = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
LINE_TIE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def query(sql: str | None):
    def add(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_unique(spark, sf_dir).orderBy("o_orderkey")


# Lookup join


@query("SELECT o_orderkey, c_name, c_custkey IS NOT NULL AS has_value FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_unique(spark, sf_dir):
    requests = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    data = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return lookup.lookup_join(requests, data, "k", ["c_name"]).drop("k")


_LAST = """
SELECT o_orderkey AS k, l_extendedprice AS v, l_orderkey IS NOT NULL AS has_value
FROM orders LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS nth FROM lineitem
) ON l_orderkey = o_orderkey AND nth = 1
"""


def _requests_and_lines(spark, sf_dir):
    requests = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    data = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), *LINE_TIE, F.col("l_extendedprice").alias("v"))
    return requests, data


@query(_LAST)
def lookup_last_dup(spark, sf_dir):
    return lookup.lookup_join(*_requests_and_lines(spark, sf_dir), "k", ["v"], LINE_TIE)


@query(_LAST)
def lookup_scan_plan(spark, sf_dir):
    return lookup.lookup_join(*_requests_and_lines(spark, sf_dir), "k", ["v"], LINE_TIE, plan="scan")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def lookup_missing_keys(spark, sf_dir):
    return lookup.missing_keys(*_requests_and_lines(spark, sf_dir), "k")


# Sorts: positions are read off the sorted result by an independent count of what lies before


_BY_PRICE = "SELECT o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice NULLS FIRST, o_orderkey NULLS FIRST) - 1 AS pos FROM orders"


def _sorted(spark, sf_dir, strategy):
    """The place of each row in the sorted frame itself: its partition's start and its place there."""
    df = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    return _as_it_lies(ordering.sort_global(df, ["o_totalprice", "o_orderkey"], strategy))


def _as_it_lies(ordered):
    # monotonically_increasing_id is (partition, row in it), read off the rows as they come.
    tagged = ordered.withColumn("_id", F.monotonically_increasing_id())
    return ordering.with_position(tagged, ["_id"]).drop("_id")


def _place_in(df, part, name):
    """``df`` with the place of each row among those of ``part`` as they lie."""
    tagged = df.withColumn("_id", F.monotonically_increasing_id())
    return tagged.withColumn(name, (F.row_number().over(Window.partitionBy(part).orderBy("_id")) - 1).cast("long")).drop("_id")


@query(_BY_PRICE)
def sort_native(spark, sf_dir):
    return _sorted(spark, sf_dir, "native")


@query(_BY_PRICE)
def sort_bucket(spark, sf_dir):
    return _sorted(spark, sf_dir, "bucket")


@query(_BY_PRICE)
def sort_permute(spark, sf_dir):
    return _sorted(spark, sf_dir, "permute")


@query(_BY_PRICE)
def sort_columnsort(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    return ordering.columnsort_position(df, ["o_totalprice", "o_orderkey"])


@query("SELECT o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC NULLS LAST) - 1 AS pos FROM orders")
def sort_descending(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    return _as_it_lies(ordering.sort_global(df, ["o_totalprice", "o_orderkey"], "bucket", descending=True))


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC NULLS LAST, event_id DESC) - 1 AS pos FROM events")
def position_descending(spark, sf_dir):
    return ordering.with_position(load(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], descending=True).select("event_id", "pos")


@query("SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag NULLS FIRST) - 1 AS pos FROM lineitem")
def sort_duplicate_keys(spark, sf_dir):
    return ordering.with_position(load(spark, sf_dir, "lineitem"), ["l_returnflag"]).select("l_returnflag", "pos")


@query("SELECT event_id, row_number() OVER (ORDER BY ts NULLS FIRST, event_id) - 1 AS pos FROM events")
def global_position(spark, sf_dir):
    return ordering.with_position(load(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "pos")


@query("SELECT o_orderkey % 8 AS run, o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_totalprice, o_orderkey) - 1 AS run_pos FROM orders")
def local_sort_runs(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return _place_in(ordering.local_sort(df, F.col("o_orderkey") % 8, ["o_totalprice", "o_orderkey"]), "run", "run_pos").select("run", "o_orderkey", "run_pos")


@query("SELECT o_orderkey % 8 AS run, o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_totalprice, o_orderkey) - 1 AS run_pos FROM orders")
def run_positions(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ordering.run_positions(df, F.col("o_orderkey") % 8, ["o_totalprice", "o_orderkey"]).select("run", "o_orderkey", "run_pos")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders")
def merge_runs(spark, sf_dir):
    df, keys = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"]
    runs = [ordering.local_sort(df.where(f"o_orderkey % 4 = {i}"), F.lit(i), keys, 1).drop("run") for i in range(4)]
    return ordering.merge_runs(runs, keys).select("o_orderkey", "pos")


@query(
    f"SELECT pos AS target, o_totalprice, o_orderkey FROM (SELECT o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) "
    f"WHERE pos IN ({', '.join(f'n * {i} // {RANKS}' for i in range(1, RANKS))})"
)
def order_stats(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    n = df.count()
    return ordering.order_statistics(df, ["o_totalprice", "o_orderkey"], [n * i // RANKS for i in range(1, RANKS)])


# Partitions


@query("SELECT part, count(*) AS n FROM (SELECT CAST(o_totalprice >= 50000 AS INTEGER) + CAST(o_totalprice >= 150000 AS INTEGER) + CAST(o_totalprice >= 300000 AS INTEGER) AS part FROM orders) GROUP BY part")
def pivot_partition(spark, sf_dir):
    parted = partition.pivot_partition(load(spark, sf_dir, "orders").select("o_totalprice"), ["o_totalprice"], [(50000.0,), (150000.0,), (300000.0,)])
    return partition.partition_sizes(parted, "part")


@query("SELECT CAST(0 AS BIGINT) AS overlaps, count(*) AS n FROM lineitem")
def range_exchange_law(spark, sf_dir):
    """Key ranges of the exchange's partitions that reach into the next one, and all rows."""
    df = load(spark, sf_dir, "lineitem").select(*LINE_KEYS)
    key = F.struct(*LINE_KEYS)
    spans = partition.range_exchange(df, LINE_KEYS).groupBy(F.spark_partition_id().alias("p"))
    spans = spans.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))
    before = F.max("hi").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    return spans.withColumn("before", before).agg(F.coalesce(F.sum((F.col("lo") < F.col("before")).cast("long")), F.lit(0)).alias("overlaps"), F.sum("n").alias("n"))


def _balanced(spark, sf_dir, convention):
    df = load(spark, sf_dir, "orders").select("o_orderkey")
    return partition.partition_sizes(partition.balance(df, ["o_orderkey"], RANKS, convention), "rank")


@query(f"SELECT r AS rank, (r + 1) * n // {RANKS} - r * n // {RANKS} AS n FROM range({RANKS}) t(r), (SELECT count(*) AS n FROM orders)")
def balance_floor(spark, sf_dir):
    return _balanced(spark, sf_dir, "floor")


@query(f"SELECT r AS rank, ((r + 1) * n + {RANKS - 1}) // {RANKS} - (r * n + {RANKS - 1}) // {RANKS} AS n FROM range({RANKS}) t(r), (SELECT count(*) AS n FROM orders)")
def balance_ceil(spark, sf_dir):
    return _balanced(spark, sf_dir, "ceil")


_LAID_OUT = (
    f"WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders), "
    f"r AS (SELECT *, ((pos + 1) * {RANKS} - 1) // n AS rank FROM p) SELECT o_orderkey, CAST(rank AS INTEGER) AS rank, pos - rank * n // {RANKS} AS place FROM r"
)


def _laid_out(spark, sf_dir, sort):
    """Where each row lies: the partition itself and the place in it."""
    df = load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    laid = sort(df, ["o_totalprice", "o_orderkey"], RANKS).withColumn("rank", F.spark_partition_id())
    return _place_in(laid, "rank", "place").select("o_orderkey", "rank", "place")


@query(_LAID_OUT)
def samplesort(spark, sf_dir):
    return _laid_out(spark, sf_dir, partition.samplesort)


@query(_LAID_OUT)
def quickselect_sort(spark, sf_dir):
    return _laid_out(spark, sf_dir, partition.quickselect_sort)


@query("SELECT o_orderkey & 63 AS bucket, count(*) AS n FROM orders GROUP BY 1")
def bucket_route(spark, sf_dir):
    routed = permute.route_buckets(load(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), 64)
    return partition.partition_sizes(routed.withColumn("bucket", F.col("bucket").cast("long")), "bucket")


def _padded(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey")
    buckets = permute.bucket_count(df.count(), RANKS)
    return permute.pad_buckets(permute.route_buckets(df, F.col("o_orderkey"), buckets), buckets), buckets


_BUCKETS = "greatest(2 * CAST(pow(2, ceil(log2(n))) AS BIGINT) // 512, 14)"


@query(
    f"WITH b AS (SELECT {_BUCKETS} AS b FROM (SELECT count(*) AS n FROM orders)), r AS (SELECT CAST(range AS INTEGER) AS bucket FROM range((SELECT b FROM b))), "
    "c AS (SELECT CAST(o_orderkey & (b - 1) AS INTEGER) AS bucket, count(*) AS n FROM orders, b GROUP BY 1) "
    "SELECT bucket, CAST(coalesce(n, 0) AS BIGINT) AS n_real, CAST(512 - coalesce(n, 0) AS BIGINT) AS n_dummy FROM r LEFT JOIN c USING (bucket)"
)
def bucket_pad(spark, sf_dir):
    padded, _ = _padded(spark, sf_dir)
    dummy = F.col("is_dummy").cast("long")
    return padded.groupBy("bucket").agg(F.sum(1 - dummy).alias("n_real"), F.sum(dummy).alias("n_dummy"))


@query("SELECT o_orderkey FROM orders")
def drop_padding(spark, sf_dir):
    padded, _ = _padded(spark, sf_dir)
    return permute.drop_padding(padded).select("o_orderkey")


def _rid(seed):
    """SQL of the random-looking id of an order."""
    return f"CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|{seed}'), 1, 15) AS BIGINT)"


@query(f"SELECT o_orderkey, CAST(o_orderkey & (b - 1) AS INTEGER) AS bucket, row_number() OVER (PARTITION BY o_orderkey & (b - 1) ORDER BY {_rid(11)}) - 1 AS place FROM orders, (SELECT {_BUCKETS} AS b FROM (SELECT count(*) AS n FROM orders))")
def bucket_permute(spark, sf_dir):
    padded, _ = _padded(spark, sf_dir)
    tagged = permute.assign_ids(padded, ["o_orderkey"], method="md5")
    return _place_in(permute.permute_buckets(tagged, RANKS), "bucket", "place").select("o_orderkey", "bucket", "place")


@query(f"SELECT bucket % {RANKS} AS rank, count(*) AS n_buckets FROM (SELECT DISTINCT o_orderkey & 63 AS bucket FROM orders) GROUP BY 1")
def hash_distribute(spark, sf_dir):
    buckets = load(spark, sf_dir, "orders").select(F.col("o_orderkey").bitwiseAND(F.lit(63).cast("long")).alias("bucket")).distinct()
    return partition.hash_distribute(buckets, F.col("bucket"), RANKS).groupBy("rank").agg(F.count(F.lit(1)).alias("n_buckets"))


# Blocks of any number of rows: rank r begins at ceil(r n / ranks); j is the place in it, m its rows.
_BLOCKS = (
    f"WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders), r AS (SELECT *, pos * {RANKS} // n AS rank FROM p), "
    f"q AS (SELECT pos, rank, pos - (rank * n + {RANKS - 1}) // {RANKS} AS j, ((rank + 1) * n + {RANKS - 1}) // {RANKS} - (rank * n + {RANKS - 1}) // {RANKS} AS m FROM r)"
)


def _positions(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey")
    return ordering.with_position(df, ["o_orderkey"]).select("pos"), RANKS, df.count()


@query(f"{_BLOCKS} SELECT pos, j % {RANKS} AS dest FROM q")
def transpose(spark, sf_dir):
    return partition.transpose(*_positions(spark, sf_dir))


@query(f"{_BLOCKS} SELECT pos, j * {RANKS} // m AS dest FROM q")
def transpose_inverse(spark, sf_dir):
    return partition.transpose(*_positions(spark, sf_dir), inverse=True)


@query(f"{_BLOCKS} SELECT pos, CASE WHEN j < m - m // 2 THEN rank ELSE (rank + 1) % {RANKS} END AS dest FROM q")
def half_shift(spark, sf_dir):
    return partition.half_shift(*_positions(spark, sf_dir))


@query(f"{_BLOCKS} SELECT pos, CASE WHEN j < m // 2 THEN (rank + {RANKS - 1}) % {RANKS} ELSE rank END AS dest FROM q")
def half_unshift(spark, sf_dir):
    return partition.half_shift(*_positions(spark, sf_dir), inverse=True)


@query(
    "WITH p AS (SELECT o_totalprice AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) "
    "SELECT a.pos, CASE WHEN b.pos IS NULL THEN a.key WHEN a.pos & 4 = 0 THEN least(a.key, b.key) ELSE greatest(a.key, b.key) END AS key FROM p a LEFT JOIN p b ON b.pos = xor(a.pos, 4)"
)
def compare_exchange(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("key"))
    return partition.compare_exchange(ordering.with_position(df, ["o_orderkey"]).select("pos", "key"), 4)


# Scans


@query("SELECT event_id, CAST(coalesce(sum(CAST(event_type = 'purchase' AS INTEGER)) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prefix FROM events")
def running_count(spark, sf_dir):
    df = load(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return scan.running_count(df, F.col("event_type") == "purchase", ["ts", "event_id"]).select("event_id", "prefix")


@query("SELECT event_id, event_type = 'purchase' AS marked, row_number() OVER (ORDER BY event_type <> 'purchase', ts, event_id) - 1 AS new_pos FROM events")
def compact(spark, sf_dir):
    df = load(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_type") == "purchase").alias("marked"))
    return scan.compact(df, F.col("marked"), ["ts", "event_id"]).select("event_id", "marked", "new_pos")


_CARRY = "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER ({}ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM events"


def _purchases(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase"))


@query(_CARRY.format("PARTITION BY user_id "))
def carry_forward(spark, sf_dir):
    return scan.carry_forward(_purchases(spark, sf_dir), F.col("purchase"), ["ts", "event_id"], ["user_id"]).select("event_id", "carried")


@query(_CARRY.format(""))
def carry_forward_global(spark, sf_dir):
    return scan.carry_forward(_purchases(spark, sf_dir), F.col("purchase"), ["ts", "event_id"]).select("event_id", "carried")


@query("SELECT p_partkey, (SELECT count(*) FROM orders WHERE o_totalprice < p_retailprice * 100) AS idx FROM part")
def lower_bound(spark, sf_dir):
    probes = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("probe"))
    return scan.lower_bound(probes, "probe", load(spark, sf_dir, "orders").select("o_totalprice"), "o_totalprice").select("p_partkey", "idx")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate) AS copy FROM lineitem")
def first_seen(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return scan.first_seen(df, ["l_orderkey", "l_linenumber"], ["l_shipdate"]).drop("l_shipdate")


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_seen_distinct(spark, sf_dir):
    return first_seen_stream(load(spark, sf_dir, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts").select("user_id", "event_type")


# Verification, sampling, sources


@query("SELECT CAST(0 AS BIGINT) AS violations")
def verify_sorted(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select(*LINE_KEYS)
    return verify.order_violations(ordering.with_position(df, LINE_KEYS), LINE_KEYS, block=4096)


@query("SELECT CAST(count(*) AS BIGINT) AS violations FROM (SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS before FROM orders) WHERE o_totalprice < before")
def verify_unsorted(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return verify.order_violations(ordering.with_position(df, ["o_orderkey"]), ["o_totalprice"], block=1000)


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_rid(19)}, o_orderkey) <= count(*) OVER () // 2 AS marked FROM orders")
def mark_exact(spark, sf_dir):
    return permute.mark_exact(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], method="md5")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_rid(13)}, o_orderkey) - 1 AS pos FROM orders")
def random_permutation(spark, sf_dir):
    return permute.random_permutation(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], method="md5")


@query(f"SELECT o_orderkey, {_rid(11)} AS rid FROM orders")
def assign_ids(spark, sf_dir):
    return permute.assign_ids(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], method="md5")


@query("SELECT range AS request_id, range // 4 * 2 AS key, range // 4 * 10 AS value, true AS has_value FROM range(4000)")
def lookup_fixture(spark, sf_dir):
    requests, data = generate_lookup_fixture(spark, 1000)
    return lookup.lookup_join(requests, data, "key", ["value"])


@query("SELECT range AS id, CAST('0x' || substr(md5(CAST(range AS VARCHAR) || '|1'), 1, 15) AS BIGINT) % 2147483648 AS key FROM range(10000)")
def generate_sort_keys(spark, sf_dir):
    return generate_keys(spark, 10000, key_range=1 << 31, method="md5")


@query(f"SELECT CAST(r AS INTEGER) AS partition, (r + 1) * n // {RANKS} - r * n // {RANKS} AS n FROM range({RANKS}) t(r), (SELECT count(*) AS n FROM orders)")
def partition_metrics(spark, sf_dir):
    """Rows counted partition by partition, of a layout with a known size for each."""
    return rows_by_partition(partition.samplesort(load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], RANKS))


@query("SELECT CAST(1 AS BIGINT) AS exchanges, count(*) AS records, true AS has_bytes FROM lineitem")
def shuffle_metrics(spark, sf_dir):
    """What a range exchange has really written, read off the plan that has run."""
    found = shuffle_stats(partition.range_exchange(load(spark, sf_dir, "lineitem").select(*LINE_KEYS), LINE_KEYS))
    return spark.createDataFrame([(found["exchanges"], found["records"], found["bytes"] > 0)], "exchanges long, records long, has_bytes boolean")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey <= 1 THEN 1 ELSE CAST(pow(2, length(bin(o_orderkey - 1))) AS BIGINT) END AS up, CAST(length(bin(o_orderkey + 1)) - 1 AS INTEGER) AS low, "
    "(o_orderkey + 6) // 7 AS ceiling, CAST(CAST(18446744073709551616 AS HUGEINT) - o_orderkey - 1 AS VARCHAR) AS flipped, CAST(sign(o_orderkey - 500) AS INTEGER) AS side FROM orders"
)
def integer_helpers(spark, sf_dir):
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", next_pow2(k).alias("up"), log2_floor(k + 1).alias("low"), ceil_div(k, F.lit(7).cast("long")).alias("ceiling"), unsigned(-k - 1).cast("string").alias("flipped"), compare(k, F.lit(500)).alias("side"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CAST(CASE WHEN v < 0 THEN v + CAST(18446744073709551616 AS HUGEINT) ELSE v END AS DECIMAL(20, 0))) - 1 AS pos FROM (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS HUGEINT) AS v FROM orders)")
def unsigned_order(spark, sf_dir):
    k = F.col("o_orderkey")
    df = load(spark, sf_dir, "orders").select("o_orderkey", unsigned(F.when(k % 2 == 0, -k - 1).otherwise(k)).alias("key"))
    return ordering.with_position(df, ["key"]).select("o_orderkey", "pos")
