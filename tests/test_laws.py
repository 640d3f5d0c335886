"""Properties and edge inputs of the engine's operators."""

import random

import pytest
from pyspark.sql import functions as F

from ordina.functions import integers
from ordina.operators import lookup, ordering, partition, permute, ranges, scan, verify
from ordina.plans.metrics import exchanges, shuffle_stats
from ordina.sources.tables import generate_keys, generate_lookup_fixture
from ordina.streaming.duplicates import first_seen_stream

SIZES = {"empty": [], "one": [5], "seven": [3, 1, 2, 7, 6, 5, 4], "equal": [9] * 300, "two": [1, 0] * 200, "nulls": [None, 3, None, 1, 2], "reversed": list(range(600, 0, -1))}


def frame(spark, keys):
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, key long")


def expected(keys):
    return sorted(keys, key=lambda k: (k is not None, k or 0))


@pytest.mark.parametrize("name", SIZES)
@pytest.mark.parametrize("strategy", ordering.STRATEGIES)
def test_sorts_agree(spark, name, strategy):
    got = [r["key"] for r in ordering.sort_global(frame(spark, SIZES[name]), ["key", "id"], strategy).collect()]
    assert got == expected(SIZES[name])


@pytest.mark.parametrize("name", SIZES)
def test_positions(spark, name):
    found = ordering.with_position(frame(spark, SIZES[name]), ["key"]).orderBy("pos").collect()
    assert [r["pos"] for r in found] == list(range(len(SIZES[name])))
    assert [r["key"] for r in found] == expected(SIZES[name])
    verify.assert_permutation(spark.createDataFrame([(r["id"], r["key"]) for r in found], "id long, key long"), frame(spark, SIZES[name]))


def test_equal_keys_fill_many_partitions(spark):
    df = frame(spark, [1] * 4000)
    spread = partition.range_exchange(df, ["key"], 8).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) == 8
    verify.assert_physically_sorted(partition.range_exchange(df, ["key"], 8), ["key"])


def test_position_shuffles_rows_once(spark):
    df = ordering.with_position(frame(spark, list(range(100))), ["key"])
    assert exchanges(df) <= 4  # rows, counts and the sizes of the buckets before


@pytest.mark.parametrize("convention", ["floor", "ceil"])
@pytest.mark.parametrize(("n", "parts"), [(0, 3), (2, 7), (600, 7), (601, 4)])
def test_blocks(spark, n, parts, convention):
    ranked = partition.balance(frame(spark, list(range(n))), ["key"], parts, convention)
    verify.assert_partition_law(ranked, parts, convention)
    sizes = {r["rank"]: r["n"] for r in partition.partition_sizes(ranked, "rank").collect()}
    edge = (lambda r: r * n // parts) if convention == "floor" else (lambda r: -(-r * n // parts))
    assert sizes == {r: edge(r + 1) - edge(r) for r in range(parts) if edge(r + 1) > edge(r)}


def test_verifiers_raise(spark):
    ok = ordering.with_position(frame(spark, list(range(50))), ["key"])
    verify.assert_sorted(ok, ["key"])
    bad = ok.withColumn("key", F.when(F.col("pos") == 20, 0).otherwise(F.col("key")))
    with pytest.raises(verify.LawBroken):
        verify.assert_sorted(bad, ["key"])
    assert verify.order_violations(bad, ["key"], block=20).first()["violations"] == 1  # across a border
    with pytest.raises(verify.LawBroken):
        verify.assert_permutation(bad, ok)
    with pytest.raises(verify.LawBroken):
        verify.assert_partition_law(ok.withColumn("rank", F.lit(0)), 4)
    for odd in (frame(spark, [3, 2, 1, 0] * 50).repartition(4, "id"), frame(spark, [1, 3, 2]).coalesce(1)):
        with pytest.raises(verify.LawBroken):
            verify.assert_physically_sorted(odd, ["key"])


@pytest.mark.parametrize("plan", ["join", "scan"])
def test_lookup(spark, plan):
    requests = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12), (5, None)], "id long, k long")
    data = spark.createDataFrame([(10, 1, "a"), (10, 2, "b"), (11, 1, None), (99, 1, "z"), (None, 1, "n")], "k long, t long, v string")
    got = sorted((r["id"], r["v"], r["has_value"]) for r in lookup.lookup_join(requests, data, "k", ["v"], ["t"], plan).collect())
    assert got == [(1, "b", True), (2, "b", True), (3, None, True), (4, None, False), (5, None, False)]


def test_lookup_plans_agree_at_random(spark):
    draw = random.Random(4)
    requests = spark.createDataFrame([(i, draw.randrange(40)) for i in range(300)], "id long, k long")
    data = spark.createDataFrame([(draw.randrange(60), draw.randrange(5), i) for i in range(200)], "k long, t long, v long")
    one, two = (lookup.lookup_join(requests, data, "k", ["v"], ["t"], p) for p in ("join", "scan"))
    verify.assert_permutation(one, two)
    assert one.count() == 300


def test_fixture(spark):
    requests, data = generate_lookup_fixture(spark, 50)
    assert lookup.lookup_join(requests, data, "key", ["value"]).where("has_value").count() == 200
    assert generate_keys(spark, 100, payload_bytes=16).repartition(3).exceptAll(generate_keys(spark, 100, payload_bytes=16)).count() == 0


@pytest.mark.parametrize(("rows", "fails"), [(512, False), (513, True)])
def test_capacity(spark, rows, fails):
    df = permute.route_buckets(spark.range(rows).select((F.col("id") * 4).alias("id")), F.col("id"), 4)
    padded = permute.pad_buckets(df, 4)
    if fails:
        with pytest.raises(Exception, match="overfull"):
            padded.count()
    else:
        assert padded.count() == 4 * 512 and permute.drop_padding(padded).count() == 512


def test_exact_marks_and_permutations(spark):
    df = spark.range(101).repartition(5)
    assert permute.mark_exact(df, ["id"]).where("marked").count() == 50
    one = permute.random_permutation(df, ["id"]).orderBy("id").collect()
    two = permute.random_permutation(df.repartition(2), ["id"]).orderBy("id").collect()
    assert one == two and sorted(r["pos"] for r in one) == list(range(101)) and [r["pos"] for r in one] != list(range(101))


def test_scans(spark):
    values = [None, 4, None, None, 7, None, 1]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    carried = [r["carried"] for r in scan.carry_forward(df, F.col("v"), ["id"]).orderBy("id").collect()]
    assert carried == [None, None, 4, 4, 4, 7, 7]
    counted = [r["prefix"] for r in scan.running_count(df, F.col("v").isNotNull(), ["id"], inclusive=True).orderBy("id").collect()]
    assert counted == [0, 1, 1, 1, 2, 2, 3]
    moved = [r["id"] for r in scan.compact(df, F.col("v").isNotNull(), ["id"]).orderBy("new_pos").collect()]
    assert moved == [1, 4, 6, 0, 2, 3, 5]
    bounds = scan.lower_bound(spark.createDataFrame([(0,), (4,), (5,), (9,)], "p long"), "p", df, "v").orderBy("p").collect()
    assert [r["idx"] for r in bounds] == [0, 1, 2, 3]


@pytest.mark.parametrize(("parts", "total"), [(4, 32), (7, 45), (5, 3), (3, 0)])
def test_blocks_of_any_number_of_rows_move(spark, parts, total):
    df = spark.range(total).select(F.col("id").alias("pos"))
    starts = [-(-r * total // parts) for r in range(parts + 1)]
    for inverse in (False, True):
        moved = {r["pos"]: r["dest"] for r in partition.transpose(df, parts, total, inverse).collect()}
        shifted = {r["pos"]: r["dest"] for r in partition.half_shift(df, parts, total, inverse).collect()}
        assert len(moved) == len(shifted) == total
        for r in range(parts):
            n = starts[r + 1] - starts[r]
            for j in range(n):
                assert moved[starts[r] + j] == (j * parts // n if inverse else j % parts)
                second = j < n // 2 if inverse else j >= n - n // 2
                assert shifted[starts[r] + j] == (r + (second and (-1 if inverse else 1))) % parts


@pytest.mark.parametrize("sort", [partition.samplesort, partition.quickselect_sort])
@pytest.mark.parametrize(("n", "parts"), [(0, 3), (2, 7), (601, 4), (50, 1)])
def test_layouts(spark, sort, n, parts):
    draw = random.Random(n)
    df = spark.createDataFrame([(i, draw.randrange(10)) for i in range(n)], "id long, _rank long").repartition(3)
    laid = sort(df, ["_rank"], parts)
    assert laid.columns == ["id", "_rank"]
    if not n:  # Spark keeps no layout of nothing
        assert laid.count() == 0
        return
    assert laid.rdd.getNumPartitions() == parts
    found = [[r["_rank"] for r in part] for part in laid.rdd.glom().collect()]
    assert [len(p) for p in found] == [(r + 1) * n // parts - r * n // parts for r in range(parts)]
    assert [k for p in found for k in p] == sorted(k for p in found for k in p)
    verify.assert_permutation(laid, df)


def test_runs(spark):
    df = frame(spark, [5, 1, 4, 2, 3, 3])
    runs = [df.where(c).coalesce(1).sortWithinPartitions("key") for c in ("id < 3", "id >= 3")]
    assert [r["key"] for r in ordering.merge_runs(runs, ["key"]).orderBy("pos").collect()] == [1, 2, 3, 3, 4, 5]
    with pytest.raises(verify.LawBroken):
        ordering.merge_runs([runs[0], df.where("id >= 2").coalesce(1).orderBy(F.desc("key"))], ["key"])


@pytest.mark.parametrize("strategy", ordering.STRATEGIES)
def test_descending(spark, strategy):
    df = frame(spark, SIZES["nulls"])
    assert [r["key"] for r in ordering.sort_global(df, ["key", "id"], strategy, descending=True).collect()] == expected(SIZES["nulls"])[::-1]
    assert [r["key"] for r in ordering.with_position(df, ["key", "id"], descending=True).orderBy("pos").collect()] == expected(SIZES["nulls"])[::-1]


def test_order_statistics(spark):
    keys = [7] * 200 + list(range(100))
    got = {r["target"]: r["key"] for r in ordering.order_statistics(frame(spark, keys), ["key"], [0, 150, 299, 300, -1]).collect()}
    assert got == {i: sorted(keys)[i] for i in (0, 150, 299)}
    assert ordering.order_statistics(frame(spark, []), ["key"], [0]).count() == 0


HELPERS = "_tie _pos _bucket _n _start _total _nth _group _col _i _row _pad _at _one _inside _value _last _entering _rid _draw _pair _size _rank _part _free _hit _key _k _side _THE".split()


def test_helper_columns_clash_with_none(spark):
    """Every operator returns the user's columns as they were, whatever their names."""
    schema = ", ".join(["id long", "key long", *(f"`{n}` string" for n in HELPERS)])
    df = spark.createDataFrame([(i, i % 3, *[f"{n}{i}" for n in HELPERS]) for i in range(20)], schema)
    user = df.columns
    results = [
        ordering.with_position(df, ["key"], "p"), ordering.columnsort_position(df, ["key", "id"], "p"),
        *(ordering.sort_global(df, ["key", "id"], s) for s in ordering.STRATEGIES),
        partition.range_exchange(df, ["key"], 4), partition.samplesort(df, ["key"], 3), partition.quickselect_sort(df, ["key"], 3),
        partition.balance(df, ["key"], 3, name="p"), partition.compare_exchange(df, 4, "id", "id"),
        scan.running_count(df, F.col("key") == 1, ["id"], "p"), scan.carry_forward(df, F.col("key"), ["id"], name="p"),
        scan.compact(df, F.col("key") == 1, ["id"], "p"), scan.lower_bound(df, "id", df, "key", "p"),
        permute.random_permutation(df, ["id"], name="p"), permute.mark_exact(df, ["id"], name="p"),
        permute.drop_padding(permute.pad_buckets(permute.route_buckets(df, F.col("id"), 4, "b"), 4, 64, "b")),
        *(lookup.lookup_join(df, df.select("id", F.col("_n").alias("v")), "id", ["v"], plan=p) for p in ("join", "scan")),
    ]
    for out in results:
        verify.assert_permutation(out.select(*user), df)
    for plan in ("join", "scan"):
        with pytest.raises(ValueError, match="already"):
            lookup.lookup_join(df, df, "id", ["_n"], plan=plan)


def test_shuffle_stats(spark):
    df = frame(spark, list(range(500)))
    assert shuffle_stats(df) == {"exchanges": 0, "records": 0, "bytes": 0}
    found = shuffle_stats(df.repartition(3, "key"))
    assert (found["exchanges"], found["records"]) == (1, 500) and found["bytes"] > 0


def test_draws(spark):
    df = spark.range(50)
    for method in ("xxhash64", "md5"):
        ids = [r["rid"] for r in permute.assign_ids(df, ["id"], method=method).collect()]
        assert len(set(ids)) == 50
    with pytest.raises(ValueError):
        permute.assign_ids(df, ["id"], method="other")


def test_unsigned_extremes(spark):
    df = spark.createDataFrame([(0,), (2**63 - 1,), (-(2**63),), (-1,)], "x long").select(integers.unsigned(F.col("x")).alias("u"))
    assert [int(r["u"]) for r in df.orderBy("u").collect()] == [0, 2**63 - 1, 2**63, 2**64 - 1]
    small = spark.createDataFrame([(0, 3), (1, 3), (7, 7), (8, 7), (-7, 2)], "a long, b long")
    got = small.select(integers.next_pow2(F.col("a")).alias("p"), integers.ceil_div(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r["p"], r["c"]) for r in got] == [(1, 0), (1, 1), (8, 1), (8, 2), (1, -3)]


def test_stream_of_repeats(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (1, 1, "2024-01-01 00:01:00"), (1, 2, "2024-01-01 00:02:00")], "sender long, counter long, ts string")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sender long, counter long, ts timestamp").parquet(str(tmp_path / "in"))
    out = first_seen_stream(stream, ["sender", "counter"], "ts")
    run = out.writeStream.format("memory").queryName("repeats").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("repeats").count() == 2


@pytest.mark.parametrize("cuts", [1, 2, 3, 7, 8, 20])
def test_many_splitters_find_the_same_buckets(spark, monkeypatch, cuts):
    rows = spark.createDataFrame([(k, n) for k in [None, *range(-1, 22)] for n in (None, "a", "b")], "k long, n string")
    splitters = [(None, "a"), *((k, random.Random(k).choice([None, "a", "b"])) for k in range(cuts - 1))]
    nested = ranges.range_bucket(rows, ["k", "n"], splitters)
    monkeypatch.setattr(ranges, "MOST_NESTED", 0)
    found = rows.select(nested.alias("nested"), ranges.range_bucket(rows, ["k", "n"], splitters).alias("folded")).collect()
    assert [r["nested"] for r in found] == [r["folded"] for r in found]
    assert {r["nested"] for r in found} == set(range(cuts + 1))
