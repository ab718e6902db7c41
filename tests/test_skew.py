import random
import statistics

from plain_rows import rows
from pyspark.sql import functions as F

from dqspark.functions.scalars import cumulate, medians
from dqspark.functions.skew import lookup_join, mark, product


def _skewed(spark, n=400):
    rng = random.Random(1)
    data = [(1 if i % 3 == 0 else (None if i % 10 == 0 else rng.randrange(40)), i) for i in range(n)]
    return spark.createDataFrame(data, "k int, v int")


def _lookup(spark):
    return spark.createDataFrame([(k, f"n{k}") for k in range(0, 30)] + [(1, "again"), (None, "x")],
                                 "k int, name string")


def test_join_keeps_column_order_on_every_path(spark):
    left, right = _skewed(spark).select("v", "k"), _lookup(spark)
    for limit in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for how in ("left", "inner", "left_semi", "left_anti"):
            got = lookup_join(left, right, ["k"], how)
            want = left.join(right, ["k"], how).select(*got.columns)
            assert got.columns[:2] == ["v", "k"] and rows(got) == rows(want), how
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mark(spark):
    left = _skewed(spark)
    keys = left.filter("k is not null").select("k").distinct().filter("k < 5").withColumn("low", F.lit(True))
    want = rows(left.withColumn("low", F.coalesce(F.col("k") < 5, F.lit(False))))
    assert rows(mark(left, keys, ["k"], ["low"])) == want


def test_equal_values_are_dealt_over_tasks(spark):
    df = spark.range(4000).select(F.lit("a").alias("p"), F.lit(0.5).alias("t"), F.lit(1).alias("v"))
    got = cumulate(df, ["p"], ["t"], sums={"s": "v"})
    assert sorted(r["s"] for r in got.collect()) == list(range(1, 4001))
    stored = spark.read.parquet(got.inputFiles()[0].rpartition("/")[0])
    sizes = [r["count"] for r in stored.groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1500


def test_running_sums_leave_null_values_to_the_totals(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, None, 7), (None, 2, 1), ("x", 1, 3)], "p string, t int, v int")
    got = sorted(((r["p"], r["t"], r["s"], r["s_total"]) for r in cumulate(df, ["p"], ["t"], sums={"s": "v"}).collect()), key=str)
    assert got == sorted([(None, 1, 5, 13), (None, 2, 6, 13), ("x", 1, 3, 3)], key=str)


def test_cumulate_equals_running_sum(spark):
    rng = random.Random(3)
    data = [(p, rng.randrange(-500, 5000), rng.randrange(9)) for p in "ab" for _ in range(150)]
    data = list({(p, t): (p, t, v) for p, t, v in data}.values())
    df = spark.createDataFrame(data, "p string, t int, v int")
    got = cumulate(df, ["p"], ["t"], sums={"s": "v"}, maxima={"m": "v"})
    want = []
    for p in "ab":
        run, top = 0, None
        mine = sorted(d for d in data if d[0] == p)
        total = sum(d[2] for d in mine)
        for _, t, v in mine:
            run, top = run + v, v if top is None else max(top, v)
            want.append((p, t, v, run, total, top))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_medians_match_statistics(spark):
    rng = random.Random(5)
    data = [(k, rng.random() * 10 ** rng.randrange(6)) for k in "abc" for _ in range(25 + ord(k) % 2)]
    got = dict(map(tuple, medians(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()))
    for k in "abc":
        assert abs(got[k] - statistics.median(v for x, v in data if x == k)) < 1e-9


def test_product_both_ways(spark):
    big, few = _skewed(spark, 30), _lookup(spark).select("name")
    want = rows(big.crossJoin(few))
    assert rows(product(big, few)) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(product(big, few)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pool_picks_take_turns_in_one_plan(spark):
    import hashlib

    from dqspark.operators.targets import take_from_pool
    keys = [3, 1, 4, 15, 9, 26]
    pool = spark.createDataFrame([(k,) for k in keys], "k int")
    salts = [f"s{i}" for i in range(8)]
    left, want = set(keys), []
    for s in salts:
        if left:
            pick = min(left, key=lambda k: (hashlib.sha256(f"{s}|{k}".encode()).hexdigest(), k))
            left.remove(pick)
            want.append((s, pick))
    assert rows(take_from_pool(pool, "k", salts)) == want

    def size(n):
        return len(take_from_pool(pool, "k", salts[:n])._jdf.queryExecution().optimizedPlan().toString())
    assert size(8) <= 4 * size(2)
