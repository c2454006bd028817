"""Helpers for large groups: equal to plain windows, also with one dominant key."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assetlake.operators import skew as S
from assetlake.operators import windows as Q


@pytest.fixture()
def wide(spark):
    """Small range partitions, so keys really span several of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def hot_rows(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.5 else None if r.random() < 0.1 else f"k{r.randrange(40)}", r.randrange(10**6), i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, id long").repartition(7)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_number_rows(wide, by):
    df = hot_rows(wide)
    got = {r.id: r.seq for r in S.number_rows(df, ["t", "id"], by).collect()}
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy("t", "id")
    want = {r.id: r.seq for r in df.withColumn("seq", F.row_number().over(w)).collect()}
    assert got == want


def test_number_rows_spans_partitions(wide):
    df = hot_rows(wide).filter("k = 'hot'")
    ranged = df.repartitionByRange("k", "t", "id")
    assert ranged.rdd.getNumPartitions() > 1


def test_running_total_and_carry(spark):
    df = hot_rows(spark).withColumns({"b": F.floor(F.col("t") / 50000), "v": F.when(F.col("id") % 3 == 0, F.col("id"))})
    w = W.partitionBy("k").orderBy("t", "id")
    want = {r.id: (r.a, r.b2) for r in df.withColumn("a", F.sum("id").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "b2", F.last("v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).collect()}
    out = S.carry_forward(S.running_total(df, ["k"], "b", ["t", "id"], "id", "a"), ["k"], "b", ["t", "id"], "v", "b2")
    got = {r.id: (r.a, r.b2) for r in out.collect()}
    assert got == want


def test_member_lists_keep_all_members(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("k").alias("k"), F.format_string("/p/%d", "id").alias("v"))
    rows = S.member_lists(df, "k", "v", part_rows=100).collect()
    hot = [r for r in rows if r.k == "hot"]
    assert len(hot) == 9 and max(len(r.members) for r in rows) < 200
    assert sorted(m for r in hot for m in r.members) == sorted(f"/p/{i}" for i in range(900))
    small = S.member_lists(df, "k", "v").collect()
    assert all(r.part == 0 and r.parts == 1 and r.members == sorted(r.members) for r in small)


def test_heavy_key_is_split(spark):
    """The join back of a dominant key runs as a skew join in the final plan."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(60000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        keys = df.groupBy("k").agg(F.count("*").alias("n"))
        out = S.attach(df, keys, ["k"])
        out.write.format("noop").mode("overwrite").save()
        assert out.filter("k = -1").count() == 20000
        joined = S.attach(df, keys, ["k"])
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_best_per_key(spark):
    df = hot_rows(spark)
    got = {r.k: r.id for r in S.best_per_key(df, ["k"], ["t", "id"], ["id"]).collect()}
    w = W.partitionBy("k").orderBy("t", "id")
    want = {r.k: r.id for r in df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").collect()}
    assert got == want


def test_last_n_cuts_before_the_shuffle(spark):
    df = hot_rows(spark)
    out = Q.last_n(df, "k", ["t", "id"], 5)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("k = 'hot'").count() == 5


def test_last_n_beyond_the_limit(wide):
    df = hot_rows(wide)
    got = {r.id for r in Q.last_n(df, "k", ["t", "id"], 1200).collect()}
    w = W.partitionBy("k").orderBy(F.desc("t"), F.desc("id"))
    assert got == {r.id for r in df.withColumn("rn", F.row_number().over(w)).filter("rn <= 1200").collect()}


def test_bursts_match_plain_windows(spark):
    """Long chains over midnight, many files in one second, a missing camera, missing times."""
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), 86400 * r.randrange(3) + r.choice([86390 + r.randrange(10), r.randrange(15), 40000 + r.randrange(3000)]), i) for i in range(1500)]
    rows += [("a", 50000, 2000 + i) for i in range(700)] + [("a", None, 9999)]
    df = spark.createDataFrame(rows, "cam string, s long, id long").withColumn("t", F.timestamp_seconds("s"))
    w = W.partitionBy("cam").orderBy("s", "id")
    runs = df.filter("s is not null").withColumn("new", F.when(F.col("s") - F.lag("s").over(w) <= 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    size = F.count("*").over(W.partitionBy("cam", "run"))
    real = runs.withColumn("n", size).filter("n >= 3").withColumn("idx", F.dense_rank().over(W.partitionBy("cam").orderBy("run")))
    want = {x.id: (x.idx, x.n) for x in real.collect()}
    out = Q.bursts(df, "t", "cam").collect()
    assert len(out) == len(rows)
    assert {x.id: (x.burst_index, x.burst_size) for x in out if x.burst_index is not None} == want


def test_bursts(spark):
    rows = [("c", s, f"p{i}") for i, s in enumerate([10, 10, 10, 11, 13, 86399, 86400, 86401, 86500])]
    df = spark.createDataFrame(rows, "cam string, s long, path string").withColumn("t", F.timestamp_seconds("s"))
    got = {r.path: (r.burst_index, r.burst_size) for r in Q.bursts(df, "t", "cam").collect()}
    assert [got[f"p{i}"] for i in range(9)] == [(1, 4)] * 4 + [(None, None)] + [(2, 3)] * 3 + [(None, None)]


def test_hysteresis_example(spark):
    temps = [54.0, 55.0, 50.0, 45.0, 46.0]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(temps)], "drive string, event_id long, temperature double").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") * 1800))
    got = [(r.event_id, r.event) for r in Q.thermal_events(df).orderBy("event_id").collect()]
    assert got == [(1, "THERMAL_PAUSE"), (3, "THERMAL_RESUME")]


def test_retention_and_growth(spark):
    df = spark.range(120).select(F.lit("s").alias("src"), F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id as int))").alias("ts"))
    kept = Q.keep_backups(df, "src", "ts").collect()
    assert sum("day" in r.kept_as for r in kept) == 7
    assert sum("week" in r.kept_as for r in kept) == 4
    assert sum("month" in r.kept_as for r in kept) == 4
