import random

from pyspark.sql import functions as F

from tidemark.operators import joins, windows
from tidemark.streaming import runner


def test_asof_against_every_pair(spark):
    """A hot key over many spans, spans without values, null keys, times and values, equal times."""
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    at = lambda: None if rng.random() < 0.05 else rng.randrange(0, 400_000, 50)
    asks = [(i, key(), at()) for i in range(600)]
    told = [(key(), at(), rng.choice([None, *range(20)])) for _ in range(150)]
    left = spark.createDataFrame(asks, "id int, k string, s long").selectExpr("id", "k", "timestamp_seconds(s) as ts")
    right = spark.createDataFrame(told, "k string, s long, v int").selectExpr("k", "timestamp_seconds(s) as at", "v")

    def want(k, t):
        found = [(s, v) for x, s, v in told if None not in (k, t, x, s, v) and x == k and s <= t]
        return max(found)[1] if found else None

    for hours in (None, 1, 24, 100_000):
        got = {r.id: r.v for r in joins.asof_join(left, right, "k", "ts", "at", "v", hours).collect()}
        assert got == {i: want(k, t) for i, k, t in asks}
    assert joins.asof_join(left, right.limit(0), "k", "ts", "at", "v", 1).where("v is null").count() == 600


def test_windowed_join_waits_for_the_slower_input(spark, tmp_path):
    """A window of two streams closes by the watermark of the one that is behind; rows that come after that are late and match nothing."""
    a = [["00:01:00", "00:02:00"], ["03:00:00"], ["00:06:00"], ["03:01:00"], ["00:08:00"], ["06:00:00"]]  # 00:06 is late by its own stream only, 00:08 by both
    b = [["00:03:00"], ["00:05:00"], ["03:00:00"], ["03:01:00"], ["00:09:00"], ["06:00:00"]]
    sides = []
    for name, files in (("a", a), ("b", b)):
        path = str(tmp_path / name)
        for times in files:  # a batch reads a file of each
            spark.createDataFrame([(1, f"2024-01-01 {t}") for t in times], "k int, ts string").selectExpr("k", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(path)
        s = runner.with_event_time(runner.read_files(spark, path, "k int, ts timestamp"), "ts", "1 minute")
        sides.append(windows.window_agg(s, windows.tumble("ts", "10 minutes"), ["k"], F.count("*").alias(f"n_{name}")))
    runner.run_to_end(joins.window_join(*sides, ["k"]), str(tmp_path / "cp"), runner.to_table(str(tmp_path / "out")))
    got = sorted((str(r.window.start)[11:16], r.n_a, r.n_b) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("00:00", 3, 2), ("03:00", 2, 2)]
