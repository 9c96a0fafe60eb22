"""Updating aggregates of streams: replaying their changelogs gives what the batch engine gives."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import debezium, updating
from tidemark.streaming import runner, stateful

SF = "/root/testdata/sf0.001"
AGGS = {"n": ("count", None), "some": ("count", "v"), "total": ("sum", "v"), "mean": ("avg", "v"), "least": ("min", "v"), "most": ("max", "v"), "kinds": ("count_distinct", "t")}


def rows(df, *drop):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.drop(*drop).collect()), key=str)


def batch(df, keys):
    return df.groupBy(*keys).agg(*[stateful.FUNCTIONS[f](c or "*").alias(n) for n, (f, c) in AGGS.items()])


@pytest.fixture
def inputs(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("if(user_id % 7 = 0, null, user_id) as k", "cast(event_id % 11 as int) as i", "if(event_id % 5 = 0, null, cast(value as decimal(12,2))) as v", "event_type as t")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    return e, runner.read_files(spark, str(tmp_path / "in"), "k long, i int, v decimal(12,2), t string")


def test_append_only_stream_equals_batch(spark, tmp_path, inputs):
    e, s = inputs
    runner.run_to_end(stateful.updating_aggregate(s, ["k"], AGGS), str(tmp_path / "cp"), stateful.to_changelog(str(tmp_path / "out"), ["k"]))
    log = spark.read.parquet(str(tmp_path / "out"))
    assert {r.op for r in log.collect()} == {"c", "u"}
    assert rows(debezium.replay(log, ["k"], "batch")) == rows(batch(e, ["k"]))


def test_aggregate_over_aggregate_equals_batch(spark, tmp_path, inputs):
    """How many keys have how many rows: the outer aggregate lives on the inner one's retractions, also for least and most."""
    e, s = inputs
    inner = stateful.updating_aggregate(s, ["k"], {"n": ("count", None), "total": ("sum", "v")})
    outer = stateful.updating_aggregate(inner, ["n"], {"keys": ("count", None), "least": ("min", "total"), "most": ("max", "total"), "kinds": ("count_distinct", "total"), "sum": ("sum", "total")})
    runner.run_to_end(outer, str(tmp_path / "cp"), stateful.to_changelog(str(tmp_path / "out"), ["n"]))
    log = spark.read.parquet(str(tmp_path / "out"))
    assert "d" in {r.op for r in log.collect()}
    x = e.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    want = x.groupBy("n").agg(F.count("*").alias("keys"), F.min("total").alias("least"), F.max("total").alias("most"), F.count_distinct("total").alias("kinds"), F.sum("total").alias("sum"))
    assert rows(debezium.replay(log, ["n"], "batch")) == rows(want)


def test_global_aggregate_of_a_changelog(spark, tmp_path):
    path = str(tmp_path / "in")
    row = lambda i, v: {"id": i, "v": v}
    for log in ([(None, row(1, 10), "c"), (None, row(2, 5), "r")], [(row(1, 10), row(1, 20), "u"), (row(2, 5), None, "d")], [(row(1, 20), None, "d")]):
        spark.createDataFrame(log, "before struct<id: bigint, v: int>, after struct<id: bigint, v: int>, op string").coalesce(1).write.mode("append").parquet(path)
        s = debezium.unroll(runner.read_files(spark, path, "before struct<id: bigint, v: int>, after struct<id: bigint, v: int>, op string"), ["id"])
        g = stateful.updating_aggregate(s, [], {"n": ("count", None), "most": ("max", "v"), "least": ("min", "v")})
        runner.run_to_end(g.withColumn("one", F.lit(1)), str(tmp_path / "cp"), stateful.to_changelog(str(tmp_path / "out"), ["one"]))
    got = [(r.op, r.before and tuple(r.before)[:3], r.after and tuple(r.after)[:3]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()]
    assert got == [("c", None, (2, 10, 5)), ("u", (2, 10, 5), (1, 20, 20)), ("d", (1, 20, 20), None)]


def test_values_of_a_key_are_read_and_written_with_it():
    """However many values of a key a batch has, the state store is asked once and told once."""
    from pyspark.sql import Row
    from pyspark.sql import types as T

    class Store:
        def __init__(self):
            self.value, self.calls = None, 0

        def getValueState(self, name, schema):  # noqa: N802
            return self

        def getMapState(self, name, key, value):  # noqa: N802
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def __getattr__(self, name):
            raise AssertionError(f"{name}: a call for a value")

    store, kinds = Store(), [T.LongType()] * 3
    p = stateful._Aggregate([("count", "rows"), ("max", "values"), ("count_distinct", "values")], kinds, kinds, ["k", "n", "most", "kinds", "r"], None)
    p.init(store)
    row = lambda v, n: Row(_n=n, _t1=v, _c1=n, _t2=v, _c2=n)
    assert [tuple(r) for r in p.handleInputRows((1,), iter([row(v, 1) for v in range(500)]), None)] == [(1, 500, 499, 500, False)]
    assert [tuple(r) for r in p.handleInputRows((1,), iter([row(499, -1), row(7, 1)]), None)] == [(1, 500, 499, 500, True), (1, 500, 498, 499, False)]
    assert store.calls == 4


@pytest.mark.parametrize("inline", [0, 2, 4096])
def test_few_and_many_values_of_a_key_give_the_same(spark, tmp_path, monkeypatch, inline):
    monkeypatch.setattr(stateful, "INLINE", inline)
    schema = "before struct<id: bigint, k: bigint, v: double>, after struct<id: bigint, k: bigint, v: double>, op string"
    row = lambda i, v: {"id": i, "k": i % 2, "v": v}
    first = [(None, row(i, float("nan") if i in (3, 5) else i / 2), "c") for i in range(9)]
    then = [(row(8, 4.0), row(8, 1.0), "u"), (row(7, 3.5), None, "d"), (row(3, float("nan")), row(3, 2.5), "u")]
    for log in (first, then, [(row(i, v), None, "d") for i, v in ((0, 0.0), (2, 1.0), (4, 2.0), (6, 3.0), (8, 1.0))]):
        spark.createDataFrame(log, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = debezium.unroll(runner.read_files(spark, str(tmp_path / "in"), schema), ["id"])
    a = stateful.updating_aggregate(s, ["k"], {"n": ("count", None), "least": ("min", "v"), "kinds": ("count_distinct", "v")})
    runner.run_to_end(a, str(tmp_path / "cp"), stateful.to_changelog(str(tmp_path / "out"), ["k"]))
    log = [(r.batch, r.op, r.after and tuple(r.after)[:4]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(log, key=str) == [(0, "c", (0, 5, 0.0, 5)), (0, "c", (1, 4, 0.5, 3)), (1, "u", (0, 5, 0.0, 4)), (1, "u", (1, 3, 0.5, 3)), (2, "d", None)]


def test_idle_keys_are_retracted_and_start_anew(spark, tmp_path):
    path, got = str(tmp_path / "in"), []
    for keys in (["a", "b"], ["b"], ["a", "b"]):
        spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).write.mode("append").parquet(path)
        g = stateful.updating_aggregate(runner.read_files(spark, path, "k string"), ["k"], {"n": ("count", None)}, ttl="8 seconds")
        runner.run_to_end(g, str(tmp_path / "cp"), stateful.to_changelog(str(tmp_path / "out"), ["k"]), empty_batches=False)
        time.sleep(9 if len(got) == 0 else 0)
        got.append(keys)
    log = spark.read.parquet(str(tmp_path / "out")).collect()
    a = sorted((r.batch, r.op, r.after and r.after.n) for r in log if (r.after or r.before).k == "a")
    assert [x[1:] for x in a] == [("c", 1), ("d", None), ("c", 1)]


def test_refused_functions(spark):
    with pytest.raises(ValueError, match="median"):
        stateful.updating_aggregate(spark.range(1), [], {"m": ("median", "id")})


def replayed(spark, path, schema, keys):
    return rows(debezium.replay(spark.read.schema(f"before struct<{schema}>, after struct<{schema}>, op string, batch int").json(path), keys, "batch"))


def test_script_of_updating_results_over_changelogs(spark, tmp_path):
    """An aggregate of a changelog, one over another aggregate with HAVING and arithmetic, DISTINCT and a filtered call, each over several batches."""
    from tidemark.plans.script import Engine

    o = spark.read.parquet(f"{SF}/orders.parquet").selectExpr("o_orderkey as id", "o_custkey as c", "cast(o_totalprice as bigint) as v")
    row = lambda v: f"struct(id, c, {v} as v)"
    none = "cast(null as struct<id: bigint, c: bigint, v: bigint>)"
    o.selectExpr(f"{none} as before", f"{row('v')} as after", "'c' as op").coalesce(1).write.option("ignoreNullFields", "false").json(str(tmp_path / "in"))
    script = f"""
    SET updating_ttl = interval '2 days';
    CREATE TABLE o (id BIGINT PRIMARY KEY, c BIGINT, v BIGINT) WITH (connector = 'filesystem', path = '{tmp_path}/in', format = 'debezium_json', type = 'source');
    CREATE TABLE sums (c BIGINT PRIMARY KEY, n BIGINT, v BIGINT, most BIGINT, odd BIGINT) WITH (connector = 'filesystem', path = '{tmp_path}/sums', format = 'debezium_json', type = 'sink');
    CREATE TABLE sizes (n BIGINT PRIMARY KEY, k BIGINT, most BIGINT) WITH (connector = 'filesystem', path = '{tmp_path}/sizes', format = 'debezium_json', type = 'sink');
    CREATE TABLE who (c BIGINT PRIMARY KEY) WITH (connector = 'filesystem', path = '{tmp_path}/who', format = 'debezium_json', type = 'sink');
    CREATE VIEW per AS SELECT c, count(*) AS n, sum(v) + 1 AS v, max(v) AS most, count(v) FILTER (WHERE v % 2 = 1) AS odd FROM o GROUP BY c;
    INSERT INTO sums SELECT c, n, v, most, odd FROM per WHERE n > 2;
    INSERT INTO sizes SELECT n, count(*) AS k, max(v) AS most FROM per GROUP BY n HAVING count(*) > 1;
    INSERT INTO who SELECT DISTINCT c FROM o WHERE v > 100000;"""

    def run():
        engine = Engine(spark, live=True)
        engine.run(script)
        engine.start(str(tmp_path / "cp"))

    run()
    o.where("id % 3 = 0").selectExpr(f"{row('v')} as before", f"{none} as after", "'d' as op").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    o.where("id % 3 = 1").selectExpr(f"{row('v')} as before", f"{row('v + 7')} as after", "'u' as op").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run()
    left = o.where("id % 3 <> 0").withColumn("v", F.expr("if(id % 3 = 1, v + 7, v)"))
    per = left.groupBy("c").agg(F.count("*").alias("n"), (F.sum("v") + 1).alias("v"), F.max("v").alias("most"), F.count_if(F.expr("v % 2 = 1")).alias("odd"))
    assert replayed(spark, str(tmp_path / "sums"), "c: bigint, n: bigint, v: bigint, most: bigint, odd: bigint", ["c"]) == rows(per.where("n > 2"))
    assert replayed(spark, str(tmp_path / "sizes"), "n: bigint, k: bigint, most: bigint", ["n"]) == rows(per.groupBy("n").agg(F.count("*").alias("k"), F.max("v").alias("most")).where("k > 1"))
    assert replayed(spark, str(tmp_path / "who"), "c: bigint", ["c"]) == rows(left.where("v > 100000").select("c").distinct())
