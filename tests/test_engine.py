import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hashing
from tidemark.functions import json as js
from tidemark.operators import debezium, updating, windows
from tidemark.plans.rewrite import carry_time, rewrite
from tidemark.plans.script import Engine, parse_table, statements
from tidemark.plans.validate import PlanError, check_select
from tidemark.sources import connectors, formats, generators
from tidemark.streaming import runner
from tidemark.types import spark_type, split_top

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name, want",
    [("BIGINT", T.LongType()), ("FLOAT", T.FloatType()), ("TEXT[]", T.ArrayType(T.StringType())), ("DECIMAL(10,5)", T.DecimalType(10, 5)), ("BIGINT UNSIGNED", T.DecimalType(20, 0)), ("STRUCT<a INT, b STRUCT<c TEXT>>", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StructType([T.StructField("c", T.StringType())]))]))],
)
def test_types(name, want):
    assert spark_type(name) == want


@pytest.mark.parametrize("name", ["MAP<INT, INT>", "TIMESTAMP(4)", "DECIMAL(39,1)", "NOPE"])
def test_bad_types(name):
    with pytest.raises(ValueError):
        spark_type(name)


@pytest.mark.parametrize(
    "sql, message",
    [
        ("SELECT a FROM t ORDER BY a", "ORDER BY"), ("SELECT a FROM t LIMIT 3", "LIMIT"), ("WITH RECURSIVE r AS (SELECT 1) SELECT * FROM r", "recursive"), ("EXPLAIN SELECT 1", "EXPLAIN"),
        ("SELECT * FROM a JOIN b USING (x)", "only ON"), ("SELECT tumble(interval '1 hour') FROM t", "GROUP BY"), ("SELECT a FROM t WHERE tumble(interval '1 hour') > 1 GROUP BY a", "GROUP BY"),
    ],
)
def test_rejected(sql, message):
    with pytest.raises(PlanError, match=message):
        check_select(sql)


def test_over_may_order():
    check_select("SELECT row_number() OVER (PARTITION BY w ORDER BY n DESC) AS r FROM t")


def test_rewrite():
    assert rewrite("hop(interval '1 minute', interval '1 hour')") == "window(_timestamp, '1 hour', '1 minute')"
    assert rewrite("SELECT x == 1, 'a == b', unnest(y), 'unnest(x) -> hop(1)', \"Col\"") == "SELECT x = 1, 'a == b', explode(y), 'unnest(x) -> hop(1)', `Col`"
    assert rewrite("a.b[2]") == "try_element_at(a.b, 2)" and rewrite("f(x)[1]") == "try_element_at(f(x), 1)"
    with pytest.raises(ValueError):
        rewrite("hop(interval '7 minutes', interval '1 hour')")


def test_table_definition():
    t = parse_table("CREATE TABLE o (id BIGINT NOT NULL PRIMARY KEY, at TIMESTAMP, day TEXT GENERATED ALWAYS AS (cast(at as string)), p INT METADATA FROM 'partition', WATERMARK FOR at AS at - interval '5 seconds') WITH (connector = 'kafka', bootstrap_servers = 'h:1', topic = 'x', type = 'source', format = 'json')")
    assert (t.keys, list(t.generated), t.metadata, t.watermark[0], len(t.schema.fields)) == (["id"], ["day"], {"p": "partition"}, "at", 2)
    assert statements("select ';' ; -- c\n select 2;") == ["select ';'", "select 2"]


@pytest.mark.parametrize("options", ["connector = 'nope'", "connector = 'impulse', wrong = '1'"])
def test_bad_options(options):
    with pytest.raises(PlanError, match="unknown"):
        parse_table(f"CREATE TABLE t (a INT) WITH ({options})")


def test_script_errors(spark):
    for script in ("", "SET nope = 1; SELECT 1", "CREATE TABLE t (a INT)"):
        with pytest.raises(PlanError):
            Engine(spark).run(script)


def test_comparisons_are_not_brackets():
    assert split_top("a > b, f(c < d, e), ARRAY<STRUCT<x INT, y INT>> z") == ["a > b", "f(c < d, e)", "ARRAY<STRUCT<x INT, y INT>> z"]
    assert split_top("SELECT a WHERE b > 1; SELECT 'x;y'", ";") == ["SELECT a WHERE b > 1", "SELECT 'x;y'"]


def test_event_time_is_carried():
    assert carry_time("SELECT a FROM (SELECT b AS a FROM t WHERE c = 'from') x") == "SELECT a, _timestamp FROM (SELECT b AS a, _timestamp FROM t WHERE c = 'from') x"
    assert carry_time("SELECT l.a FROM t AS l LEFT JOIN (SELECT * FROM u) r ON l.a = r.a").startswith("SELECT l.a, greatest(l._timestamp, r._timestamp) AS _timestamp FROM")
    for same in ("SELECT DISTINCT a FROM t", "SELECT a, count(*) FROM t GROUP BY a", "SELECT t.* FROM t"):
        assert carry_time(same) == same


def test_impulse_script_into_files(spark, tmp_path):
    e = Engine(spark)
    e.run(f"""CREATE TABLE i (timestamp TIMESTAMP, counter BIGINT) WITH (connector = 'impulse', message_count = '100', interval = '200', type = 'source');
    CREATE TABLE o (start TIMESTAMP, n BIGINT) WITH (connector = 'single_file', path = '{tmp_path}/o', format = 'json', type = 'sink');
    INSERT INTO o SELECT window.start, n FROM (SELECT tumble(interval '10 seconds') AS window, count(*) AS n FROM i GROUP BY window);
    INSERT INTO o SELECT window.start, n FROM (SELECT hop(interval '10 seconds', interval '10 seconds') AS window, count(*) AS n FROM i GROUP BY window);""")
    e.flush()
    assert [r.n for r in spark.read.json(f"{tmp_path}/o").collect()] == [50] * 4


def test_nexmark_shares(spark):
    r = generators.nexmark(spark, 5000).agg(F.count("person"), F.count("auction"), F.count("bid")).first()
    assert tuple(r) == (100, 300, 4600)


def test_formats(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\nnonsense\n{"a": 2}\n')
    o = {"connector": "single_file", "path": str(tmp_path / "x.json"), "format": "json", "bad_data": "drop"}
    assert sorted(r.a for r in connectors.read(spark, o, T.StructType([T.StructField("a", T.LongType())])).collect()) == [1, 2]


def test_json_functions(spark):
    d = spark.createDataFrame([('{"a": [{"b": "x"}, {"b": 2}], "s": "t"}',), ("bad",), (None,)], "j string")
    r = d.select(js.extract_json("j", "$.a[*].b"), js.get_first_json_object("j", "$.s"), js.extract_json_string("j", "$.a[1].b"), js.json_length("j")).collect()
    assert tuple(r[0]) == (['"x"', "2"], '"t"', None, 2)
    assert r[1][0] is None and r[2][0] is None


def test_debezium_round_trip(spark):
    d = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id int, v string, seq int")
    c = debezium.to_debezium(d.drop("seq"))
    assert sorted(r.id for r in debezium.unroll(c, ["id"]).collect()) == [1, 2]
    with pytest.raises(Exception, match="unknown op"):
        debezium.unroll(c.withColumn("op", F.lit("x")), ["id"]).collect()


def test_changes(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, n int"), spark.createDataFrame([(2, 2), (3, 4), (4, 5)], "k int, n int")
    assert sorted(r.op for r in updating.changes(a, b, ["k"]).collect()) == ["c", "d", "u"]


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path, schema = str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    e.repartition(1).write.parquet(path)
    runner.write_sentinel(spark, schema, "ts", path)
    s = runner.with_event_time(runner.read_files(spark, path, schema, files=10), "ts")
    agg = windows.window_agg(s, windows.tumble("ts", "1 hour"), ["event_type"], F.count("*").alias("n"))
    runner.run_to_end(agg, str(tmp_path / "cp"), runner.to_table(str(tmp_path / "out")))
    want = windows.window_agg(e, windows.tumble("ts", "1 hour"), ["event_type"], F.count("*").alias("n"))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_updating_stream_replays_to_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = runner.read_files(spark, str(tmp_path / "in"), "event_id long, user_id long")
    agg = s.groupBy("user_id").agg(F.count("*").alias("n"))
    runner.run_to_end(agg, str(tmp_path / "cp"), runner.updating_to_changelog(str(tmp_path / "st"), str(tmp_path / "out"), ["user_id"]), "update")
    c = spark.read.parquet(str(tmp_path / "out"))
    assert {r.op for r in c.collect()} == {"c", "u"}
    assert sorted(map(tuple, debezium.replay(c, ["user_id"], "batch").collect())) == sorted(map(tuple, e.groupBy("user_id").count().collect()))


TABLES = """
CREATE TABLE stream (ts TIMESTAMP NOT NULL, user_id BIGINT, event_type TEXT, value DOUBLE, WATERMARK FOR ts) WITH (connector = 'single_file', path = 'x', format = 'json', type = 'source');
CREATE TABLE other (ts TIMESTAMP NOT NULL, user_id BIGINT, v DOUBLE) WITH (connector = 'single_file', path = 'x', format = 'json', type = 'source');
CREATE TEMPORARY TABLE look (k BIGINT PRIMARY KEY, name TEXT) WITH (connector = 'single_file', path = 'x', format = 'json', type = 'source');
"""
W = "(SELECT tumble(interval '1 hour') AS window, user_id, count(*) AS n FROM stream GROUP BY window, user_id)"
S = "(SELECT session(interval '1 hour') AS window, user_id, count(*) AS n FROM stream GROUP BY window, user_id)"
U = "(SELECT user_id, count(*) AS n FROM stream GROUP BY user_id)"


def run_on_events(spark, sql):
    e = spark.read.parquet(f"{SF}/events.parquet")
    return Engine(spark, {"stream": e.select("ts", "user_id", "event_type", "value"), "other": e.selectExpr("ts", "user_id", "value as v"), "look": spark.range(10).selectExpr("id k", "string(id) name")}).run(TABLES + sql)


@pytest.mark.parametrize(
    "sql, message",
    [
        (f"SELECT a.n FROM {W} a JOIN {W} b ON a.user_id = b.user_id", "equate their windows"), ("SELECT stream.user_id FROM stream LEFT JOIN other ON stream.user_id = other.user_id", "non-inner joins"),
        ("SELECT stream.user_id FROM stream CROSS JOIN other", "equijoin"), ("SELECT stream.user_id FROM stream JOIN other ON stream.value < other.v", "equijoin"), (f"SELECT a.n FROM {S} a JOIN {S} b ON a.window = b.window", "session"),
        (f"SELECT a.n FROM {U} a JOIN {U} b ON a.user_id = b.user_id", "updating"), (f"SELECT a.n FROM {W} a JOIN stream b ON a.user_id = b.user_id", "non-windowed"), ("SELECT name FROM stream RIGHT JOIN look ON user_id = k", "inner or left"),
        ("SELECT name FROM look JOIN stream ON user_id = k", "right side"), (f"SELECT max(n) FROM {W}", "group by its window"), (f"SELECT row_number() OVER (PARTITION BY user_id ORDER BY n) FROM {W}", "PARTITION BY"),
        ("SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts) FROM stream", "tumbling or hopping"), (f"SELECT row_number() OVER (PARTITION BY user_id ORDER BY n) FROM {U}", "updating"),
        (f"SELECT row_number() OVER (PARTITION BY window ORDER BY n) FROM {S}", "tumbling or hopping"), ("SELECT user_id FROM stream WHERE user_id IN (SELECT user_id FROM other)", "IN and EXISTS"),
        (f"CREATE TABLE o (k BIGINT, n BIGINT) WITH (connector = 'single_file', path = 'x', format = 'json', type = 'sink'); INSERT INTO o SELECT user_id, n FROM {U}", "updating result"),
    ],
)
def test_plans_that_the_dialect_refuses(spark, sql, message):
    with pytest.raises(PlanError, match=message):
        run_on_events(spark, sql)


def test_plans_that_the_dialect_has(spark):
    assert run_on_events(spark, f"SELECT a.n FROM {W} a FULL JOIN {W} b ON a.window = b.window AND a.n < b.n")[0].count()
    assert run_on_events(spark, "SELECT name FROM stream LEFT JOIN look ON user_id = k")[0].count() == 1000
    assert run_on_events(spark, f"SELECT window, max(n) FROM {W} GROUP BY window")[0].count()
    assert Engine(spark, {"stream": spark.read.parquet(f"{SF}/events.parquet")}, streaming=False).run(TABLES.split(";")[0] + "; SELECT user_id FROM stream ORDER BY user_id LIMIT 3")[0].count() == 3


def test_changelog_tables_in_scripts(spark):
    row = lambda i, v: {"id": i, "v": v}
    log = [(None, row(1, 10), "c"), (None, row(2, 5), "r"), (row(1, 10), row(1, 20), "u"), (row(2, 5), None, "d")]
    d = spark.createDataFrame(log, "before struct<id: bigint, v: int>, after struct<id: bigint, v: int>, op string")
    t = "CREATE TABLE c (id BIGINT PRIMARY KEY, v INT) WITH (connector = 'single_file', path = 'x', format = 'debezium_json', type = 'source');"
    assert [tuple(r) for r in Engine(spark, {"c": d}).run(t + "SELECT count(*), sum(v), max(v), count(distinct id) FROM c")[0].collect()] == [(1, 20, 20, 1)]
    with pytest.raises(PlanError, match="event_time_field"):
        parse_table(t.rstrip(";").replace("type =", "event_time_field = 'id', type ="))


def test_streaming_script_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) ts", "user_id", "event_type")
    schema = "ts timestamp, user_id long, event_type string"
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    runner.write_sentinel(spark, schema, "ts", str(tmp_path / "in"))
    e.repartition(1).write.parquet(str(tmp_path / "in2"))
    script = f"""
    CREATE TABLE stream (ts TIMESTAMP NOT NULL, user_id BIGINT, event_type TEXT, WATERMARK FOR ts AS ts - interval '5 seconds') WITH (connector = 'filesystem', path = '{tmp_path}/in', format = 'parquet', type = 'source');
    CREATE TABLE again (ts TIMESTAMP NOT NULL, user_id BIGINT, event_type TEXT) WITH (connector = 'filesystem', path = '{tmp_path}/in2', format = 'parquet', type = 'source');
    CREATE TABLE hours (start TIMESTAMP, n BIGINT) WITH (connector = 'filesystem', path = '{tmp_path}/hours', format = 'parquet', type = 'sink');
    CREATE TABLE users (user_id BIGINT PRIMARY KEY, n BIGINT) WITH (connector = 'filesystem', path = '{tmp_path}/users', format = 'debezium_json', type = 'sink');
    INSERT INTO hours SELECT window.start, n FROM (SELECT tumble(interval '1 hour') AS window, count(*) AS n FROM stream GROUP BY window);
    INSERT INTO users SELECT user_id, count(*) AS n FROM again GROUP BY user_id;"""
    engine = Engine(spark, live=True)
    engine.run(script)
    engine.start(str(tmp_path / "cp"))
    want = e.groupBy(F.window("ts", "1 hour").start.alias("start")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "hours")).select("start", "n").collect())) == sorted(map(tuple, want.collect()))
    log = spark.read.schema("before struct<user_id: bigint, n: bigint>, after struct<user_id: bigint, n: bigint>, op string, batch int").json(str(tmp_path / "users"))
    assert sorted(map(tuple, debezium.replay(log, ["user_id"], "batch").collect())) == sorted(map(tuple, e.groupBy("user_id").count().collect()))


def test_updating_stream_retracts_null_keys_and_idle_keys(spark, tmp_path):
    schema, path = "k string, v int, at timestamp", str(tmp_path / "in")
    for rows in ([(None, 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:00:00")], [(None, 2, "2024-01-01 00:10:00"), ("b", 1, "2024-01-01 00:10:00")], [("b", -1, "2024-01-01 03:00:00"), (None, 3, "2024-01-01 03:00:00")]):
        spark.createDataFrame(rows, "k string, v int, at string").selectExpr("k", "v", "cast(at as timestamp) at").coalesce(1).write.mode("append").parquet(path)
        agg = runner.read_files(spark, path, schema).groupBy("k").agg(F.sum("v").alias("v"), F.max("at").alias("at"))
        runner.run_to_end(agg, str(tmp_path / "cp"), runner.updating_to_changelog(str(tmp_path / "st"), str(tmp_path / "out"), ["k"], ttl="1 hour", at="at", gone=F.col("v") == 0), "update")
    log = sorted((r.batch, r.op, (r.after or r.before).k or "-", r.after and r.after.v) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert log == [(0, "c", "-", 1), (0, "c", "a", 1), (1, "c", "b", 1), (1, "u", "-", 3), (2, "d", "a", None), (2, "d", "b", None), (2, "u", "-", 6)]


@pytest.mark.parametrize("kind", ["tumble", "hop", "session"])
def test_late_rows_are_dropped_once_their_window_is_closed(spark, tmp_path, kind):
    """A row for a window that was emitted changes nothing; one that is late for its place but whose window is open counts."""
    w = {"tumble": windows.tumble("ts", "10 minutes"), "hop": windows.hop("ts", "5 minutes", "10 minutes"), "session": windows.session("ts", "2 minutes")}[kind]
    path = str(tmp_path / "in")
    for n, times in enumerate((["00:01:00", "00:02:00"], ["01:01:00"], ["00:03:00", "01:00:30"], ["05:00:00"], ["09:00:00"])):
        spark.createDataFrame([(f"2024-01-01 {t}",) for t in times], "ts string").selectExpr("cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(path)
        s = runner.with_event_time(runner.read_files(spark, path, "ts timestamp"), "ts", "1 minute")
        # Spark has no streaming session without a key
        runner.run_to_end(windows.window_agg(s.withColumn("k", F.lit(1)), w, ["k"], F.count("*").alias("n")), str(tmp_path / "cp"), runner.to_table(str(tmp_path / "out")))
    got = {str(r.window.start)[11:16]: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.window.start.hour < 4}
    want = {"tumble": {"00:00": 2, "01:00": 2}, "hop": {"00:00": 2, "00:55": 2, "01:00": 2}, "session": {"00:01": 2, "01:00": 2}}[kind]
    assert {k: v for k, v in got.items() if k != "23:55"} == want


def test_unsupported_options_are_refused(spark):
    for o in ("idle_micros = '5'", "rollover_seconds = '5'", "json.include_schema = 'true'", "json.timestamp_format = 'other'", "json.decimal_encoding = 'bytes'"):
        with pytest.raises(PlanError):
            parse_table(f"CREATE TABLE t (a INT) WITH (connector = 'filesystem', path = 'x', format = 'json', type = 'sink', {o})")


def test_json_timestamps_and_decimals(spark, tmp_path):
    d = spark.sql("select timestamp '2024-01-02 03:04:05.678' as t, cast(1.50 as decimal(10,2)) as d, named_struct('t', timestamp '2024-01-01 00:00:00') as s")
    o = {"connector": "single_file", "path": str(tmp_path / "o"), "format": "json", "json.timestamp_format": "unix_millis", "json.decimal_encoding": "string"}
    connectors.write(d, o)
    assert '"t":1704164645678,"d":"1.50"' in spark.read.text(str(tmp_path / "o")).first().value
    assert connectors.read(spark, o, d.schema).first() == d.first()


def test_buckets_follow_the_published_hash(spark):
    """Values of the table format's specification."""
    d = spark.sql("select 34L as i, date '2017-11-16' as d, timestamp '2017-11-16 22:31:08' as t, 'iceberg' as s, unhex('00010203') as b, '' as e, cast(null as string) as n")
    h = d.select(*[hashing.murmur3(F.col(f.name), f.dataType).alias(f.name) for f in d.schema.fields]).first()
    signed = [x if x is None or x < 2**31 else x - 2**32 for x in h]
    assert signed == [2017239379, -653330422, -2047944441, 1210000089, -188683207, 0, None]
    assert d.select(hashing.bucket("i", 16)).first()[0] == 2017239379 % 16


def test_partition_transforms_of_a_sink(spark, tmp_path):
    e = Engine(spark)
    e.run(f"""CREATE TABLE o (id BIGINT, t TIMESTAMP, city TEXT) PARTITIONED BY (day(t), bucket(4, id), truncate(2, city), id) WITH (connector = 'filesystem', path = '{tmp_path}/o', format = 'parquet', type = 'sink');
    INSERT INTO o SELECT * FROM (VALUES (34, TIMESTAMP '1970-01-03 10:00:00', 'Bonn'));""")
    e.flush()
    r = spark.read.parquet(f"{tmp_path}/o").first()
    assert (r.t_day, r.id_bucket, r.city_trunc, r.id, r.city) == (2, 2017239379 % 4, "Bo", 34, "Bonn")
    with pytest.raises(ValueError, match="unknown partition transform"):
        hashing.transform("week(t)", T.StructType([T.StructField("t", T.TimestampType())]))


def test_metadata_columns(spark):
    raw = spark.createDataFrame([('{"a": 1}', "t1", 7), ('{"a": 2}', "t1", 8), ("no", "t1", 9)], "value string, topic string, offset long")
    keep = connectors.metadata_columns("kafka", {"of": "offset_id", "a_topic": "topic"})
    got = formats.decode(raw, T.StructType([T.StructField("a", T.LongType())]), {"format": "json", "bad_data": "drop", "framing": "newline"}, keep)
    assert sorted((r.a, r.of, r.a_topic) for r in got.collect()) == [(1, 7, "t1"), (2, 8, "t1")]
    with pytest.raises(PlanError, match="no metadata 'lag'"):
        connectors.metadata_columns("kafka", {"x": "lag"})


def test_global_sessions_across_spans(spark):
    rows = ["2024-01-01 23:58:00", "2024-01-02 00:01:00", "2024-01-02 00:20:00", "2024-01-02 12:00:00", "2024-01-02 23:59:59", "2024-01-03 00:04:59", "2024-01-05 00:00:00"]
    d = spark.createDataFrame([(t,) for t in rows], "t string").selectExpr("cast(t as timestamp) t")
    got = windows.global_sessions(d, "t", "5 minutes", {"n": ("count", "t")}).select("window.start", "window.end", "n")
    want = windows.window_agg(d, windows.session("t", "5 minutes"), [], F.count("*").alias("n")).select("window.start", "window.end", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    got, want = windows.global_sessions(e, "ts", "5 minutes", {"n": ("count", "ts")}), windows.window_agg(e, windows.session("ts", "5 minutes"), [], F.count("*").alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
