"""Queries over the star schema and the event stream, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import hashing, udf
from .functions import json as js
from .operators import debezium, joins, topn, updating, windows
from .plans.rewrite import rewrite
from .plans.script import Engine
from .session import scratch, table
from .streaming import runner, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


BIN = "time_bucket(INTERVAL '{w}', ts, TIMESTAMP '1970-01-01')"
HOUR, DAY = BIN.format(w="1 hour"), BIN.format(w="1 day")
def bounds() -> list:
    return [F.col("window.start").alias("start"), F.col("window.end").alias("end")]


# projection, filter, scalar functions


@query("SELECT event_id, user_id, event_type, CAST(round_even(value, 0) AS INTEGER) AS value_int FROM events")
def scan_project(spark, d):
    return events(spark, d).select("event_id", "user_id", "event_type", F.bround("value").cast("int").alias("value_int"))


@query("SELECT event_id, value FROM events WHERE (event_type IN ('click', 'view') OR event_type LIKE 'p%') AND value BETWEEN 10 AND 80 AND user_id IS NOT NULL")
def filter_predicate(spark, d):
    e = F.col("event_type")
    return events(spark, d).where((e.isin("click", "view") | e.like("p%")) & F.col("value").between(10, 80) & F.col("user_id").isNotNull()).select("event_id", "value")


@query("SELECT event_id, value * 2 + 1 AS doubled, ts + INTERVAL 1 HOUR AS later FROM events")
def virtual_field(spark, d):
    return events(spark, d).select("event_id", (F.col("value") * 2 + 1).alias("doubled"), F.expr("ts + interval 1 hour").alias("later"))


@query("""SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name)::INTEGER AS len, substr(p_name, 2, 3) AS sub, replace(p_type, ' ', '_') AS rep,
    split_part(p_type, ' ', 1) AS part1, lpad(p_brand, 12, '*') AS padded, reverse(p_name) AS rev, starts_with(p_name, 'P') AS starts, concat(p_brand, '/', p_type) AS both,
    strpos(p_name, 'a')::INTEGER AS pos, trim('  x ') AS trimmed, repeat('ab', 2) AS rp, translate(p_brand, 'B', 'b') AS tr, regexp_replace(p_name, '[0-9]+', '#', 'g') AS rx, ascii(p_name)::INTEGER AS asc1, left(p_name, 3) AS l3, right(p_name, 3) AS r3 FROM part""")
def scalar_string(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "upper(p_name) AS up", "lower(p_brand) AS low", "char_length(p_name) AS len", "substr(p_name, 2, 3) AS sub", "replace(p_type, ' ', '_') AS rep", "split_part(p_type, ' ', 1) AS part1", "lpad(p_brand, 12, '*') AS padded", "reverse(p_name) AS rev", "startswith(p_name, 'P') AS starts", "concat(p_brand, '/', p_type) AS both", "locate('a', p_name) AS pos", "trim('  x ') AS trimmed", "repeat('ab', 2) AS rp", "translate(p_brand, 'B', 'b') AS tr", "regexp_replace(p_name, '[0-9]+', '#') AS rx", "ascii(p_name) AS asc1", "left(p_name, 3) AS l3", "right(p_name, 3) AS r3")


@query("""SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, ceil(l_tax * 10)::BIGINT AS c, floor(l_extendedprice)::BIGINT AS f, round(sqrt(l_quantity), 6) AS s, round(power(l_quantity, 2), 6) AS p,
    round(ln(l_quantity), 6) AS ln1, round(log10(l_quantity), 6) AS lg, round(exp(l_discount), 6) AS ex, sign(l_discount)::INTEGER AS sg, l_orderkey % 7 AS md, gcd(l_orderkey, 12)::BIGINT AS g, round(sin(l_quantity), 6) AS sn, (l_orderkey // 3)::BIGINT AS dv FROM lineitem""")
def scalar_math(spark, d):
    gcd = rewrite("gcd(l_orderkey, 12) AS g")
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "abs(-l_quantity) AS a", "ceil(l_tax * 10) AS c", "floor(l_extendedprice) AS f", "round(sqrt(l_quantity), 6) AS s", "round(power(l_quantity, 2), 6) AS p", "round(ln(l_quantity), 6) AS ln1", "round(log10(l_quantity), 6) AS lg", "round(exp(l_discount), 6) AS ex", "int(sign(l_discount)) AS sg", "l_orderkey % 7 AS md", gcd, "round(sin(l_quantity), 6) AS sn", "l_orderkey div 3 AS dv")


@query("""SELECT event_id, extract(year FROM ts)::INTEGER AS y, extract(month FROM ts)::INTEGER AS m, extract(hour FROM ts)::INTEGER AS h, date_trunc('hour', ts)::TIMESTAMP AS hour, CAST(ts AS DATE) AS day,
    strftime(ts, '%Y-%m-%d %H:%M') AS txt, floor(epoch(ts))::BIGINT AS unix, make_date(2024, 1, 2) AS md, extract(doy FROM ts)::INTEGER AS doy FROM events""")
def scalar_date(spark, d):
    return events(spark, d).selectExpr("event_id", "year(ts) AS y", "month(ts) AS m", "hour(ts) AS h", "cast(date_trunc('hour', ts) as timestamp_ntz) AS hour", "cast(ts as date) AS day", "date_format(ts, 'yyyy-MM-dd HH:mm') AS txt", "unix_timestamp(cast(ts as timestamp)) AS unix", "make_date(2024, 1, 2) AS md", "dayofyear(ts) AS doy")


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(event_type, 'click'), 'none') AS kind, greatest(value, 10) AS g, least(value, 10) AS l FROM events")
def scalar_cond(spark, d):
    return events(spark, d).selectExpr("event_id", "CASE WHEN value > 50 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS band", "coalesce(nullif(event_type, 'click'), 'none') AS kind", "greatest(value, 10D) AS g", "least(value, 10D) AS l")


@query("SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS first, list_contains([label, 3], 3) AS has3, list_position([1, 2, label], 2)::BIGINT AS pos, array_to_string(list_sort([label, 5, 1]), ',') AS sorted FROM embeddings")
def scalar_array(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id", "size(embedding) AS n", "double(element_at(embedding, 1)) AS first", "array_contains(array(label, 3), 3) AS has3", "array_position(array(1, 2, label), 2) AS pos", "array_join(array_sort(array(label, 5, 1)), ',') AS sorted")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_int FROM events")
def json_extract(spark, d):
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").alias("k"), js.json_get_int("props", "k").alias("k_int"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, '\"' || event_type || '\"' AS quoted FROM events")
def json_first_object(spark, d):
    x = events(spark, d).withColumn("_o", F.to_json(F.struct("event_type")))
    return x.select("event_id", js.get_first_json_object("props", "$.k").alias("k"), js.get_first_json_object("_o", "$.event_type").alias("quoted"))


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k') END AS k, event_type AS kind FROM events")
def json_extract_string(spark, d):
    x = events(spark, d).withColumn("_o", F.to_json(F.struct("event_type")))
    return x.select("event_id", js.extract_json_string("props", "$.k").alias("k"), js.extract_json_string("_o", "$.event_type").alias("kind"))


@query("SELECT event_id, user_id::VARCHAR AS a, 'x' || user_id AS b, 2::INTEGER AS n, user_id AS first FROM events")
def json_extract_all(spark, d):
    x = events(spark, d).withColumn("_o", F.expr("to_json(named_struct('l', array(named_struct('b', struct(user_id).user_id), named_struct('b', event_id)), 's', concat('x', user_id)))"))
    found = js.extract_json("_o", "$.l[*].b")
    return x.select("event_id", found[0].alias("a"), js.json_get_str("_o", "s").alias("b"), F.size(found).alias("n"), F.get_json_object("_o", "$.l[0].b").cast("long").alias("first"))


@query("SELECT event_id, floor(epoch(ts) / 3600)::INTEGER AS h, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::INTEGER AS d, (user_id - user_id % 7)::BIGINT AS t FROM events")
def partition_hours(spark, d):
    return events(spark, d).select("event_id", hashing.hours("ts").alias("h"), hashing.days("ts").alias("d"), hashing.truncate("user_id", 7, numeric=True).cast("long").alias("t"))


@query("SELECT event_id, sha256(event_type) AS sha, md5(event_type) AS m FROM events")
def hash_sha256(spark, d):
    return events(spark, d).select("event_id", F.sha2("event_type", 256).alias("sha"), F.md5("event_type").alias("m"))


@query("SELECT count(DISTINCT (user_id, event_type))::BIGINT AS n FROM events")
def multi_hash(spark, d):
    return events(spark, d).select(hashing.multi_hash("user_id", "event_type").alias("h")).agg(F.count_distinct("h").alias("n"))


@query("""SELECT o_orderkey, (extract(year FROM o_orderdate) - 1970)::INTEGER AS y, ((extract(year FROM o_orderdate) - 1970) * 12 + extract(month FROM o_orderdate) - 1)::INTEGER AS m, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::INTEGER AS dd, (o_orderkey - o_orderkey % 10)::BIGINT AS t, substr(o_orderpriority, 1, 2) AS s FROM orders""")
def partition_transforms(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.years("o_orderdate").alias("y"), hashing.months("o_orderdate").alias("m"), hashing.days("o_orderdate").alias("dd"), hashing.truncate("o_orderkey", 10, numeric=True).cast("long").alias("t"), hashing.truncate("o_orderpriority", 2).alias("s"))


def _bucket_sql(n: int) -> str:
    """The bucket hash step by step, in numbers that can't overflow."""
    t, word = 2**32, lambda x: f"(((({x} * {hashing.C1}) % {2**32} * 32768) % {2**32} + ({x} * {hashing.C1}) % {2**32} // 131072) * {hashing.C2}) % {2**32}"
    mixed = lambda h: f"((({h} * 8192) % {t} + {h} // 524288) * 5 + {hashing.ADD}) % {t}"
    return f"""WITH p AS (SELECT event_id, (event_id % {t})::HUGEINT AS lo, (event_id // {t})::HUGEINT AS hi FROM events),
    a AS (SELECT event_id, hi, {word('lo')} AS h FROM p), b AS (SELECT event_id, xor({mixed('h')}, {word('hi')}) AS h FROM a), c AS (SELECT event_id, xor({mixed('h')}, 8::HUGEINT) AS h FROM b),
    d AS (SELECT event_id, (xor(h, h // 65536) * {hashing.FINAL1}) % {t} AS h FROM c), e AS (SELECT event_id, (xor(h, h // 8192) * {hashing.FINAL2}) % {t} AS h FROM d)
    SELECT event_id, ((xor(h, h // 65536) % {2**31}) % {n})::INTEGER AS bucket FROM e"""


@query(_bucket_sql(16))
def partition_bucket(spark, d):
    return events(spark, d).select("event_id", hashing.bucket("event_id", 16).alias("bucket"))


def _rewritten(df: DataFrame, *exprs: str) -> DataFrame:
    """Expressions of the dialect, as a script would have them."""
    return df.selectExpr(*map(rewrite, exprs))


@query("""SELECT l_orderkey, l_linenumber, gcd(l_orderkey, l_partkey)::BIGINT AS g, lcm(l_linenumber, 6)::BIGINT AS l, factorial(l_linenumber)::BIGINT AS f, trunc(l_extendedprice)::DOUBLE AS t, round(cbrt(l_quantity), 6) AS c, round(log2(l_quantity), 6) AS l2, round(atan2(l_tax, l_quantity), 8) AS a,
    round(degrees(l_tax), 6) AS d, round(radians(l_quantity), 6) AS r, round(pi(), 6) AS p, CASE WHEN isnan(l_tax) THEN 1 ELSE 0 END AS nan FROM lineitem""")
def scalar_number_theory(spark, d):
    return _rewritten(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "gcd(l_orderkey, l_partkey) AS g", "lcm(l_linenumber, 6) AS l", "factorial(l_linenumber) AS f", "double(trunc(l_extendedprice)) AS t", "round(cbrt(l_quantity), 6) AS c", "round(log2(l_quantity), 6) AS l2", "round(atan2(l_tax, l_quantity), 8) AS a", "round(degrees(l_tax), 6) AS d", "round(radians(l_quantity), 6) AS r", "round(pi(), 6) AS p", "if(isnan(l_tax), 1, 0) AS nan")


@query("""SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bin, strftime(ts, '%Y/%m/%d') AS txt, (to_timestamp(event_id) AT TIME ZONE 'UTC')::TIMESTAMP AS secs, (epoch_ms(event_id * 1000))::TIMESTAMP AS millis,
    quarter(ts)::INTEGER AS q, extract(minute FROM ts)::INTEGER AS mi, extract(second FROM ts)::INTEGER AS se, last_day(ts) AS ld, make_date(year(ts)::INTEGER, month(ts)::INTEGER, 1) AS first FROM events""")
def scalar_date_bins(spark, d):
    ntz = lambda e: f"cast({e} as timestamp_ntz)"
    return _rewritten(events(spark, d), "event_id", ntz("date_trunc('day', ts)") + " AS day", ntz("date_bin(interval '15 minutes', ts)") + " AS bin", "to_char(ts, 'yyyy/MM/dd') AS txt", ntz("to_timestamp_seconds(event_id)") + " AS secs", ntz("to_timestamp_millis(event_id * 1000)") + " AS millis", "quarter(ts) AS q", "minute(ts) AS mi", "second(ts) AS se", "last_day(ts) AS ld", "make_date(year(ts), month(ts), 1) AS first")


@query("""SELECT p_partkey, regexp_matches(p_type, '^[A-M]') AS lk, len(regexp_extract_all(p_type, '[AEIOU]'))::INTEGER AS cnt, regexp_extract(p_name, '[a-z]+') AS first, coalesce(regexp_extract_all(p_brand, '[0-9]')[1], 'none') AS digit, p_name LIKE '%a%' AS has_a,
    array_to_string(regexp_extract_all(p_type, '[A-Z]{2}'), '|') AS pairs FROM part""")
def scalar_regex(spark, d):
    return _rewritten(table(spark, d, "part"), "p_partkey", "regexp_like(p_type, '^[A-M]') AS lk", "regexp_count(p_type, '[AEIOU]') AS cnt", "regexp_substr(p_name, '[a-z]+') AS _f", "coalesce(regexp_match(p_brand, '[0-9]')[1], 'none') AS digit", "p_name LIKE '%a%' AS has_a", "array_to_string(coalesce(regexp_match(p_type, '[A-Z]{2}'), cast(make_array() as array<string>)), '|') AS pairs").withColumn("first", F.coalesce("_f", F.lit(""))).drop("_f")


@query("""SELECT p_partkey, lower(hex(p_name)) AS hx, base64(p_name::BLOB) AS b64, decode(unhex(hex(p_name))) AS back, decode(from_base64(base64(p_brand::BLOB))) AS back64, sha256(p_name) AS s, md5(p_type) AS m, chr(65 + p_size) AS ch, rpad(p_brand, 12, '.') AS rp, length(p_name)::INTEGER AS n FROM part""")
def encode_decode(spark, d):
    return _rewritten(table(spark, d, "part"), "p_partkey", "encode(p_name, 'hex') AS hx", "encode(p_name, 'base64') AS b64", "string(decode(encode(p_name, 'hex'), 'hex')) AS back", "string(decode(encode(p_brand, 'base64'), 'base64')) AS back64", "sha256(p_name) AS s", "digest(p_type, 'md5') AS m", "chr(65 + p_size) AS ch", "rpad(p_brand, 12, '.') AS rp", "character_length(p_name) AS n")


@query("""SELECT event_id, user_id AS u, event_type AS t, value * 2 AS twice, event_type || ':' || user_id AS both FROM events""")
def scalar_struct(spark, d):
    x = _rewritten(events(spark, d), "event_id", "named_struct('u', user_id, 'in', named_struct('t', event_type, 'v', value)) AS s")
    return _rewritten(x, "event_id", "s.u AS u", "get_field(s.in, 't') AS t", "s.in.v * 2 AS twice", "concat(s.in.t, ':', s.u) AS both")


@query("""SELECT event_id, map {'a': user_id, 'b': event_id}['a'] AS a, 2::INTEGER AS n, user_id AS got, NULL::BIGINT AS missing, 'a,b' AS keys FROM events""")
def scalar_map(spark, d):
    x = _rewritten(events(spark, d), "event_id", "map('a', user_id, 'b', event_id) AS m")
    return _rewritten(x, "event_id", "m['a'] AS a", "cardinality(m) AS n", "try_element_at(m, 'a') AS got", "try_element_at(m, 'zz') AS missing", "array_to_string(sort_array(map_keys(m)), ',') AS keys")


@query("""SELECT event_id, [user_id, 3, 5][1]::BIGINT AS first, CASE WHEN list_contains([user_id % 4, 3], 3) THEN 1 ELSE 0 END AS has3, len([1, 2, user_id])::INTEGER AS n, array_to_string(list_distinct([1, 1]), ',') AS uniq, array_to_string([1, 2, 3, 4][2:3], ',') AS part, list_sum([user_id, 1, 2])::BIGINT AS total FROM events""")
def scalar_array_functions(spark, d):
    return _rewritten(events(spark, d), "event_id", "make_array(user_id, 3, 5)[1] AS first", "if(array_has(array[user_id % 4, 3], 3), 1, 0) AS has3", "array_length(array[1, 2, user_id]) AS n", "array_to_string(array_distinct(array[1, 1]), ',') AS uniq", "array_to_string(array_slice(array[1, 2, 3, 4], 2, 3), ',') AS part", "aggregate(array[user_id, 1L, 2L], 0L, (a, x) -> a + x) AS total")


# windows and aggregates


@query(f"SELECT {HOUR} AS start, event_type, count(*)::BIGINT AS count FROM events GROUP BY ALL")
def tumble_count(spark, d):
    return windows.window_agg(events(spark, d), windows.tumble("ts", "1 hour"), ["event_type"], F.count("*").alias("count")).select("window.start", "event_type", "count")


@query(f"SELECT {BIN.format(w='7 days')} AS start, count(*)::BIGINT AS count FROM events GROUP BY ALL")
def tumble_week(spark, d):
    return windows.window_agg(events(spark, d), windows.tumble("ts", "7 days"), [], F.count("*").alias("count")).select("window.start", "count")


HOP = f"""WITH p AS (SELECT {BIN.format(w='15 minutes')} AS b, event_type, value FROM events), w AS (SELECT b - INTERVAL 15 MINUTE * i AS start, event_type, value FROM p, range(4) r(i))
SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM w GROUP BY ALL"""


@query(HOP)
def hop_agg(spark, d):
    v = windows.window_agg(events(spark, d), windows.hop("ts", "15 minutes", "1 hour"), ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))
    return v.select(*bounds(), "event_type", "n", "total", "lo", "hi", "mean")


@query(HOP)
def hop_two_step(spark, d):
    v = windows.hop_two_step(events(spark, d), "ts", "15 minutes", "1 hour", ["event_type"], {"n": ("count", "value"), "total": ("sum", "value"), "lo": ("min", "value"), "hi": ("max", "value"), "mean": ("avg", "value")})
    return v.select(*bounds(), "event_type", "n", F.round("total", 4).alias("total"), "lo", "hi", F.round("mean", 6).alias("mean"))


@query(f"SELECT {HOUR} AS start, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def hop_equals_tumble(spark, d):
    return windows.window_agg(events(spark, d), windows.hop("ts", "1 hour", "1 hour"), [], F.count("*").alias("n")).select("window.start", "n")


def _session_sql(key: str, gap: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    return f"""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER ({part} ORDER BY ts, event_id) <= INTERVAL '{gap}' THEN 0 ELSE 1 END AS brk FROM events),
b AS (SELECT *, sum(brk) OVER ({part} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT {key + ',' if key else ''} min(ts) AS start, max(ts) + INTERVAL '{gap}' AS "end", count(*)::BIGINT AS n FROM b GROUP BY {key + ',' if key else ''} s"""


@query(_session_sql("user_id", "6 hours"))
def session_count(spark, d):
    return windows.window_agg(events(spark, d), windows.session("ts", "6 hours"), ["user_id"], F.count("*").alias("n")).select("user_id", *bounds(), "n")


@query(_session_sql("", "5 minutes"))
def session_global(spark, d):
    return windows.global_sessions(events(spark, d), "ts", "5 minutes", {"n": ("count", "event_id")}).select(*bounds(), "n")


@query(f"WITH u AS (SELECT {HOUR} AS start, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT start, max(n)::BIGINT AS most, count(*)::BIGINT AS users FROM u GROUP BY start")
def nested_window_agg(spark, d):
    u = windows.window_agg(events(spark, d), windows.tumble("ts", "1 hour"), ["user_id"], F.count("*").alias("n"))
    return u.groupBy("window").agg(F.max("n").alias("most"), F.count("*").alias("users")).select("window.start", "most", "users")


@query(f"WITH u AS (SELECT {HOUR} AS h, count(*) AS n FROM events GROUP BY ALL) SELECT {DAY.replace('ts', 'h')} AS start, max(n)::BIGINT AS peak FROM u GROUP BY ALL")
def nested_rewindow(spark, d):
    u = windows.window_agg(events(spark, d), windows.tumble("ts", "1 hour"), [], F.count("*").alias("n"))
    return u.groupBy(windows.rewindow(u, "1 day").alias("w")).agg(F.max("n").alias("peak")).select("w.start", "peak")


@query(f"SELECT {HOUR} AS start, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY ALL")
def window_count_distinct(spark, d):
    return windows.window_agg(events(spark, d), windows.tumble("ts", "1 hour"), [], F.count_distinct("user_id").alias("users")).select("window.start", "users")


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS co, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(stddev_samp(l_quantity), 6) AS ss, round(stddev_pop(l_quantity), 6) AS sp,
    round(var_samp(l_tax), 6) AS vs, round(var_pop(l_tax), 6) AS vp, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS rc,
    round(regr_avgx(l_tax, l_quantity), 6) AS ax, round(regr_avgy(l_tax, l_quantity), 6) AS ay, round(regr_sxx(l_tax, l_quantity), 2) AS sxx, round(regr_syy(l_tax, l_quantity), 2) AS syy, round(regr_sxy(l_tax, l_quantity), 2) AS sxy,
    bit_and(l_linenumber) AS ba, bit_or(l_linenumber) AS bo, bit_xor(l_linenumber) AS bx, bool_and(l_quantity > 0) AS al, bool_or(l_tax > 0.07) AS an, median(l_quantity) AS md FROM lineitem GROUP BY l_returnflag""")
def stat_aggs(spark, d):
    r = lambda f, n=6: F.round(f, n)
    q, p, t = "l_quantity", "l_extendedprice", "l_tax"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        r(F.corr(q, p)).alias("co"), r(F.covar_pop(q, t)).alias("cp"), r(F.covar_samp(q, t)).alias("cs"), r(F.stddev_samp(q)).alias("ss"), r(F.stddev_pop(q)).alias("sp"), r(F.var_samp(t)).alias("vs"), r(F.var_pop(t)).alias("vp"),
        r(F.regr_slope(p, q), 4).alias("sl"), r(F.regr_intercept(p, q), 2).alias("ic"), r(F.regr_r2(p, q)).alias("r2"), F.regr_count(p, q).alias("rc"), r(F.regr_avgx(t, q)).alias("ax"), r(F.regr_avgy(t, q)).alias("ay"), r(F.regr_sxx(t, q), 2).alias("sxx"), r(F.regr_syy(t, q), 2).alias("syy"), r(F.regr_sxy(t, q), 2).alias("sxy"),
        F.bit_and("l_linenumber").alias("ba"), F.bit_or("l_linenumber").alias("bo"), F.bit_xor("l_linenumber").alias("bx"), F.bool_and(F.col(q) > 0).alias("al"), F.bool_or(F.col(t) > 0.07).alias("an"), F.median(q).alias("md"),
    )


@query("SELECT count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem")
def agg_global(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS q, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def agg_grouped(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id HAVING count(*) > 12")
def agg_having(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def agg_first_last(spark, d):
    at = F.struct("ts", "event_id")
    return events(spark, d).groupBy("user_id").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


@query("""SELECT event_type, true AS near, quantile_disc(value, 0.5) AS median, (SELECT quantile_cont(w.value, 0.9) FROM (SELECT e.event_type AS t, e.value FROM events e, range(3) r(i) WHERE i < e.user_id % 3 + 1) w WHERE w.t = events.event_type) AS weighted
    FROM events GROUP BY event_type""")
def agg_approx(spark, d):
    # the count of distinct users has to be within 10 % of the exact one: twice the error that it promises
    a = events(spark, d).groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.count_distinct("user_id").alias("exact"), F.percentile_approx("value", 0.5).alias("median"), F.percentile("value", 0.9, F.col("user_id") % 3 + 1).alias("weighted"))
    return a.select("event_type", (F.abs(F.col("users") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"), "median", "weighted")


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, grouping(l_returnflag)::INTEGER AS g1, grouping(l_linestatus)::INTEGER AS g2 FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def agg_grouping(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("_grouped_lines")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, int(grouping(l_returnflag)) AS g1, int(grouping(l_linestatus)) AS g2 FROM _grouped_lines GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")


@query("SELECT user_id, list_sort(list(event_type))[1] AS first, len(list(event_id))::INTEGER AS n, len(list(DISTINCT event_type))::INTEGER AS kinds FROM events GROUP BY user_id")
def agg_array(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list("event_type"))[0].alias("first"), F.size(F.collect_list("event_id")).alias("n"), F.size(F.collect_set("event_type")).alias("kinds"))


@query("SELECT user_id, unnest(list_sort(list(event_id))) AS event_id FROM events GROUP BY user_id")
def agg_collect_unnest(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.collect_list("event_id").alias("ids")).select("user_id", F.explode("ids").alias("event_id"))


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def agg_string(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.expr("listagg(cast(event_id as string), ',') within group (order by event_id)").alias("ids"))


@query("WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT count(*)::BIGINT AS users, sum(n)::BIGINT AS total FROM u WHERE n > 3")
def agg_over_agg(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).where("n > 3").agg(F.count("*").alias("users"), F.sum("n").alias("total"))


# joins


def _counts(spark: SparkSession, d: str, kind: str, name: str) -> DataFrame:
    e = events(spark, d).where(F.col("event_type") == kind)
    return windows.window_agg(e, windows.tumble("ts", "6 hours"), ["user_id"], F.count("*").alias(name))


def _window_join_sql(how: str) -> str:
    w = BIN.format(w="6 hours")
    side = lambda t, n: f"(SELECT {w} AS start, user_id, count(*)::BIGINT AS {n} FROM events WHERE event_type = '{t}' GROUP BY ALL)"
    return f"SELECT start, user_id, clicks, views FROM {side('click', 'clicks')} {how} JOIN {side('view', 'views')} USING (start, user_id)"


def _window_join(how: str) -> Query:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return joins.window_join(_counts(spark, d, "click", "clicks"), _counts(spark, d, "view", "views"), ["user_id"], how).select("window.start", "user_id", "clicks", "views")

    f.__name__ = f"join_window_{how}"
    return f


for _how in ("inner", "left", "right", "full"):
    query(_window_join_sql(_how))(_window_join(_how))


@query(f"WITH c AS (SELECT {HOUR} AS start, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL), m AS (SELECT start, max(n) AS most FROM c GROUP BY start) SELECT c.start, user_id, n FROM c JOIN m ON c.start = m.start AND n >= most")
def join_window_nonequi(spark, d):
    c = windows.window_agg(events(spark, d), windows.tumble("ts", "1 hour"), ["user_id"], F.count("*").alias("n"))
    m = c.groupBy("window").agg(F.max("n").alias("most"))
    return joins.window_join(c, m, [], condition=F.col("l.n") >= F.col("r.most")).select("l.window.start", "user_id", "n")


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def join_unwindowed_inner(spark, d):
    # line items are summed by order first: the join and the shuffle after it see one row an order
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("_n"), F.sum("l_quantity").alias("_q"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return joins.updating_join(o, l, o.o_orderkey == l.l_orderkey).groupBy("o_orderpriority").agg(F.sum("_n").alias("n"), F.round(F.sum("_q"), 2).alias("q"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_inner(spark, d):
    return joins.lookup_join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def lookup_left(spark, d):
    return joins.lookup_join(events(spark, d), table(spark, d, "customer"), "user_id", "c_custkey", "left").select("event_id", "c_mktsegment")


@query("""SELECT c.event_id AS click, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') c JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON c.user_id = p.user_id AND c.ts <= p.ts + INTERVAL 2 HOUR AND p.ts <= c.ts + INTERVAL 2 HOUR""")
def join_updating_ttl(spark, d):
    side = lambda kind, name: events(spark, d).where(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts"))
    c, p = side("click", "click"), side("purchase", "purchase")
    return joins.updating_join(c, p, F.col("click_user") == F.col("purchase_user"), ttl="2 hours", times=("click_ts", "purchase_ts")).select("click", "purchase")


# OVER, top-k

TOPK = f"""WITH p AS (SELECT {BIN.format(w='6 hours')} AS b, user_id FROM events), w AS (SELECT b - INTERVAL 6 HOUR * i AS start, user_id, count(*)::BIGINT AS n FROM p, range(4) r(i) GROUP BY ALL)
SELECT start, start + INTERVAL 24 HOUR AS "end", user_id, n, row_num FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, user_id DESC) AS row_num FROM w) WHERE row_num <= 3"""


@query(TOPK.replace("n, row_num FROM (", "n, row_num::INTEGER AS row_num FROM ("))
def topk_per_window(spark, d):
    c = windows.hop_two_step(events(spark, d), "ts", "6 hours", "24 hours", ["user_id"], {"n": ("count", "event_id")})
    return topn.top_k(c, 3, ["window"], [F.desc("n"), F.desc("user_id")]).select(*bounds(), "user_id", "n", "row_num")


@query(f"""WITH c AS (SELECT {DAY} AS start, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL)
SELECT start, user_id, n, rank() OVER a::INTEGER AS rk, dense_rank() OVER a::INTEGER AS dr, lag(n) OVER b AS prev, lead(n) OVER b AS nxt, ntile(4) OVER b::INTEGER AS tile, round(percent_rank() OVER a, 6) AS pr, round(cume_dist() OVER a, 6) AS cd, sum(n) OVER (b ROWS UNBOUNDED PRECEDING)::BIGINT AS run, first_value(user_id) OVER b AS fv
FROM c WINDOW a AS (PARTITION BY start ORDER BY n DESC), b AS (PARTITION BY start ORDER BY n DESC, user_id)""")
def over_rank_lag(spark, d):
    c = windows.window_agg(events(spark, d), windows.tumble("ts", "1 day"), ["user_id"], F.count("*").alias("n"))
    a, b = Window.partitionBy("window").orderBy(F.desc("n")), Window.partitionBy("window").orderBy(F.desc("n"), "user_id")
    return c.select("window.start", "user_id", "n", F.rank().over(a).alias("rk"), F.dense_rank().over(a).alias("dr"), F.lag("n").over(b).alias("prev"), F.lead("n").over(b).alias("nxt"), F.ntile(4).over(b).alias("tile"), F.round(F.percent_rank().over(a), 6).alias("pr"), F.round(F.cume_dist().over(a), 6).alias("cd"), F.sum("n").over(b.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.first("user_id").over(b).alias("fv"))


@query(f"""WITH c AS (SELECT {DAY} AS start, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL)
SELECT start, user_id, first_value(user_id) OVER w AS first, last_value(user_id) OVER w AS last, nth_value(user_id, 2) OVER w AS second, avg(n) OVER r AS near FROM c
WINDOW w AS (PARTITION BY start ORDER BY n DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), r AS (PARTITION BY start ORDER BY n DESC, user_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def over_values(spark, d):
    c = windows.window_agg(events(spark, d), windows.tumble("ts", "1 day"), ["user_id"], F.count("*").alias("n"))
    by = Window.partitionBy("window").orderBy(F.desc("n"), "user_id")
    w = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return c.select("window.start", "user_id", F.first("user_id").over(w).alias("first"), F.last("user_id").over(w).alias("last"), F.nth_value("user_id", 2).over(w).alias("second"), F.avg("n").over(by.rowsBetween(-1, 1)).alias("near"))


# set operations, unnest, user-defined functions


@query("SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all(spark, d):
    return table(spark, d, "customer").selectExpr("c_nationkey k", "c_acctbal bal").union(table(spark, d, "supplier").select("s_nationkey", "s_acctbal"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").selectExpr("c_nationkey k").union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT DISTINCT event_type, user_id % 10 AS m FROM events")
def distinct_rows(spark, d):
    return events(spark, d).selectExpr("event_type", "user_id % 10 AS m").distinct()


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def unnest_split(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))


@query("SELECT event_id, user_id * 2 + 1 AS y FROM events")
def udf_scalar(spark, d):
    def odd(x: int) -> int:
        return x * 2 + 1

    return events(spark, d).select("event_id", udf.register_scalar(spark, "odd", odd)("user_id").alias("y"))


@query("SELECT event_type, median(value) AS m FROM events GROUP BY event_type")
def udaf_median(spark, d):
    def mid(s: pd.Series) -> float:
        return float(s.median())

    return events(spark, d).groupBy("event_type").agg(udf.register_aggregate(spark, "mid", mid, "double")("value").alias("m"))


@query("SELECT event_id, user_id + 1 AS next FROM events")
def async_udf(spark, d):
    async def plus(x: int) -> int:
        return x + 1

    return udf.async_map(events(spark, d).select("event_id", "user_id"), "user_id", plus, "next", "bigint").select("event_id", "next")


@query("SELECT event_id, user_id + 1 AS i, value * 2 AS f, event_type || '!' AS s, value > 50 AS b FROM events")
def udf_types(spark, d):
    def next_int(x: int) -> int:
        return x + 1

    def twice(x: float) -> float:
        return x * 2

    def loud(x: str) -> str:
        return x + "!"

    def high(x: float) -> bool:
        return x > 50

    for f in (next_int, twice, loud, high):
        udf.register_scalar(spark, f.__name__, f)
    return events(spark, d).selectExpr("event_id", "next_int(user_id) AS i", "twice(value) AS f", "loud(event_type) AS s", "high(value) AS b")


# changelogs

#: A changelog of orders: all created, every third updated (its price doubled), every seventh then deleted.


def order_changes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    row = F.struct("o_orderkey", "o_custkey", "o_totalprice")
    twice = F.struct("o_orderkey", "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    empty = F.when(F.lit(False), row)
    k = F.col("o_orderkey")
    e = F.array(F.struct(empty.alias("before"), row.alias("after"), F.lit("c").alias("op"), F.lit(1).alias("seq")))
    u = F.when(k % 3 == 0, F.array(F.struct(row.alias("before"), twice.alias("after"), F.lit("u").alias("op"), F.lit(2).alias("seq"))))
    x = F.when(k % 7 == 0, F.array(F.struct(F.when(k % 3 == 0, twice).otherwise(row).alias("before"), empty.alias("after"), F.lit("d").alias("op"), F.lit(3).alias("seq"))))
    gone = F.slice(e, 1, 0)
    return o.select(F.explode(F.concat(e, F.coalesce(u, gone), F.coalesce(x, gone))).alias("v")).select("v.*")


PRICE = "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END"


@query(f"SELECT o_orderkey, o_custkey, {PRICE} AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def updating_replay(spark, d):
    return debezium.replay(order_changes(spark, d), ["o_orderkey"], "seq")


@query(f"SELECT o_custkey, count(*)::BIGINT AS count, round(sum({PRICE}), 2) AS total FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey")
def updating_aggregate(spark, d):
    signed = debezium.unroll(order_changes(spark, d), ["o_orderkey"])
    return updating.signed_agg(signed, ["o_custkey"], {"total": "o_totalprice"}).withColumn("total", F.round("total", 2))


@query(f"SELECT o_custkey, max({PRICE}) AS dearest, median({PRICE}) AS middle FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey")
def updating_unretractable(spark, d):
    rows = updating.live_rows(debezium.unroll(order_changes(spark, d), ["o_orderkey"]), ["o_orderkey", "o_custkey", "o_totalprice"])
    return rows.groupBy("o_custkey").agg(F.max("o_totalprice").alias("dearest"), F.median("o_totalprice").alias("middle"))


@query(f"""SELECT o_orderkey, o_totalprice, false AS is_retract FROM orders UNION ALL SELECT o_orderkey, o_totalprice, true FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_totalprice * 2, false FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, {PRICE}, true FROM orders WHERE o_orderkey % 7 = 0""")
def debezium_unroll(spark, d):
    return debezium.unroll(order_changes(spark, d), ["o_orderkey"]).select("o_orderkey", "o_totalprice", "_updating_meta.is_retract")


@query(f"SELECT o_orderkey, {PRICE} AS price, 'c' AS op FROM orders WHERE o_orderkey % 7 <> 0")
def debezium_encode(spark, d):
    signed = debezium.unroll(order_changes(spark, d), ["o_orderkey"], "seq")
    out = debezium.encode(signed, ["o_orderkey"], ["seq", "_pos"])
    return out.select("after.o_orderkey", F.col("after.o_totalprice").alias("price"), "op")


@query("""WITH a AS (SELECT o_custkey, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_custkey, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT o_custkey, a.n AS was, b.n AS now, CASE WHEN a.n IS NULL THEN 'c' WHEN b.n IS NULL THEN 'd' ELSE 'u' END AS op FROM a FULL JOIN b USING (o_custkey) WHERE a.n IS DISTINCT FROM b.n""")
def updating_changelog(spark, d):
    o = table(spark, d, "orders")
    count = lambda k: o.where(F.col("o_orderkey") % k == 0).groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = updating.changes(count(2), count(3), ["o_custkey"])
    return c.select(F.coalesce("before.o_custkey", "after.o_custkey").alias("o_custkey"), F.col("before.n").alias("was"), F.col("after.n").alias("now"), "op")


# the SQL front end: the same through scripts


@query(f"SELECT event_type, {HOUR} AS hour, count(*)::BIGINT AS count FROM events GROUP BY ALL")
def script_hourly(spark, d):
    script = """
    CREATE TABLE stream (ts TIMESTAMP NOT NULL, event_type TEXT, WATERMARK FOR ts) WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');
    SELECT event_type, window.start AS hour, count FROM (SELECT event_type, tumble(interval '1 hour') AS window, count(*) AS count FROM stream GROUP BY window, event_type);"""
    return Engine(spark, {"stream": events(spark, d)}).run(script)[0]


@query(f"""WITH c AS (SELECT {DAY} AS start, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL) SELECT start, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, user_id DESC) AS rn FROM c) WHERE rn = 1""")
def script_most_active(spark, d):
    script = """
    CREATE TABLE stream (ts TIMESTAMP NOT NULL, user_id BIGINT, WATERMARK FOR ts AS ts - interval '5 seconds') WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');
    CREATE VIEW counts AS SELECT user_id, count(*) AS n, hop(interval '1 day', interval '1 day') AS window FROM stream GROUP BY user_id, window;
    SELECT window.start AS start, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY window ORDER BY n DESC, user_id DESC) AS rn FROM counts) WHERE rn == 1;"""
    return Engine(spark, {"stream": events(spark, d)}).run(script)[0]


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def script_json(spark, d):
    script = """
    CREATE TABLE stream (event_id BIGINT, ts TIMESTAMP, props JSON) WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');
    SELECT event_id, props->>'k' AS k FROM stream WHERE props->>'k' IS NOT NULL;"""
    return Engine(spark, {"stream": events(spark, d)}).run(script)[0]


@query(f"SELECT o_custkey, count(*)::BIGINT AS c, count(DISTINCT o_orderkey)::BIGINT AS d, round(sum({PRICE} + 5) + 10, 2) AS q, max({PRICE}) AS dearest FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey")
def script_debezium_agg(spark, d):
    script = """
    CREATE TABLE changes (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_totalprice DOUBLE) WITH (connector = 'single_file', path = 'given', format = 'debezium_json', type = 'source');
    SELECT o_custkey, count(*) AS c, count(distinct o_orderkey) AS d, round(sum(o_totalprice + 5) + 10, 2) AS q, max(o_totalprice) AS dearest FROM changes GROUP BY o_custkey;"""
    return Engine(spark, {"changes": order_changes(spark, d).drop("seq")}).run(script)[0]


@query("SELECT count(*)::BIGINT AS users, sum(n)::BIGINT AS total FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 12)")
def script_updating_over_updating(spark, d):
    script = """
    CREATE TABLE stream (ts TIMESTAMP NOT NULL, user_id BIGINT, WATERMARK FOR ts) WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');
    SELECT count(*) AS users, sum(n) AS total FROM (SELECT user_id, count(*) AS n FROM stream GROUP BY user_id HAVING count(*) > 12);"""
    return Engine(spark, {"stream": events(spark, d)}).run(script)[0]


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM (SELECT o_orderkey, o_orderpriority FROM orders) JOIN (SELECT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def script_updating_inner_join(spark, d):
    script = """
    CREATE TABLE o (o_orderkey BIGINT, o_orderpriority TEXT) WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');
    CREATE TABLE l (l_orderkey BIGINT) WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');
    SELECT o_orderpriority, count(*) AS n FROM o JOIN l ON o_orderkey = l_orderkey GROUP BY o_orderpriority;"""
    return Engine(spark, {"o": table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "l": table(spark, d, "lineitem").select("l_orderkey")}).run(script)[0]


@query("SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey")
def script_lookup(spark, d):
    script = """
    CREATE TABLE e (event_id BIGINT, user_id BIGINT) WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');
    CREATE TEMPORARY TABLE c (c_custkey BIGINT PRIMARY KEY, c_mktsegment TEXT) WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');
    SELECT event_id, c_mktsegment FROM e LEFT JOIN c ON e.user_id = c.c_custkey;"""
    return Engine(spark, {"e": events(spark, d).select("event_id", "user_id"), "c": table(spark, d, "customer").select("c_custkey", "c_mktsegment")}).run(script)[0]


@query(f"""WITH a AS (SELECT {HOUR} AS start, user_id, count(*)::BIGINT AS n FROM events GROUP BY ALL), m AS (SELECT start, max(n)::BIGINT AS most FROM a GROUP BY start)
SELECT a.start, a.user_id, a.n FROM a JOIN m ON a.start = m.start AND a.n >= m.most""")
def script_window_join(spark, d):
    script = """
    CREATE TABLE stream (ts TIMESTAMP NOT NULL, user_id BIGINT, WATERMARK FOR ts) WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');
    CREATE VIEW counts AS SELECT tumble(interval '1 hour') AS window, user_id, count(*) AS n FROM stream GROUP BY window, user_id;
    SELECT counts.window.start AS start, user_id, n FROM counts JOIN (SELECT window, max(n) AS most FROM counts GROUP BY window) AS m ON counts.window = m.window AND n >= most;"""
    return Engine(spark, {"stream": events(spark, d)}).run(script)[0]


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'a == b' AS lit, CASE WHEN json_exists(props, '$.k') THEN 1 ELSE 0 END AS has_k, user_id AS inner_id FROM events")
def script_json_operators(spark, d):
    script = """
    CREATE TABLE stream (event_id BIGINT, ts TIMESTAMP, props JSON, nested JSON) WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');
    SELECT event_id, props->>'k' AS k, 'a == b' AS lit, CASE WHEN props ? 'k' THEN 1 ELSE 0 END AS has_k, json_get_int(nested->'a'->'b', 'c') AS inner_id FROM stream;"""
    e = events(spark, d)
    nested = F.to_json(F.struct(F.struct(F.struct(F.col("user_id").alias("c")).alias("b")).alias("a")))
    return Engine(spark, {"stream": e.withColumn("nested", nested)}).run(script)[0]


STREAM = "CREATE TABLE stream (event_id BIGINT, ts TIMESTAMP NOT NULL, user_id BIGINT, event_type TEXT, value DOUBLE, WATERMARK FOR ts) WITH (connector = 'single_file', path = 'given', format = 'json', type = 'source');"


def _script(spark: SparkSession, d: str, text: str) -> DataFrame:
    return Engine(spark, {"stream": events(spark, d)}).run(STREAM + text)[0]


@query("SELECT event_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value * 2 FROM events WHERE event_type = 'view'")
def script_memory_table(spark, d):
    return _script(spark, d, """CREATE TABLE kept (event_id BIGINT, value DOUBLE);
    INSERT INTO kept SELECT event_id, value FROM stream WHERE event_type = 'click';
    INSERT INTO kept SELECT event_id, value * 2 FROM stream WHERE event_type = 'view';
    SELECT event_id, value FROM kept;""")


@query("SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id HAVING count(*) >= 5")
def script_cte(spark, d):
    return _script(spark, d, "WITH c AS (SELECT user_id, count(*) AS n FROM stream GROUP BY user_id) SELECT user_id, n FROM c WHERE n >= 5;")


@query("SELECT k::INTEGER AS k, v FROM (VALUES (1, 'a'), (2, NULL), (3, 'it''s')) t(k, v)")
def script_values(spark, d):
    return Engine(spark).run("SELECT k, v FROM (VALUES (1, 'a'), (2, NULL), (3, 'it''s')) AS t(k, v);")[0]


@query("SELECT event_id, ts AS at FROM events WHERE ts > TIMESTAMP '2024-01-02'")
def script_row_time(spark, d):
    return _script(spark, d, "SELECT event_id, row_time() AS at FROM stream WHERE row_time() > TIMESTAMP '2024-01-02';")


@query(f"SELECT {HOUR} AS start, event_type, count(*)::BIGINT AS n FROM events WHERE value > 20 GROUP BY ALL")
def script_hidden_time(spark, d):
    return _script(spark, d, """CREATE VIEW high AS SELECT event_type, value FROM stream WHERE value > 20;
    CREATE VIEW kinds AS SELECT event_type FROM high;
    SELECT window.start AS start, event_type, n FROM (SELECT tumble(interval '1 hour') AS window, event_type, count(*) AS n FROM (SELECT event_type FROM kinds) GROUP BY window, event_type) WHERE window IS NOT NULL;""")


@query(f"""WITH j AS (SELECT greatest(c.ts, v.ts) AS ts FROM (SELECT * FROM events WHERE event_type = 'click') c JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id)
SELECT {DAY} AS start, count(*)::BIGINT AS n FROM j GROUP BY ALL""")
def script_join_time(spark, d):
    return _script(spark, d, """CREATE VIEW c AS SELECT user_id FROM stream WHERE event_type = 'click';
    CREATE VIEW v AS SELECT user_id FROM stream WHERE event_type = 'view';
    CREATE VIEW pairs AS SELECT c.user_id AS user_id FROM c JOIN v ON c.user_id = v.user_id;
    SELECT window.start AS start, n FROM (SELECT tumble(interval '1 day') AS window, count(*) AS n FROM pairs GROUP BY window);""")


@query("SELECT event_id, user_id AS a, event_id AS b, NULL::BIGINT AS c, value + 1 AS later FROM events")
def script_subscript(spark, d):
    script = STREAM.replace("value DOUBLE,", "value DOUBLE, more DOUBLE GENERATED ALWAYS AS (value + 1),")
    return Engine(spark, {"stream": events(spark, d)}).run(script + "SELECT event_id, make_array(user_id, event_id)[1] AS a, array[user_id, event_id][2] AS b, make_array(user_id)[2] AS c, more AS later FROM stream;")[0]


@query("SELECT TIMESTAMP '2023-01-01' + INTERVAL 10 SECOND * (i // 20) AS start, count(*)::BIGINT AS n, sum(i)::BIGINT AS total FROM range(1000) r(i) GROUP BY ALL")
def script_impulse(spark, d):
    return Engine(spark).run("""CREATE TABLE i (timestamp TIMESTAMP, counter BIGINT) WITH (connector = 'impulse', message_count = '1000', interval = '500', type = 'source');
    SELECT window.start AS start, n, total FROM (SELECT tumble(interval '10 seconds') AS window, count(*) AS n, sum(counter) AS total FROM i GROUP BY window);""")[0]


@query("SELECT 100::BIGINT AS persons, 300::BIGINT AS auctions, 4600::BIGINT AS bids")
def script_nexmark(spark, d):
    return Engine(spark).run("CREATE TABLE n WITH (connector = 'nexmark', message_count = '5000', event_rate = '100', type = 'source'); SELECT count(person) AS persons, count(auction) AS auctions, count(bid) AS bids FROM n;".replace("n WITH", "n () WITH"))[0]


def _through_files(spark: SparkSession, d: str, name: str, columns: str, options: str, select: str) -> DataFrame:
    """What a script writes to files and another reads back."""
    path = scratch(spark, name)
    e = Engine(spark, {"stream": events(spark, d)})
    e.run(f"{STREAM} CREATE TABLE o ({columns}) WITH (connector = 'filesystem', path = '{path}', type = 'sink', {options}); INSERT INTO o {select};")
    e.flush()
    return Engine(spark).run(f"CREATE TABLE i ({columns}) WITH (connector = 'filesystem', path = '{path}', type = 'source', {options}); SELECT * FROM i;")[0]


@query("SELECT event_id, ts, event_type, value FROM events")
def file_json(spark, d):
    return _through_files(spark, d, "file_json", "event_id BIGINT, ts TIMESTAMP, event_type TEXT, value DOUBLE", "format = 'json'", "SELECT event_id, ts, event_type, value FROM stream")


@query("SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events")
def file_json_millis(spark, d):
    return _through_files(spark, d, "file_json_millis", "event_id BIGINT, ts TIMESTAMP", "format = 'json', json.timestamp_format = 'unix_millis', framing = 'newline'", "SELECT event_id, ts FROM stream")


@query("SELECT event_id, event_type, value FROM events")
def file_parquet_partitioned(spark, d):
    return _through_files(spark, d, "file_parquet", "event_id BIGINT, event_type TEXT, value DOUBLE", "format = 'parquet', partition_fields = 'event_type', shuffle_by_partition.enabled = 'true'", "SELECT event_id, event_type, value FROM stream").select("event_id", "event_type", "value")


@query("SELECT event_id, date_trunc('millisecond', ts) AS ts, value FROM events WHERE value > 50")
def file_debezium(spark, d):
    return _through_files(spark, d, "file_debezium", "event_id BIGINT PRIMARY KEY, ts TIMESTAMP, value DOUBLE", "format = 'debezium_json'", "SELECT event_id, ts, value FROM stream WHERE value > 50")


@query("SELECT event_type || '/' || event_id AS value FROM events")
def file_raw_string(spark, d):
    path = scratch(spark, "file_raw")
    events(spark, d).select(F.concat_ws("/", "event_type", "event_id").alias("value")).write.text(path)
    return Engine(spark).run(f"CREATE TABLE i (value TEXT) WITH (connector = 'single_file', path = '{path}', type = 'source', format = 'raw_string'); SELECT value FROM i;")[0]


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def file_bad_data(spark, d):
    path = scratch(spark, "file_bad")
    events(spark, d).select(F.expr("if(event_id % 3 = 0, concat('no ', event_id), to_json(struct(event_id)))").alias("value")).write.text(path)
    return Engine(spark).run(f"CREATE TABLE i (event_id BIGINT) WITH (connector = 'single_file', path = '{path}', type = 'source', format = 'json', bad_data = 'drop'); SELECT event_id FROM i;")[0]


# batch-only extensions


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def ext_order_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def ext_semi(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def ext_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(spark, d):
    return table(spark, d, "customer").selectExpr("c_nationkey k").intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
def ext_except(spark, d):
    return table(spark, d, "nation").selectExpr("n_nationkey k").subtract(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


ASOF = """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT event_id, p.value AS value FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts"""


def last_purchase(spark, d, hours=None):
    e = events(spark, d)
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof_join(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), p, "user_id", "ts", "ts", "value", hours).select("event_id", "value")


@query(ASOF)
def ext_asof(spark, d):
    return last_purchase(spark, d)


@query(ASOF)
def ext_asof_hot_keys(spark, d):
    return last_purchase(spark, d, 6)


# the same on streams of several batches: what the sinks hold at the end of the input is what SQL gives


def streamed(spark: SparkSession, df: DataFrame, at: str, name: str, files: int = 4, sentinel: dict | None = None) -> DataFrame:
    """df as a stream that reads a file a batch, in any order of event time: nothing is late until the sentinel that comes last."""
    path, schema = f"{at}/{name}", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    df.repartition(files).write.parquet(path)
    if "ts" not in df.columns:
        return runner.read_files(spark, path, schema)
    runner.write_sentinel(spark, schema, "ts", path, values=sentinel)
    return runner.with_event_time(runner.read_files(spark, path, schema), "ts", "40000 days")


def windows_of_stream(spark: SparkSession, at: str, df: DataFrame, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    runner.run_to_end(df, f"{at}/progress", runner.to_table(f"{at}/out", then))
    out = spark.read.parquet(f"{at}/out").drop("batch")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), *[c for c in out.columns if c != "window"])


def timed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), *columns)


@query(ORACLE["tumble_count"])
def stream_tumble(spark, d):
    at = scratch(spark, "stream-tumble")
    s = streamed(spark, timed(spark, d, "event_type"), at, "in")
    return windows_of_stream(spark, at, windows.window_agg(s, windows.tumble("ts", "1 hour"), ["event_type"], F.count("*").alias("count"))).drop("end")


@query(ORACLE["session_count"])
def stream_session(spark, d):
    at = scratch(spark, "stream-session")
    s = streamed(spark, timed(spark, d, "user_id"), at, "in")
    return windows_of_stream(spark, at, windows.window_agg(s, windows.session("ts", "6 hours"), ["user_id"], F.count("*").alias("n")))


@query(ORACLE["topk_per_window"])
def stream_topk_of_hops(spark, d):
    at = scratch(spark, "stream-topk")
    s = streamed(spark, timed(spark, d, "user_id"), at, "in")
    counts = windows.window_agg(s, windows.hop("ts", "6 hours", "24 hours"), ["user_id"], F.count("*").alias("n"))
    return windows_of_stream(spark, at, counts, lambda b: topn.top_k(b, 3, ["window"], [F.desc("n"), F.desc("user_id")]))


@query(f"""WITH c AS (SELECT {HOUR} AS start, user_id, count(*)::BIGINT AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL), p AS (SELECT {HOUR} AS start, user_id, count(*)::BIGINT AS purchases FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT start, user_id, clicks, purchases FROM c JOIN p USING (start, user_id)""")
def stream_window_join(spark, d):
    at, sides = scratch(spark, "stream-join"), []
    for kind, name in (("click", "clicks"), ("purchase", "purchases")):
        s = streamed(spark, timed(spark, d, "user_id", "event_type").where(F.col("event_type") == kind).drop("event_type"), at, name, sentinel={"user_id": 0})
        sides.append(windows.window_agg(s, windows.tumble("ts", "1 hour"), ["user_id"], F.count("*").alias(name)))
    return windows_of_stream(spark, at, joins.window_join(*sides, ["user_id"])).drop("end")


@query(f"SELECT o_custkey, count(*)::BIGINT AS n, round(sum({PRICE}), 2) AS total, max({PRICE}) AS dearest, count(DISTINCT o_orderkey)::BIGINT AS kinds FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey")
def stream_updating_changelog(spark, d):
    """Aggregates of a changelog read as a stream, replayed from the changelog that they give."""
    at, log = scratch(spark, "stream-updating"), order_changes(spark, d)
    for n in (1, 2, 3):  # a batch each: rows, their updates, their deletions
        log.where(F.col("seq") == n).drop("seq").coalesce(1).write.mode("append").parquet(f"{at}/in")
    s = debezium.unroll(runner.read_files(spark, f"{at}/in", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.drop("seq").schema)), ["o_orderkey"])
    a = stateful.updating_aggregate(s, ["o_custkey"], {"n": ("count", None), "total": ("sum", "o_totalprice"), "dearest": ("max", "o_totalprice"), "kinds": ("count_distinct", "o_orderkey")})
    runner.run_to_end(a, f"{at}/progress", stateful.to_changelog(f"{at}/out", ["o_custkey"]))
    return debezium.replay(spark.read.parquet(f"{at}/out"), ["o_custkey"], "batch").withColumn("total", F.round("total", 2))


@query("SELECT n, count(*)::BIGINT AS users, min(last) AS least, max(last) AS most FROM (SELECT user_id, count(*)::BIGINT AS n, max(event_id) AS last FROM events GROUP BY user_id) GROUP BY n")
def stream_updating_over_updating(spark, d):
    """How many users have how many events: the outer aggregate lives on the retractions of the inner one."""
    at = scratch(spark, "stream-nested")
    inner = stateful.updating_aggregate(streamed(spark, events(spark, d).select("user_id", "event_id"), at, "in"), ["user_id"], {"n": ("count", None), "last": ("max", "event_id")})
    outer = stateful.updating_aggregate(inner, ["n"], {"users": ("count", None), "least": ("min", "last"), "most": ("max", "last")})
    runner.run_to_end(outer, f"{at}/progress", stateful.to_changelog(f"{at}/out", ["n"]))
    return debezium.replay(spark.read.parquet(f"{at}/out"), ["n"], "batch")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["topk_per_window"](spark, sf_dir)
