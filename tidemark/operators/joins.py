"""Joins: windowed, unwindowed with TTL, lookup, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.validate import PlanError
from .windows import micros


def window_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", condition: Column | None = None) -> DataFrame:
    """Joins two inputs with a window column: only rows of the same window match, whatever the condition says."""
    if not all("window" in d.columns for d in (left, right)):
        raise PlanError("can't join windowed and non-windowed inputs")
    if condition is None:
        return left.join(right, ["window", *keys], how)
    l, r = left.alias("l"), right.alias("r")
    on = F.col("l.window") == F.col("r.window")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, on & condition, how)


def updating_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", ttl: str | None = None, times: tuple[str, str] | None = None) -> DataFrame:
    """Unwindowed equi-join of two streams or tables. With a TTL only rows whose event times are at most so far apart meet."""
    if how != "inner":
        raise PlanError("can't handle non-inner joins without windows")
    if ttl and times:
        gap = F.expr(f"INTERVAL {micros(ttl)} MICROSECONDS")
        on = on & (F.col(times[0]) >= F.col(times[1]) - gap) & (F.col(times[1]) >= F.col(times[0]) - gap)
    return left.join(right, on, "inner")


def lookup_join(facts: DataFrame, dimension: DataFrame, fact_key: str, key: str, how: str = "inner") -> DataFrame:
    """Joins to a keyed table that is re-read for each batch. No hint: Spark broadcasts the table if its measured size
    is below spark.sql.autoBroadcastJoinThreshold and shuffles beyond it."""
    if how not in ("inner", "left"):
        raise PlanError("lookup joins must be inner or left joins")
    return facts.join(dimension, facts[fact_key] == dimension[key], how)


def event_time_of(left: str, right: str) -> Column:
    """Event time of a joined row: the larger of both sides, and the one there is on outer rows (greatest skips nulls)."""
    return F.greatest(F.col(left), F.col(right))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, hours: int | None = None) -> DataFrame:
    """For each left row the last non-null value of right with the same key at or before its time, of equal times the largest; no range join.

    Null keys and times match nothing; left rows all stay. Without hours it is one union and one shuffle by the key, whose rows are one task.
    hours: where a key may be hot, its rows are split by spans of so many hours. A span's last value is combined before the shuffle, and what
    one span hands on to the next is found among these, a row a key and span, at the cost of reading the inputs twice."""
    kinds = {"_row": left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType, "_v": right.schema[value].dataType}
    nothing = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    asks = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"), nothing("_v"))
    told = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_left"), nothing("_row"), F.col(value).alias("_v")).where("_k is not null and _t is not null and _v is not null")
    rows, by = asks.unionByName(told), ["_k"]
    if hours:
        rows, by = rows.withColumn("_b", F.floor((F.unix_date(F.col("_t").cast("date")) * 24 + F.hour("_t")) / hours)), ["_k", "_b"]
        earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        last = rows.where("_k is not null").groupBy("_k", "_b").agg(F.max(F.when(F.col("_left") == 0, F.struct("_t", "_v"))).alias("_x"))
        handed = last.select("_k", "_b", F.last("_x", ignorenulls=True).over(earlier).alias("_x")).where("_x is not null and _b is not null")
        rows = rows.unionByName(handed.select("_k", "_x._t", F.lit(0).alias("_left"), nothing("_row"), "_x._v", "_b"))
    w = Window.partitionBy(*by).orderBy("_t", "_left", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left = 1").select("_row.*", F.col("_v").alias(value))
