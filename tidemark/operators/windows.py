"""Event-time windows: tumbling, hopping, session; nested re-windowing and the two-step hop."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}


def micros(duration: str) -> int:
    """Microseconds of '1 hour 30 minutes'."""
    found = re.findall(r"(\d+)\s*([a-z]+?)s?\b", duration.lower())
    if not found or any(u not in UNITS for _, u in found):
        raise ValueError(f"bad duration: {duration}")
    return sum(int(n) * UNITS[u] for n, u in found)


def tumble(ts: str | Column, width: str) -> Column:
    """Epoch-aligned window [start, start + width) as struct<start, end>."""
    return F.window(ts, width)


def check_hop(slide: str, width: str) -> None:
    if micros(width) % micros(slide):
        raise ValueError(f"hop() width {width} must be a multiple of slide {slide}")


def hop(ts: str | Column, slide: str, width: str) -> Column:
    """Hopping windows; the slide comes first and must divide the width. Equal ones make a tumbling window."""
    check_hop(slide, width)
    return F.window(ts, width) if micros(slide) == micros(width) else F.window(ts, width, slide)


def session(ts: str | Column, gap: str) -> Column:
    """Sessions of events at most gap apart (exactly gap apart: merged)."""
    return F.session_window(ts, gap)


def window_agg(df: DataFrame, window: Column, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates by window and keys; partial sums before the shuffle are Spark's own. Column window stays a struct."""
    return df.groupBy(window.alias("window"), *keys).agg(*aggs)


#: Aggregates that can be put together from slide-sized panes: name -> how panes merge.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def hop_two_step(df: DataFrame, ts: str, slide: str, width: str, keys: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Hop for large width / slide: aggregate to panes of one slide, then give each pane, not each row, to its windows.

    aggs: output name -> (count | sum | min | max | avg, column). The same rows as hop() with fewer rows shuffled.
    """
    check_hop(slide, width)
    panes = []
    for name, (kind, col) in aggs.items():
        for k in ("sum", "count") if kind == "avg" else (kind,):
            panes.append(getattr(F, k)(col).alias(f"_{k}_{name}"))
    step, n = micros(slide), micros(width) // micros(slide)
    p = df.groupBy(F.window(ts, slide).alias("_p"), *keys).agg(*panes)
    p = p.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    start = F.expr(f"_p.start - make_dt_interval(0, 0, 0, {step} / 1000000.0D * _i)") if step % 10**6 else F.expr(f"_p.start - make_dt_interval(0, 0, 0, {step // 10**6} * _i)")
    p = p.withColumn("_start", start)
    out = []
    for name, (kind, _) in aggs.items():
        out.append((F.sum(f"_sum_{name}") / F.sum(f"_count_{name}")).alias(name) if kind == "avg" else MERGE[kind](f"_{kind}_{name}").alias(name))
    g = p.groupBy("_start", *keys).agg(*out)
    total = micros(width) // 10**6
    return g.select(F.struct(F.col("_start").alias("start"), (F.expr(f"_start + make_dt_interval(0, 0, 0, {total})")).alias("end")).alias("window"), *keys, *aggs)


def rewindow(df: DataFrame, width: str, window: str = "window") -> Column:
    """Window over an already windowed input: its rows count at the window's last instant."""
    return F.window(F.window_time(window), width)


def global_sessions(df: DataFrame, ts: str, gap: str, aggs: dict[str, tuple[str, str]], span: str = "1 day") -> DataFrame:
    """Sessions over all events, without a key, that no single task has to sort.

    Sessions are found within time spans first. Only the first and the last of a span can go on in another one: these, two a span, are put together
    in one partition. aggs: output name -> (count | sum | min | max, column)."""
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / micros(span))
    local = df.groupBy(at.alias("_b"), F.session_window(ts, gap).alias("_w")).agg(*[getattr(F, kind)(c).alias(name) for name, (kind, c) in aggs.items()])
    local = local.select("_b", F.col("_w.start").alias("_s"), F.col("_w.end").alias("_e"), *aggs)
    # the aggregates go along in the comparison: without any, Spark does not merge the sessions of a group at all
    whole = F.struct("_s", *aggs)
    edge = local.groupBy("_b").agg(F.min(whole).alias("_f"), F.max(whole).alias("_l")).select("_b", F.col("_f._s").alias("_first"), F.col("_l._s").alias("_last"))
    marked = local.join(edge, "_b").withColumn("_inner", (F.col("_s") != F.col("_first")) & (F.col("_s") != F.col("_last")))
    inner = marked.where("_inner").select("_s", "_e", *aggs)
    outer = marked.where("not _inner").select("_s", "_e", *aggs)
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    joined = outer.withColumn("_new", F.coalesce(F.col("_s") > F.max("_e").over(before), F.lit(True)).cast("int"))
    joined = joined.withColumn("_g", F.sum("_new").over(Window.orderBy("_s")))
    stitched = joined.groupBy("_g").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), *[MERGE[kind](name).alias(name) for name, (kind, _) in aggs.items()])
    return inner.unionByName(stitched.drop("_g")).select(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end")).alias("window"), *aggs)
