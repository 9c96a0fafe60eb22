"""Unwindowed ("updating") aggregates: batch results, signed inputs and changelogs between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import micros


def sign() -> Column:
    """+1 for an appended row, -1 for a retracted one."""
    return F.when(F.col("_updating_meta.is_retract"), F.lit(-1)).otherwise(F.lit(1))


def signed_agg(df: DataFrame, keys: list[str], sums: dict[str, str], count: str = "count") -> DataFrame:
    """count, sums and averages over a changelog: retractions count negatively, keys whose rows are all gone disappear."""
    aggs = [F.sum(sign()).cast("long").alias(count)] + [F.sum(F.col(c) * sign()).alias(name) for name, c in sums.items()]
    return df.groupBy(*keys).agg(*aggs).where(F.col(count) > 0)


def live_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The multiset of rows that a changelog leaves, for aggregates that cannot be retracted (min, max, median, distinct)."""
    n = df.groupBy(*columns).agg(F.sum(sign()).cast("int").alias("_n")).where("_n > 0")
    return n.withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).select(*columns)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changelog from one snapshot of an aggregate to the next: c, u, d events; unchanged keys are silent."""
    row = lambda d: F.when(F.col(f"{d}._here"), F.struct(*[F.col(f"{d}.{c}") for c in new.columns]))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    j = old.withColumn("_here", F.lit(True)).alias("o").join(new.withColumn("_here", F.lit(True)).alias("n"), on, "full")
    j = j.select(row("o").alias("before"), row("n").alias("after")).where("not (before <=> after)")
    return j.withColumn("op", F.when(F.col("before").isNull(), "c").when(F.col("after").isNull(), "d").otherwise("u"))


def is_expired(ts: str, ttl: str, now: Column) -> Column:
    """Whether a key's last update lies further back than the TTL."""
    return F.col(ts) < now - F.expr(f"INTERVAL {micros(ttl)} MICROSECONDS")
