"""Changelogs in Debezium form: unroll to retract / append rows, encode, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_id(keys: list[str]) -> Column:
    """16 bytes that identify a row by its primary key."""
    return F.unhex(F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})))


def unroll(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """before, after, op -> the row's columns with _updating_meta(is_retract, id): c and r append, d retracts, u does both. Other ops fail."""
    retract = lambda side, flag: F.struct(F.lit(flag).alias("is_retract"), F.col(side).alias("row"))
    events = (
        F.when(F.col("op").isin("c", "r"), F.array(retract("after", False)))
        .when(F.col("op") == "u", F.array(retract("before", True), retract("after", False)))
        .when(F.col("op") == "d", F.array(retract("before", True)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast(df.select(F.array(retract("after", False)).alias("x")).schema["x"].dataType))
    )
    extra = [order] if order else []
    x = df.select(*extra, F.posexplode(events).alias("_pos", "_e")).select(*extra, "_pos", "_e.is_retract", "_e.row.*")
    return x.withColumn("_updating_meta", F.struct("is_retract", row_id(keys).alias("id"))).drop("is_retract")


def encode(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Retract / append rows of one batch -> at most one event for each key: c, u, d, or none if it came and went or nothing changed."""
    cols = [c for c in df.columns if c not in (*order, "_updating_meta")]
    at, row = F.struct(*order), F.struct(*cols)
    flag = F.col("_updating_meta.is_retract")
    g = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min_by(flag, at).alias("_f"), F.max_by(flag, at).alias("_l"), F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"))
    before, after = F.when(F.col("_f"), F.col("_first")), F.when(~F.col("_l"), F.col("_last"))
    op = F.when(F.col("_f") & F.col("_l"), "d").when(F.col("_f"), "u").when(~F.col("_l"), "c")
    return g.select(before.alias("before"), after.alias("after"), op.alias("op")).where("op is not null and not (op = 'u' and before <=> after)")


def to_debezium(df: DataFrame) -> DataFrame:
    """Append-only rows as create events."""
    row = F.struct(*df.columns)
    return df.select(F.when(F.lit(False), row).alias("before"), row.alias("after"), F.lit("c").alias("op"))


def replay(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Final rows of a changelog: the last event of each key, unless it deletes."""
    key = [F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(k) for k in keys]
    last = changes.select(*key, order, "op", "after").groupBy(*keys).agg(F.max_by(F.struct("op", "after"), order).alias("_l"))
    return last.where("_l.op <> 'd'").select("_l.after.*")
