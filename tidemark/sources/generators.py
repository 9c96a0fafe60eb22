"""Generated sources: impulse and a Nexmark-like auction stream, as functions of the row number (so reruns agree)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def impulse(spark: SparkSession, count: int, interval_ms: int = 1000, start: str = "2023-01-01T00:00:00Z", subtasks: int = 1) -> DataFrame:
    """timestamp, counter, subtask_index: one event every interval."""
    ts = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(start))) + F.col("id") * interval_ms * 1000)
    return spark.range(count).select(ts.alias("timestamp"), F.col("id").alias("counter"), (F.col("id") % subtasks).alias("subtask_index"))


#: Of 50 events in a row, 1 is a person, 3 are auctions and 46 are bids (fixed values).
PERSONS, AUCTIONS, BIDS = 1, 3, 46


def nexmark(spark: SparkSession, count: int, start: str = "2023-01-01T00:00:00Z", rate: int = 1000) -> DataFrame:
    """person, auction, bid: exactly one of the three structs is set in each row."""
    total = PERSONS + AUCTIONS + BIDS
    n, at = F.col("id"), F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit(start))) + F.col("id") * (10**6 // rate))
    kind, era = n % total, F.floor(n / total)
    pick = lambda salt, limit: F.pmod(F.xxhash64(n, F.lit(salt)), limit)
    persons, auctions = era + 1, era * AUCTIONS + F.least(kind, F.lit(AUCTIONS)) + 1
    city = F.element_at(F.array(*map(F.lit, ["Phoenix", "Boise", "Portland", "Seattle", "Bend"])), (pick(1, F.lit(5)) + 1).cast("int"))
    person = F.struct(era.alias("id"), F.concat(F.lit("person "), era.cast("string")).alias("name"), F.concat(F.lit("p"), era.cast("string"), F.lit("@example.com")).alias("email_address"), F.lpad(pick(2, F.lit(10**12)).cast("string"), 16, "4").alias("credit_card"), city.alias("city"), F.lit("OR").alias("state"), at.alias("datetime"), F.lit("").alias("extra"))
    price = (pick(3, F.lit(10**4)) + 100).cast("long")
    auction = F.struct((era * AUCTIONS + kind - 1).cast("long").alias("id"), F.lit("item").alias("item_name"), F.lit("").alias("description"), price.alias("initial_bid"), (price * 2).alias("reserve"), at.alias("datetime"), (at + F.expr("interval 10 minutes")).alias("expires"), pick(4, persons).alias("seller"), (pick(5, F.lit(5)) + 10).alias("category"), F.lit("").alias("extra"))
    bid = F.struct(pick(6, auctions).alias("auction"), pick(7, persons).alias("bidder"), (pick(8, F.lit(10**6)) + 1).alias("price"), F.lit("web").alias("channel"), F.lit("https://example.com/").alias("url"), at.alias("datetime"), F.lit("").alias("extra"))
    return spark.range(count).select(F.when(kind < PERSONS, person).alias("person"), F.when((kind >= PERSONS) & (kind < PERSONS + AUCTIONS), auction).alias("auction"), F.when(kind >= PERSONS + AUCTIONS, bid).alias("bid"), at.alias("_timestamp"))
