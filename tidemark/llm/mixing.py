"""Mixing sources to target weights by hash-threshold histograms (native).

A document's size is its number of words. Sources in code-point order (null last) weigh 3, 1, 2, repeating,
and share 150 % of all words; a target stops at twice its source's words and what is above is reshared by
weight. Each source takes floor(target / words) whole passes, and the rest from the documents whose hash is
below a threshold. The threshold is found without sorting documents: words are summed by source and leading
hash bits, the bucket in which the budget ends is found, and only that bucket is refined by the next bits.

Documents that share a hash (repeated rows, equal ids) are taken or left together. Null texts have size 0;
null doc_ids hash as an empty string. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_of

BITS, LEVELS = 13, 4
SHARE, STOP = 1.5, 2.0


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h: 52 hash bits of doc_id."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    return docs.select("doc_id", "source", F.size(words_of()).cast("long").alias("size"), h.alias("h"))


def targets(x: DataFrame) -> DataFrame:
    """source, source_size, target: one row per source. Water-filling in closed form: sources fill up in order of cap / weight."""
    s = x.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # from here on one row per source: the single partition of these windows is as large as the list of sources
    s = s.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("_w", F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), (((F.col("_r") - 1) % 3) + 1).cast("int")))
    s = s.withColumn("_cap", STOP * F.col("source_size"))
    every, before = Window.partitionBy(F.lit(1)), Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    run = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_left", SHARE * F.sum("source_size").over(every) - (F.sum("_cap").over(run) - F.col("_cap")))
    s = s.withColumn("_open", F.sum("_w").over(every) - (F.sum("_w").over(run) - F.col("_w")))
    s = s.withColumn("_level", F.col("_left") / F.col("_open"))
    s = s.withColumn("_full", F.col("_w") * F.col("_level") >= F.col("_cap"))
    s = s.withColumn("_k", F.row_number().over(before))
    s = s.withColumn("_last", F.min_by("_level", F.when(~F.col("_full"), F.col("_k"))).over(every))
    return s.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_last")).alias("target"))


def thresholds(x: DataFrame, t: DataFrame) -> DataFrame:
    """source, source_size, target, passes, cut, take_cut: take documents with h below cut once more, and those at it if take_cut."""
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(2.0), F.floor(F.col("target") / F.col("source_size")))).otherwise(0.0)
    state = t.withColumn("passes", passes.cast("long"))
    state = state.withColumn("_rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("_prefix", F.lit(0).cast("long")).withColumn("_base", F.lit(0).cast("long")).withColumn("_sum", F.lit(0).cast("long"))
    keys = x.select(F.col("source").alias("_s"), "h", "size").where("size > 0")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = keys.join(state.select("source", "_prefix"), F.col("_s").eqNullSafe(F.col("source")) & (F.shiftright("h", shift + BITS) == F.col("_prefix")))
        hist = inside.groupBy("_s", F.shiftright("h", shift).alias("_b")).agg(F.sum("size").alias("_sz"))
        w = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("_cum", F.sum("_sz").over(w))
        hit = hist.join(state, F.col("_s").eqNullSafe(F.col("source"))).where(F.col("_base") + F.col("_cum") > F.col("_rest"))
        edge = hit.groupBy("_s").agg(F.min(F.struct("_b", "_cum", "_sz")).alias("_e"))
        state = state.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "target", "passes", "_rest",
            F.coalesce(F.col("_e._b"), F.lit(0)).cast("long").alias("_prefix"),
            (F.col("_base") + F.coalesce(F.col("_e._cum") - F.col("_e._sz"), F.lit(0))).cast("long").alias("_base"),
            F.coalesce(F.col("_e._sz"), F.lit(0)).cast("long").alias("_sum"),
        )
        state = materialize(state, "mix-level")
    return state.select("source", "source_size", "target", "passes", F.col("_prefix").alias("cut"), (F.col("_base") + F.col("_sum") / 2 <= F.col("_rest")).alias("take_cut"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    x = materialize(sized(docs.select("doc_id", "source", "text")), "mix-sizes")
    t = thresholds(x, materialize(targets(x), "mix-targets"))
    y = x.join(t.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    more = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("take_cut"))
    more = more & (F.col("passes") < 2)
    return y.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + more.cast("long"))).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row as often (0, 1 or 2 times) as the mix takes it; documents without words follow their hash too."""
    x = materialize(sized(docs.select("doc_id", "source", "text")), "mix-sizes")
    t = thresholds(x, materialize(targets(x), "mix-targets"))
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")
    y = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    y = y.join(t, F.col("_row.source").eqNullSafe(F.col("source"))).withColumn("_h", h)
    more = ((F.col("_h") < F.col("cut")) | ((F.col("_h") == F.col("cut")) & F.col("take_cut"))) & (F.col("passes") < 2)
    times = (F.col("passes") + more.cast("long")).cast("int")
    return y.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")
