"""Shared helpers of the training-data operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract here: space, tab to carriage return.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
#: Used where a session on one machine names no spark.checkpoint.dir (tests).
LOCAL_SHARED = "/tmp/checkpoints"
#: Text bytes for each shard that Python code reads whole.
SHARD_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share. On a cluster spark.checkpoint.dir must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or LOCAL_SHARED).rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage is cut, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str = "text") -> Column:
    """Words of a text as an array; none for null and blank texts."""
    trimmed = F.btrim(F.col(text), F.lit(WS_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WS)).otherwise(F.array().cast("array<string>"))


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle that numpy code reads whole: the session's shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shards(docs: DataFrame, column: str = "text") -> int:
    """Partitions for code that reads one whole: the session's shuffle width, or as many as keep a shard's share of the texts bounded."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(width(docs.sparkSession), -(-total // SHARD_BYTES))


def label_model(patterns: DataFrame, good: list[list[float]], bad: list[list[float]], prior: float, rounds: int, belief: float, late: int = 0) -> tuple[float, list[list[float]]]:
    """Generative label model by expectation-maximisation, as one native expression over the histogram of patterns.

    patterns: v (array of votes, each from -1; the last `late` entries are features that only the final round
    uses, to train the classifier on the label model's posteriors) and n (rows with that pattern): a bounded
    table, its rows being distinct vote patterns. good, bad: for each entry the probability of each of its values
    in either class as believed beforehand; each round mixes a share `belief` of these into its estimates (a MAP
    estimate at a strength that does not change with the corpus). prior: the starting log odds of the class.
    Returns the bias and, for each entry, the weight of each value: log odds of the good class. A vote of 1 never
    counts against the class, a vote of -1 never for it. An empty table returns the beliefs.
    """
    n, values = len(good), len(good[0])
    table = lambda rows: "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in w) + ")" for w in rows) + ")"
    first = [[math.log(g / b) if i < n - late else 0.0 for g, b in zip(gs, bs)] for i, (gs, bs) in enumerate(zip(good, bad))]
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    odds = "m.b + aggregate(zip_with(m.w, p.v, (w, v) -> w[v + 1]), 0D, (a, y) -> a + y)"
    posts = f"transform(ps, p -> named_struct('v', p.v, 'n', p.n, 'g', p.n / (1 + exp(-({odds})))))"
    totals = "named_struct('g', aggregate(post, 0D, (a, p) -> a + p.g) + 1, 'b', aggregate(post, 0D, (a, p) -> a + p.n - p.g) + 1)"
    sums = "aggregate(post, named_struct('g', 0D, 'b', 0D), (a, p) -> if(p.v[j] = x, named_struct('g', a.g + p.g, 'b', a.b + p.n - p.g), a))"
    mixed = lambda c: f"{1 - belief!r}D * s.{c} / t.{c} + {belief!r}D * p0.{c}[j][x + 1]"
    ratio = let("s", sums, f"ln({mixed('g')}) - ln({mixed('b')})")
    held = f"case when j >= {n - late} then if(i > {rounds}, {ratio}, 0D) when x = 1 then greatest(0D, {ratio}) when x = -1 then least(0D, {ratio}) else {ratio} end"
    weights = f"transform(sequence(0, {n - 1}), j -> transform(sequence(-1, {values - 2}), x -> {held}))"
    step = let("post", posts, let("t", totals, f"named_struct('b', ln(t.g / t.b), 'w', {weights})"))
    fitted = f"aggregate(sequence(1, {rounds + bool(late)}), named_struct('b', {prior!r}D, 'w', {table(first)}), (m, i) -> if(size(ps) = 0, m, {step}))"
    m = patterns.agg(F.array_sort(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("ps"))
    m = m.withColumn("p0", F.expr(f"named_struct('g', {table(good)}, 'b', {table(bad)})")).select(F.expr(fitted).alias("m")).first()["m"]
    return m["b"], [list(w) for w in m["w"]]


def fold(modulus: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves this rest: the held-out fold. False for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))
