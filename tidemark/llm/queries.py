"""The operators of this subpackage as queries over the tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chaining, chroma, langid, mixing, pii, quality, rindex, simhash, toxicity
from .common import read_table

#: The vocabulary file's place; every machine has the package at the same path.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.searched(chroma.rendered(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def op2_rindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex.deduplicated(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.classes(read_table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.labelled(read_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read_table(spark, sf_dir, "documents"), VOCABULARY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chroma, op2_rindex, op3_quality, op4_simhash, op5_pii, op6_mixing, op7_toxicity, op8_chaining, op9_langid, op10_bpe)}

ORACLE: dict[str, str] = {
    "op6_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER k - cap)) / (sum(w) OVER () - (sum(w) OVER k - w)) AS level,
    row_number() OVER (ORDER BY cap / w, r) AS k FROM w WINDOW k AS (ORDER BY cap / w, r ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, CASE WHEN w * level >= cap THEN cap ELSE w * first_value(level) OVER (ORDER BY (w * level >= cap), k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END AS passes FROM t),
g AS (SELECT source, h, sum(size) AS sz FROM d GROUP BY source, h),
c AS (SELECT source, h, sz, sum(sz) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - sz AS before FROM g)
SELECT d.doc_id, d.size, p.source_size, p.target,
    (d.size * (p.passes + CASE WHEN p.passes < 2 AND c.before + c.sz / 2 <= p.target - p.passes * p.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h""",
}
