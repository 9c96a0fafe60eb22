"""A corpus pipeline of five stages over the documents table; each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, pii, quality, simhash
from tidemark.llm.common import materialize, read_table
from tidemark.llm.queries import VOCABULARY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps. Null, empty and blank texts go; rows that repeat an id or text are judged each by its own text and alike
    if the texts are; an empty table stays empty; further columns are carried."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id (a null id comes last), of its texts the one with the least hash.
    Repeated rows are one; null ids and unlike texts under one id stay apart; texts without words form one group; an empty table stays empty."""
    return simhash.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, n_chars made to agree. Every row stays: null and empty texts as they are, repeated rows
    alike, very long texts whole; an empty table stays empty."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Rows that share an id are taken together, null ids as one id, a null source
    is a source; documents without words follow their hash; an empty table stays empty."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their digest and that of the text decoded from them. One row for each row; null texts have no ids; an empty
    table gives an empty result."""
    return bpe.encoded(docs, VOCABULARY, ids=True)


STAGES = [("quality", keep_good), ("simhash", drop_near_copies), ("pii", redact), ("mixing", mix), ("bpe", encode)]

#: SQL has no expectation-maximisation: tests/llm hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
