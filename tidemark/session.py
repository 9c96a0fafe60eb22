"""Session factory and table loader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster the submitted configuration wins over these defaults."""
    b = SparkSession.builder.appName("tidemark").master(master)
    for k, v in {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that tasks write and read again: under spark.checkpoint.dir, which all machines share; /tmp only in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{root or '/tmp/tidemark'}/{name}-{uuid.uuid4().hex}"
