"""The same queries on streams: watermarks, a final flush, top-k per batch and retracting aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import updating

#: Far enough in the future to close every window of the data.
SENTINEL = "2200-01-01"


def read_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def with_event_time(df: DataFrame, ts: str, delay: str = "1 second") -> DataFrame:
    """Event time as a zoned timestamp with a watermark; the default delay is one second."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def write_sentinel(spark: SparkSession, schema: str, ts: str, path: str, fmt: str = "parquet", values: dict | None = None) -> None:
    """Adds a row that lies beyond every window, so that a bounded stream's last windows close. Its own window never does.
    values: columns that mustn't be null, such as the keys of an inner join: rows that a filter drops first don't move the watermark."""
    row = spark.range(1).select(*[F.lit(SENTINEL if f.name == ts else (values or {}).get(f.name)).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema])
    row.write.mode("append").format(fmt).save(path)


def run_to_end(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append", empty_batches: bool = True) -> None:
    """Runs over all there is, then stops; sink gets each batch and its number (the same number again after a failure).
    empty_batches: also batches without input, which close windows; False for processing-time timers, which would ask for such batches for ever."""
    spark, name = df.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(empty_batches).lower())
    try:  # a query copies the settings when it starts
        q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    q.awaitTermination()


def to_table(path: str, then: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its number, so that a repeated batch replaces itself.
    then: work on a closed window's rows, such as top-k: in append mode they arrive in one batch."""

    def sink(batch: DataFrame, number: int) -> None:
        (then(batch) if then else batch).write.mode("overwrite").format(fmt).save(f"{path}/batch={number}")

    return sink


def updating_to_changelog(state: str, out: str, keys: list[str], ttl: str | None = None, at: str | None = None, gone: Column | None = None, fmt: str = "parquet", form: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for update mode that turns new values into c, u and d events against the rows last written.

    state/n holds the aggregate after batch n: a repeated batch starts from n - 1 again and gives the same events; older states are deleted.
    Keys may be null. gone: a key whose new value meets this is retracted, such as a count of 0. ttl, at: keys whose event time (column at) lies
    further back than ttl from the latest one are retracted and forgotten. form: how events are written."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        old = spark.read.schema(batch.schema).parquet(f"{state}/{number - 1}") if number else batch.limit(0)
        same = _same(keys)
        kept = old.alias("o").join(batch.select(*keys).alias("n"), same, "left_anti").unionByName(batch)
        new = kept.where(~F.coalesce(gone, F.lit(False))) if gone is not None else kept
        if ttl and at:
            latest = new.agg(F.max(at)).first()[0]
            if latest is not None:
                new = new.where(F.col(at).isNull() | ~updating.is_expired(at, ttl, F.lit(latest)))
        new.write.mode("overwrite").parquet(f"{state}/{number}")
        new = spark.read.schema(batch.schema).parquet(f"{state}/{number}")
        events = updating.changes(old, new, keys)
        (form(events) if form else events).write.mode("overwrite").format(fmt).save(f"{out}/batch={number}")
        batch.unpersist()
        _delete(spark, f"{state}/{number - 2}")

    return sink


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return on


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
