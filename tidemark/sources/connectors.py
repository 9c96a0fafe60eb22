"""Connectors by name: what each can do, its options, and how it is read and written with Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing
from ..plans.validate import PlanError
from . import formats, generators, web

COMMON = {"connector", "format", "type", "event_time_field", "watermark_field", "bad_data", "framing", "framing.method", "framing.max_length", "idle_micros", "json.unstructured", "json.debezium", "json.include_schema", "json.timestamp_format", "json.decimal_encoding", "lookup.cache.max_bytes", "lookup.cache.ttl"}
#: Connector -> the options of its own. A trailing dot allows a family of options.
OPTIONS: dict[str, set[str]] = {
    "kafka": {"bootstrap_servers", "topic", "source.", "sink.", "auth.", "schema_registry.", "client_configs"},
    "confluent": {"bootstrap_servers", "topic", "source.", "sink.", "auth.", "schema_registry."},
    "kinesis": {"stream_name", "aws_region", "source.", "sink."},
    "fluvio": {"endpoint", "topic", "source."},
    "nats": {"servers", "subject", "stream", "auth.", "consumer."},
    "mqtt": {"url", "topic", "qos", "username", "password", "tls.", "sink."},
    "rabbitmq": {"host", "port", "username", "password", "virtual_host", "stream", "source.", "tls."},
    "redis": {"address", "cluster.addresses", "target", "target.", "username", "password"},
    "filesystem": {"path", "compression_format", "source.", "partition_fields", "time_partition_pattern", "rollover_seconds", "target_file_size", "storage.", "filename.", "parquet.", "shuffle_by_partition.", "rolling_policy.", "file_naming.", "partitioning."},
    "delta": {"path", "storage.", "rollover_seconds", "target_file_size", "partition_fields"},
    "iceberg": {"catalog.", "namespace", "table_name", "storage.", "rolling_policy."},
    "single_file": {"path", "wait_for_control", "compression"},
    "impulse": {"event_rate", "interval", "message_count", "start_time"},
    "nexmark": {"event_rate", "runtime", "message_count", "start_time"},
    "sse": {"endpoint", "events", "headers"},
    "websocket": {"endpoint", "headers", "subscription_message", "subscription_messages"},
    "polling_http": {"endpoint", "headers", "method", "body", "poll_interval_ms", "emit_behavior"},
    "webhook": {"endpoint", "headers"},
    "stdout": set(), "blackhole": set(), "preview": set(), "memory": set(),
}
#: Options of the dialect that nothing here could honour; giving one is an error, not a silent difference.
REFUSED: dict[str, str] = {
    "idle_micros": "Spark has no idle inputs: a watermark waits for the slowest one",
    "json.include_schema": "results carry no schema envelope",
    "rollover_seconds": "files end with the batch that writes them", "target_file_size": "file sizes follow the partitions", "rolling_policy.": "files end with the batch that writes them",
    "file_naming.": "Spark names the files", "filename.": "Spark names the files", "wait_for_control": "there is no control channel",
    "cluster.addresses": "only single Redis servers are known",
}
TIMESTAMP_FORMATS, DECIMAL_ENCODINGS = {"rfc3339", "unix_millis", "unixmillis"}, {"number", "string"}
#: Which connectors are sources and sinks; redis is a lookup source.
SOURCES = dict.fromkeys(["kafka", "confluent", "kinesis", "fluvio", "nats", "mqtt", "rabbitmq", "filesystem", "single_file", "impulse", "nexmark", "sse", "websocket", "polling_http"], True)
SINKS = dict.fromkeys(["kafka", "confluent", "kinesis", "fluvio", "nats", "mqtt", "redis", "filesystem", "delta", "iceberg", "single_file", "webhook", "stdout", "blackhole", "preview"], True)
#: Those that Spark reads and writes by a package or a registered data source of the same name.
EXTERNAL = {"kafka": "kafka", "confluent": "kafka", "kinesis": "kinesis", "fluvio": "fluvio", "nats": "nats", "mqtt": "mqtt", "rabbitmq": "rabbitmq", "redis": "redis", "delta": "delta", "iceberg": "iceberg", "sse": "sse", "websocket": "websocket", "polling_http": "polling_http", "webhook": "webhook"}

#: Those that tidemark.sources.web speaks itself.
WEB = {"polling_http", "sse", "websocket", "webhook"}


def check(options: dict[str, str]) -> None:
    """Unknown connectors and options are errors."""
    name = options.get("connector", "memory")
    if name not in OPTIONS:
        raise PlanError(f"unknown connector '{name}'")
    own = OPTIONS[name]
    for k in options:
        if k not in COMMON and k not in own and not any(o.endswith(".") and k.startswith(o) for o in own):
            raise PlanError(f"unknown option '{k}' for connector '{name}'")
        for refused, why in REFUSED.items():
            if k == refused or (refused.endswith(".") and k.startswith(refused)):
                raise PlanError(f"option '{k}' is not supported: {why}")
    if options.get("json.timestamp_format", "rfc3339").lower() not in TIMESTAMP_FORMATS:
        raise PlanError("json.timestamp_format must be rfc3339 or unix_millis")
    if options.get("json.decimal_encoding", "number").lower() not in DECIMAL_ENCODINGS:
        raise PlanError("json.decimal_encoding must be number or string")


def external_options(options: dict[str, str]) -> dict[str, str]:
    """Options for the external source: for Kafka in the names its Spark source knows, else as given."""
    if options["connector"] in ("kafka", "confluent"):
        offset = {"earliest": "earliest", "latest": "latest", "group": "latest"}[options.get("source.offset", "latest")]
        return {"kafka.bootstrap.servers": options["bootstrap_servers"], "subscribe": options["topic"], "startingOffsets": offset, "kafka.isolation.level": options.get("source.read_mode", "read_uncommitted")}
    return {k: v for k, v in options.items() if k not in COMMON}


#: Metadata of messages: key of the dialect -> column of the source.
METADATA = {"kafka": {"offset_id": "offset", "partition": "partition", "topic": "topic", "timestamp": "timestamp", "key": "key"}, "mqtt": {"topic": "topic"}}
METADATA["confluent"] = METADATA["kafka"]


def metadata_columns(connector: str, wanted: dict[str, str]) -> dict[str, str]:
    """Column of the source for each metadata column of a table; PlanError for keys that the connector does not have."""
    known = METADATA.get(connector, {})
    for key in wanted.values():
        if key not in known:
            raise PlanError(f"connector '{connector}' has no metadata '{key}'")
    return {name: known[key] for name, key in wanted.items()}


def read(spark: SparkSession, options: dict[str, str], schema: T.StructType, stream: bool = False, metadata: dict[str, str] | None = None) -> DataFrame:
    """metadata: column of the table -> key of the message's metadata."""
    name = options["connector"]
    if name not in SOURCES:
        raise PlanError(f"connector '{name}' is not a source")
    if name == "impulse":
        interval = int(float(options.get("interval", f"{1000 / float(options.get('event_rate', 1))}").split()[0]))
        return generators.impulse(spark, int(options.get("message_count", 1000)), max(1, interval), options.get("start_time", "2023-01-01T00:00:00Z"))
    if name == "nexmark":
        return generators.nexmark(spark, int(options.get("message_count", 10_000)), options.get("start_time", "2023-01-01T00:00:00Z"), int(options.get("event_rate", 1000)))
    reader = spark.readStream if stream else spark.read
    if name in ("filesystem", "single_file"):
        if options.get("format") == "parquet":
            if options.get("source.regex-pattern"):
                reader = reader.option("pathGlobFilter", options["source.regex-pattern"])
            return reader.schema(schema).parquet(options["path"])
        return formats.decode(reader.text(options["path"]), schema, options)
    if name in WEB:
        web.register(spark)
    raw = reader.format(EXTERNAL[name]).options(**external_options(options)).load()
    return formats.decode(raw, schema, options, metadata_columns(name, metadata or {}))


def write(df: DataFrame, options: dict[str, str], partitions: list[str] | None = None) -> None:
    """Writes a bounded result. Partitioned files are shuffled by their partition first, so each lands in few files."""
    name = options["connector"]
    if name not in SINKS:
        raise PlanError(f"connector '{name}' is not a sink")
    if name in ("filesystem", "single_file"):
        cols = [c.strip() for c in options.get("partition_fields", "").split(",") if c.strip()]
        for name, value in [] if cols else [hashing.transform(p, df.schema) for p in partitions or []]:
            df, cols = df.withColumn(name, value), [*cols, name]
        if pattern := options.get("time_partition_pattern"):
            java = pattern.replace("%Y", "yyyy").replace("%m", "MM").replace("%d", "dd").replace("%H", "HH").replace("%M", "mm")
            df, cols = df.withColumn("time", F.date_format(options.get("event_time_field", "_timestamp"), java)), ["time", *cols]
        if cols and options.get("shuffle_by_partition.enabled") == "true":
            df = df.repartition(*cols)
        w = df.write.mode("append").partitionBy(*cols)
        if options.get("format") == "parquet":
            w.option("compression", options.get("parquet.compression", "zstd")).parquet(options["path"])
        else:
            formats.plain(df, options).write.mode("append").partitionBy(*cols).options(**formats.JSON_OUT).json(options["path"])
    elif name == "stdout":
        df.select(formats.encode(df, options).alias("value")).write.format("console").save()
    elif name == "blackhole":
        df.write.format("noop").mode("overwrite").save()
    elif name == "preview":
        df.createOrReplaceTempView("preview")
    elif name == "redis":
        web.write_redis(df.withColumn("_value", formats.encode(df, options)), options)
    else:
        if name in WEB:
            web.register(df.sparkSession)
        df.select(formats.encode(df, options).alias("value")).write.format(EXTERNAL[name]).options(**external_options(options)).mode("append").save()
