"""Formats: JSON (with Debezium), raw text and bytes, Parquet; framing and bad-data handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def debezium_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("before", schema), T.StructField("after", schema), T.StructField("op", T.StringType())])


def _millis(t: T.DataType) -> T.DataType:
    """A type with every timestamp as the long that stands for it."""
    if isinstance(t, T.TimestampType):
        return T.LongType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_millis(t.elementType), t.containsNull)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _millis(f.dataType), f.nullable) for f in t.fields])
    return t


def _from_millis(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.TimestampType):
        return F.timestamp_millis(c)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _from_millis(x, t.elementType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_from_millis(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
    return c


def _encoded(c: Column, t: T.DataType, millis: bool, text: bool) -> Column:
    if millis and isinstance(t, T.TimestampType):
        return F.unix_millis(c)
    if text and isinstance(t, T.DecimalType):
        return c.cast("string")
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _encoded(x, t.elementType, millis, text))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_encoded(c[f.name], f.dataType, millis, text).alias(f.name) for f in t.fields]))
    return c


def _by_millis(options: dict[str, str]) -> bool:
    """Timestamps are milliseconds where the options say so, and in changelogs unless they say otherwise."""
    usual = "unix_millis" if options.get("format") == "debezium_json" else "rfc3339"
    return options.get("json.timestamp_format", usual).lower() in ("unix_millis", "unixmillis")


def plain(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """df with timestamps and decimals in the form that json.timestamp_format and json.decimal_encoding name."""
    millis, text = _by_millis(options), options.get("json.decimal_encoding", "number").lower() == "string"
    if not (millis or text):
        return df
    return df.select(*[_encoded(F.col(f"`{f.name}`"), f.dataType, millis, text).alias(f.name) for f in df.schema.fields])


#: How JSON is written: every field, timestamps to the microsecond.
JSON_OUT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "ignoreNullFields": "false"}


def decode(df: DataFrame, schema: T.StructType, options: dict[str, str], keep: dict[str, str] | None = None) -> DataFrame:
    """value (text or bytes) -> columns. bad_data=drop leaves out what does not parse, else it fails. keep: further columns of df by their new names."""
    kind = options.get("format", "json")
    extra = [F.col(f"`{c}`").alias(f"_kept_{name}") for name, c in (keep or {}).items()]
    df, text = df.select(*extra, "value"), F.col("value").cast("string")
    kept = [F.col(c) for c in df.columns[:-1]]
    if options.get("framing", options.get("framing.method")) == "newline":
        longest = int(options.get("framing.max_length", 0))
        lines = df.select(*kept, F.explode(F.split(text, "\n")).alias("value")).where("value <> ''")
        if longest:  # a longer frame is an error, not a part of one
            lines = lines.select(*kept, F.when(F.octet_length("value") <= longest, F.col("value")).otherwise(F.raise_error(F.lit(f"a frame is longer than {longest} bytes")).cast("string")).alias("value"))
        df, text = lines, F.col("value")
    named = [F.col(f"_kept_{name}").alias(name) for name in keep or {}]
    if kind in ("raw_string", "raw_bytes"):
        return df.select(text.alias("value") if kind == "raw_string" else F.col("value").cast("binary").alias("value"), *named)
    if kind not in ("json", "debezium_json"):
        raise ValueError(f"format {kind} needs a package that isn't installed")
    if options.get("json.unstructured") == "true":
        return df.select(text.alias("value"), *named)
    full = debezium_schema(schema) if kind == "debezium_json" else schema
    millis = _by_millis(options)
    read = T.StructType([T.StructField(f.name, _millis(f.dataType) if millis else f.dataType, f.nullable) for f in full.fields])
    if options.get("bad_data") == "drop":
        marked = T.StructType([*read.fields, T.StructField("_corrupt", T.StringType())])
        rows = df.select(*kept, F.from_json(text, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_v")).where("_v._corrupt is null")
    else:
        rows = df.select(*kept, F.from_json(text, read, {"mode": "FAILFAST"}).alias("_v"))
    field = lambda f: F.col("_v")[f.name]
    return rows.select(*[(_from_millis(field(f), f.dataType) if millis else field(f)).alias(f.name) for f in full.fields], *named)


def encode(df: DataFrame, options: dict[str, str]) -> Column:
    """Rows as one text column for message sinks."""
    if options.get("format") == "raw_string":
        return F.col("value").cast("string")
    millis, text = _by_millis(options), options.get("json.decimal_encoding", "number").lower() == "string"
    return F.to_json(F.struct(*[_encoded(F.col(f"`{f.name}`"), f.dataType, millis, text).alias(f.name) for f in df.schema.fields]), JSON_OUT)
