"""SQL type names of CREATE TABLE as Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

SIMPLE = {
    "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT2": T.ShortType(),
    "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "INT4": T.IntegerType(), "BIGINT": T.LongType(), "INT8": T.LongType(),
    "TINYINT UNSIGNED": T.ShortType(), "SMALLINT UNSIGNED": T.IntegerType(), "INT2 UNSIGNED": T.IntegerType(), "INT UNSIGNED": T.LongType(),
    "INT4 UNSIGNED": T.LongType(), "INTEGER UNSIGNED": T.LongType(), "BIGINT UNSIGNED": T.DecimalType(20, 0), "INT8 UNSIGNED": T.DecimalType(20, 0),
    "FLOAT": T.FloatType(), "REAL": T.FloatType(), "FLOAT4": T.FloatType(), "DOUBLE": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(), "FLOAT8": T.DoubleType(),
    "CHAR": T.StringType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "STRING": T.StringType(), "JSON": T.StringType(),
    "TIMESTAMP": T.TimestampType(), "DATETIME": T.TimestampType(), "DATE": T.DateType(), "TIME": T.LongType(), "BYTEA": T.BinaryType(), "INTERVAL": T.DayTimeIntervalType(),
}


GENERIC = re.compile(r"(?i)(?:array|struct|map)\s*$")


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts of text between separators that stand outside brackets and quotes. < and > are brackets only behind ARRAY, STRUCT or MAP."""
    parts, depth, quote, start, angles = [], 0, "", 0, 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "<" and GENERIC.search(text, max(start, i - 16), i):
            angles += 1
        elif c == ">" and angles:
            angles -= 1
        elif c == sep and depth == 0 and angles == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [p for p in [*parts, text[start:].strip()] if p]


def spark_type(name: str) -> T.DataType:
    """Spark type of a SQL type name; ValueError for unknown ones and for MAP."""
    s = " ".join(name.strip().split())
    u = s.upper()
    if u in SIMPLE:
        return SIMPLE[u]
    if s.endswith("[]"):
        return T.ArrayType(spark_type(s[:-2]))
    if m := re.fullmatch(r"(?i)ARRAY\s*<(.+)>", s):
        return T.ArrayType(spark_type(m[1]))
    if m := re.fullmatch(r"(?i)STRUCT\s*<(.+)>", s):
        fields = []
        for part in split_top(m[1]):
            field = part.replace(":", " ", 1).split(None, 1)
            if len(field) != 2:
                raise ValueError(f"anonymous struct field: {part}")
            fields.append(T.StructField(field[0].strip('`"'), spark_type(field[1])))
        return T.StructType(fields)
    if m := re.fullmatch(r"(?:NUMERIC|DECIMAL)(?:\((\d+)(?:,\s*(\d+))?\))?", u):
        precision, scale = int(m[1] or 38), int(m[2] or (0 if m[1] else 10))
        if precision > 38:
            raise ValueError(f"decimal precision above 38: {name}")
        return T.DecimalType(precision, scale)
    if m := re.fullmatch(r"(?:TIMESTAMP|DATETIME)\((\d+)\)", u):
        if int(m[1]) not in (0, 3, 6, 9):
            raise ValueError(f"unsupported timestamp precision: {name}")
        return T.TimestampType()
    if re.fullmatch(r"(?:CHAR|VARCHAR)\(\d+\)", u):
        return T.StringType()
    raise ValueError(f"unsupported type: {name}")
