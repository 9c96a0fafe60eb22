"""Row hashes and partition transforms."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def multi_hash(*cols: str | Column) -> Column:
    """16 bytes over any columns, nulls included."""
    return F.unhex(F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})))


def years(ts: str | Column) -> Column:
    return F.year(ts) - 1970


def months(ts: str | Column) -> Column:
    return (F.year(ts) - 1970) * 12 + F.month(ts) - 1


def days(ts: str | Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def hours(ts: str | Column) -> Column:
    return F.floor(F.unix_seconds(F.to_timestamp(ts)) / 3600).cast("int")


def truncate(col: str | Column, width: int, numeric: bool = False) -> Column:
    """Numbers to multiples of width towards minus infinity, strings to width characters."""
    return (F.col(col) if isinstance(col, str) else col) - F.pmod(col, F.lit(width)) if numeric else F.substring(col, 1, width)


MASK = 0xFFFFFFFF
#: Constants of the 32-bit Murmur3 hash (fixed values).
C1, C2, ADD, FINAL1, FINAL2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _and(a: Column, b: int) -> Column:
    return a.bitwiseAND(F.lit(b).cast("long"))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which stands once in the plan however often f names it."""
    return F.transform(F.array(x), f)[0]


def _times(x: Column, b: int) -> Column:
    """x * b modulo 2^32 in longs that don't overflow."""
    return _let(x, lambda a: _and(a * F.lit(b & 0xFFFF).cast("long") + F.shiftleft(_and(a * F.lit(b >> 16).cast("long"), 0xFFFF), 16), MASK))


def _rotated(x: Column, n: int) -> Column:
    return _let(x, lambda a: _and(F.shiftleft(a, n), MASK).bitwiseOR(F.shiftright(a, 32 - n)))


def _word(k: Column) -> Column:
    return _times(_rotated(_times(k, C1), 15), C2)


def _mixed(h: Column, k: Column) -> Column:
    return _and(_times(_rotated(h.bitwiseXOR(_word(k)), 13), 5) + F.lit(ADD).cast("long"), MASK)


def _finished(h: Column, length: Column) -> Column:
    folded = lambda x, n: _let(x, lambda a: a.bitwiseXOR(F.shiftright(a, n)))
    return folded(_times(folded(_times(folded(h.bitwiseXOR(length), 16), FINAL1), 13), FINAL2), 16)


def murmur3(c: Column, kind: T.DataType) -> Column:
    """Murmur3 with seed 0 as an unsigned long: whole numbers, dates (days) and times (microseconds) as 8 bytes, text and bytes as they are."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        h = F.hex(F.encode(c, "utf-8") if isinstance(kind, T.StringType) else c)
        n = F.octet_length(c).cast("long")
        # bytes i.. of the hexadecimal text as a number, lowest first
        little = lambda at, size: F.conv(F.concat(*[F.substring(h, at + 2 * j + 1, F.when(F.lit(j) < size, 2).otherwise(0)) for j in (3, 2, 1, 0)]), 16, 10).cast("long")
        blocks = F.filter(F.sequence(F.lit(0).cast("long"), F.floor(n / 4)), lambda i: i < F.floor(n / 4))
        body = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, i: _mixed(a, little((i * 8).cast("int"), F.lit(4))))
        rest = n % 4
        tail = F.when(rest > 0, _word(little((n - rest).cast("int") * 2, rest))).otherwise(0)
        return _finished(body.bitwiseXOR(tail), n)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    v = c.cast("long")
    return _let(v, lambda x: _finished(_mixed(_mixed(F.lit(0).cast("long"), _and(x, MASK)), _and(F.shiftright(x, 32), MASK)), F.lit(8).cast("long")))


def bucket(col: str | Column, n: int, kind: T.DataType | None = None) -> Column:
    """Table bucket of a value, as table formats define it; kind: its type, whole numbers by default. Nulls have none."""
    return _and(murmur3(F.col(col) if isinstance(col, str) else col, kind or T.LongType()), 0x7FFFFFFF).cast("int") % n


def transform(spec: str, schema: T.StructType) -> tuple[str, Column]:
    """Name and value of a partition column: 'city', 'day(ts)', 'bucket(16, id)', 'truncate(10, id)'."""
    m = re.fullmatch(r"(?i)\s*(?:(\w+)\s*\(\s*(?:(\d+)\s*,\s*)?[`\"]?(\w+)[`\"]?\s*(?:,\s*(\d+)\s*)?\)|[`\"]?(\w+)[`\"]?)\s*", spec)
    if not m:
        raise ValueError(f"not a partition transform: {spec}")
    how, col, width = (m[1] or "identity").lower().removesuffix("s"), m[3] or m[5], m[2] or m[4]
    if col not in schema.names:
        raise ValueError(f"no column {col} for the partition {spec}")
    kind = schema[col].dataType
    if how == "identity":
        return col, F.col(col)
    if how in ("year", "month", "day", "hour"):
        return f"{col}_{how}", {"year": years, "month": months, "day": days, "hour": hours}[how](col)
    if how in ("bucket", "truncate") and width and int(width) > 0:
        value = bucket(col, int(width), kind) if how == "bucket" else truncate(col, int(width), numeric=isinstance(kind, T.NumericType))
        return f"{col}_{'bucket' if how == 'bucket' else 'trunc'}", value
    raise ValueError(f"unknown partition transform: {spec}")
