"""JSON access that keeps JSON text, as functions (-> is a lambda arrow in Spark SQL)."""

from __future__ import annotations

import json as _json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PATH = re.compile(r"\$(?:\.[A-Za-z_][\w-]*|\[\d+\]|\[\*\]|\['[^']+'\]|\.\*)*")


def check_path(path: str) -> str:
    if not PATH.fullmatch(path):
        raise ValueError(f"bad JSON path: {path}")
    return path


def get_first_json_object(text: str | Column, path: str) -> Column:
    """First match as JSON text: strings keep their quotes. Bad JSON gives null."""
    v = F.variant_get(F.try_parse_json(text), check_path(path), "variant") if "*" not in path else None
    if v is not None:
        return F.to_json(v)
    return F.element_at(extract_json(text, path), 1)


def extract_json_string(text: str | Column, path: str) -> Column:
    """First match if it is a string, else null."""
    v = F.variant_get(F.try_parse_json(text), check_path(path), "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _matches(value: object, steps: list[str]) -> list[object]:
    for i, s in enumerate(steps):
        if s in ("*", "[*]"):
            inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
            return [y for x in inner for y in _matches(x, steps[i + 1 :])]
        if s.startswith("[") and isinstance(value, list) and int(s[1:-1]) < len(value):
            value = value[int(s[1:-1])]
        elif not s.startswith("[") and isinstance(value, dict) and s in value:
            value = value[s]
        else:
            return []
    return [value]


def extract_json(text: str | Column, path: str) -> Column:
    """All matches as a list of JSON texts, vectorised over Arrow batches."""
    steps = [a or (f"[{b}]" if b is not None and b != "" else c) for a, b, c in re.findall(r"\.([\w*-]+)|\[(\d+|\*)\]|\['([^']+)'\]", check_path(path))]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            try:
                return None if t is None else [_json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in _matches(_json.loads(t), steps)]
            except ValueError:
                return None

        return texts.map(one)

    return run(F.col(text) if isinstance(text, str) else text)


def json_get_str(text: str | Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(text), f"$['{key}']", "string")


def json_get_int(text: str | Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(text), f"$['{key}']", "long")


def json_get_float(text: str | Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(text), f"$['{key}']", "double")


def json_get_bool(text: str | Column, key: str) -> Column:
    return F.try_variant_get(F.try_parse_json(text), f"$['{key}']", "boolean")


def json_get_json(text: str | Column, key: str) -> Column:
    return F.to_json(F.variant_get(F.try_parse_json(text), f"$['{key}']", "variant"))


def json_contains(text: str | Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(text), key)


def json_length(text: str | Column) -> Column:
    return F.coalesce(F.json_array_length(text), F.size(F.json_object_keys(text)))
