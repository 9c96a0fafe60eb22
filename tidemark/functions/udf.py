"""User-defined functions: scalar, aggregate and asynchronous, vectorised over Arrow batches."""

from __future__ import annotations

import asyncio
import typing
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {int: "bigint", float: "double", str: "string", bool: "boolean", bytes: "binary"}


def return_type(f: Callable) -> str:
    """SQL type of an annotated return value; Optional is its inner type."""
    t = typing.get_type_hints(f).get("return")
    args = [a for a in typing.get_args(t) if a is not type(None)]
    t = args[0] if args else t
    if t not in TYPES:
        raise TypeError(f"{f.__name__} needs a return annotation among {[x.__name__ for x in TYPES]}")
    return TYPES[t]


def register_scalar(spark: SparkSession, name: str, f: Callable) -> Callable:
    """A Python function of annotated types as a SQL function; null arguments give null unless annotated Optional."""
    optional = any(type(None) in typing.get_args(t) for k, t in typing.get_type_hints(f).items() if k != "return")
    g = f if optional else (lambda *a: None if any(x is None for x in a) else f(*a))
    u = F.udf(g, return_type(f), useArrow=True)
    spark.udf.register(name, u)
    return u


def register_aggregate(spark: SparkSession, name: str, f: Callable[[pd.Series], object], kind: str) -> Callable:
    """A function of whole columns as a SQL aggregate."""

    def run(s: pd.Series) -> float:
        return f(s)

    run.__annotations__ = {"s": pd.Series, "return": {"bigint": int, "double": float, "string": str}[kind]}
    u = F.pandas_udf(run, kind)
    spark.udf.register(name, u)
    return u


def async_map(df: DataFrame, column: str, f: Callable[[object], Awaitable[object]], name: str, kind: str, timeout: float = 5.0, in_flight: int = 1000, ordered: bool = True) -> DataFrame:
    """df with a column of awaited results. Calls of a batch run concurrently, at most in_flight at once; one that exceeds the timeout fails the task."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, `{name}` {kind}"

    async def gather(values: list[object]) -> list[tuple[int, object]]:
        gate, out = asyncio.Semaphore(in_flight), []

        async def one(i: int, v: object) -> None:
            async with gate:
                out.append((i, await asyncio.wait_for(f(v), timeout)))

        await asyncio.gather(*(one(i, v) for i, v in enumerate(values)))
        return sorted(out, key=lambda x: x[0]) if ordered else out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = asyncio.run(gather(pdf[column].tolist()))
            out = pdf.iloc[[i for i, _ in done]].copy()
            out[name] = [v for _, v in done]
            yield out

    return df.mapInPandas(run, schema)
