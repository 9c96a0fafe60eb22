"""Connected components as DataFrames: nothing is collected but one number a round."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, tag: str) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b: long).

    Every round a node takes the least label among its own and its neighbours', then the label of its label
    (pointer jumping), so the rounds grow with the logarithm of the longest path. Each round is written to the
    shared folder; the joins are plain ones, which adaptive execution splits where a node has many edges.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, f"{tag}-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{tag}-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        step = materialize(step, f"{tag}-step")
        up = step.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        labels = materialize(step.join(up, step.root == up.n2).select("node", "old", F.col("r2").alias("root")), f"{tag}-labels")
        if not labels.where("old <> root").limit(1).count():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes that edges (a, b: long) connect: of every partition one less than the nodes of a component, not one a pair."""

    def spanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = x = root[y]
            return x

        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        pairs = [(x, top(x)) for x in list(root)]
        yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")

    return edges.select("a", "b").mapInPandas(spanned, "a long, b long")
