"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most BITS (4) bits share at least MATCHES (4) of their 8 bytes, position by position: the guaranteed
minimum. The inverted index lists distinct fingerprints under each byte at each position. Within a list the positional bytes that every
two share are tallied, pairs that reach the minimum are kept, and their differing bits are counted.

A list longer than LIST is too heavy to tally pair by pair. It is split by the byte at each later position, its heavy parts again, down to
MATCHES positions. That loses nothing: a pair shares MATCHES positions p1 < p2 < ..., so it meets in list p1, or if that is heavy in its part
p2, and so on; a list under MATCHES positions holds only pairs that reach the minimum and is walked whatever its length, each fingerprint
reached being compared with those not reached yet. The index starts at as many positions as make lists of LIST fingerprints of even
bytes, which would be split anyway. A list hands on edges that connect its links, not all its pairs.

Null and blank texts have fingerprint zero and link like any other. Rows that repeat a doc_id or text are treated
alike; a null doc_id never becomes a component's id unless the component has no other. An empty table gives an
empty result; columns other than doc_id and text are carried or ignored, never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, width
from .graph import components

SHINGLE, SEED, BITS, MATCHES = 4, 42, 4, 4
#: Fingerprints in a list up to which shared bytes are tallied for every two.
LIST = 400


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # both know the ASCII letters and white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, n - shingle + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[:k].tolist(), ends[min(shingle, n) - 1 :].tolist())), np.uint64, k)
    ones = np.zeros(64, np.int64)
    for at in range(0, k, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > k, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (long, the 64 bits) and further columns of longs for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp} | {c: pdf[c] for c in more})

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text", *more).mapInPandas(run, "doc_id long, fp long" + "".join(f", {c} long" for c in more))


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges (member, root) that join the fingerprints of one list into its components."""
    out, rest = [], np.unique(fps)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(np.bitwise_xor(rest, queue.pop())) <= bits
            if near.any():
                queue.extend(rest[near])
                out.extend((int(x), int(root)) for x in rest[near])
                rest = rest[~near]
    return out


def tallied(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges between the fingerprints of one list that share MATCHES positional bytes and differ in at most bits."""
    fps = np.unique(fps)
    rows = fps.view(np.uint8).reshape(-1, 8)
    shared = np.zeros((len(fps), len(fps)), np.uint8)
    for p in range(8):
        column = np.ascontiguousarray(rows[:, p])
        shared += column[:, None] == column
    i, j = np.nonzero(np.triu(shared >= MATCHES, 1))
    near = np.bitwise_count(fps[i] ^ fps[j]) <= bits
    i, j = i[near], j[near]
    if len(i) <= 4 * len(fps):
        return list(zip(fps[i].tolist(), fps[j].tolist()))
    return forest(fps[np.unique(np.concatenate([i, j]))], bits)  # many near copies: edges that connect them


def index_key(positions: tuple[int, ...]) -> Column:
    """A list's name: its positions and the bytes found there."""
    k = F.lit(sum(1 << p for p in positions)).cast("long")
    for p in positions:
        k = F.shiftleft(k, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
    return k


def within_lists(index: DataFrame, pairs: Callable[[np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """a, b: the edges that pairs finds in each list of index (key, fp); a list lies in one partition, its rows side by side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, held = None, []  # the list that goes on in the next batch
        for pdf in batches:
            keys, fp = pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = np.concatenate([[0], cuts, [len(keys)]])
            edges: list[tuple[int, int]] = []
            sizes = np.diff(bounds)
            # lists of one row inside the batch meet nobody
            for g in sorted({0, len(sizes) - 1} | set(np.flatnonzero(sizes > 1).tolist())):
                a, b = bounds[g], bounds[g + 1]
                if keys[a] != open_key:
                    if sum(map(len, held)) > 1:
                        edges += pairs(np.concatenate(held))
                    open_key, held = keys[a], []
                held.append(fp[a:b])
            if edges:
                yield pd.DataFrame(np.array(edges, np.uint64).view(np.int64), columns=["a", "b"])
        if sum(map(len, held)) > 1 and (edges := pairs(np.concatenate(held))):
            yield pd.DataFrame(np.array(edges, np.uint64).view(np.int64), columns=["a", "b"])

    n = width(index.sparkSession)
    return index.repartition(n, "key").sortWithinPartitions("key").mapInPandas(run, "a long, b long")


def links(fps: DataFrame, longest: int = LIST) -> DataFrame:
    """a, b: edges between distinct fingerprints that connect all that differ in at most BITS bits."""
    count, depth = fps.count(), 1
    while depth < MATCHES and count > longest << (8 * depth):
        depth += 1
    # positions of a list leave room for MATCHES in all
    chosen = [c for c in combinations(range(8), depth) if c[-1] <= 8 - MATCHES + depth - 1]
    entry = lambda c: F.struct(index_key(c).alias("key"), F.lit(c[-1]).alias("last"))
    index = fps.select("fp", F.explode(F.array(*map(entry, chosen))).alias("e")).select("e.key", "e.last", "fp")
    out: list[DataFrame] = []
    while True:
        if depth == MATCHES:
            return reduce(DataFrame.union, [*out, within_lists(index.select("key", "fp"), forest)])
        index = materialize(index, "simhash-index")
        heavy = materialize(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > longest).select("key"), "simhash-heavy")
        out.append(within_lists(index.join(heavy, "key", "left_anti").select("key", "fp"), tallied))
        if not heavy.limit(1).count():
            return reduce(DataFrame.union, out)
        depth += 1
        # a key holds a byte for each position below the mask of positions
        mask, byte = F.shiftright("key", 8 * (depth - 1)), lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
        split = lambda p: F.shiftleft(mask + (1 << p), 8 * depth).bitwiseOR(F.shiftleft(F.col("key").bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1)), 8)).bitwiseOR(byte(p))
        parts = F.array(*[F.when(F.col("last") < p, F.struct(split(p).alias("key"), F.lit(p).alias("last"))) for p in range(1, 8 - MATCHES + depth)])
        index = index.join(heavy, "key", "left_semi").select("fp", F.explode(F.array_compact(parts)).alias("e")).select("e.key", "e.last", "fp")


def classes(prints: DataFrame) -> DataFrame:
    """fp, root (its component's least fingerprint), component_id (the smallest doc_id that its links reach) for every distinct fingerprint of prints (doc_id, fp)."""
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    of = components(links(fps), "simhash")
    x = fps.join(of, fps.fp == of.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = x.groupBy("root").agg(F.min("least").alias("component_id"))
    return x.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row."""
    prints = materialize(fingerprints(docs), "simhash-docs")
    return prints.join(classes(prints), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that of its smallest doc_id (null comes last), of its texts the one with the least hash.

    A row is known by its id and its text's hash: rows without an id, or with the same id and other texts, stay apart unless their texts
    are near-duplicates."""
    texts = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    prints = materialize(fingerprints(texts, more=("text_hash",)), "simhash-docs")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_hash"))
    least = prints.groupBy("fp").agg(F.min(row).alias("row")).join(classes(prints), "fp").groupBy("root").agg(F.min("row").alias("row"))
    kept = least.select("row._kept", "row._hash")
    same = docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]) & (F.xxhash64(docs["text"]) == kept["_hash"])
    rows = docs.join(kept, same, "left_semi").withColumn("_text_hash", F.xxhash64("text"))
    return rows.dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
