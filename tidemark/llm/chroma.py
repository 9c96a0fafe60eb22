"""Chroma audio fingerprints.

A recording (16-bit mono PCM) becomes frames of the 12 pitch classes' energies. Sixteen filters, sums over rectangles of frames and
classes read from an integral image, are quantised to two bits each and packed into one 32-bit integer for every frame position.
Two recordings are aligned by seeds, integers that differ in no more than MAX_ERROR of their bits (an offset whose share of differing bits
is accepted has one at least): the seeds' offsets form a histogram, every offset in it is tried, the one with the least share of
differing bits over the overlap is taken (of equal ones that with the most seeds), and that share decides. So no pair is missed that some offset accepts. Equal integers as seeds would miss most of the accepted range, and keys of
few enough bits to find it meet in nearly every pair, so a query is compared with every recording, a block of queries with a block of
recordings by products of their bits' signs (recordings of more than LONG integers query by query): the work is queries x recordings, only
pairs that align leave a task.

The tables hold no audio, so `render` plays each vector of `embeddings` as a tune: one note for each component. Null and empty vectors
and recordings shorter than one filter have no integers: they form one class and link to nothing. Repeated recordings have the same
integers and are searched once, as a class. An empty table gives an empty result; only the id and media columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import materialize, width

RATE, FRAME, HOP, NOTE = 4000, 1024, 320, 320
LOWEST, HIGHEST = 110.0, 1760.0
#: This operator's own format: filters (kind, first pitch class, classes, frames) in order, and three cuts that quantise each.
FILTERS = [(0, 0, 3, 15), (1, 4, 4, 14), (2, 4, 4, 11), (3, 0, 4, 14), (4, 8, 2, 4), (5, 5, 6, 15), (1, 9, 2, 16), (3, 8, 4, 10), (3, 4, 4, 14), (3, 8, 2, 4), (4, 4, 4, 8), (5, 0, 6, 6), (0, 8, 4, 12), (2, 0, 8, 16), (4, 0, 6, 10), (1, 0, 6, 8)]
CUTS = (-0.08, 0.0, 0.08)
SPAN = 16  # frames that the widest filter takes
MAX_ERROR, MIN_OVERLAP = 0.18, 24
BLOCK = 512  # recordings that are compared at once
LONG = 512  # integers of a recording up to which queries are compared together


def render(vector: np.ndarray) -> bytes:
    """A vector as PCM: component i is note i, its rank among two octaves of semitones, its size the loudness."""
    v = np.asarray(vector, float)
    if not v.size:
        return b""
    peak = np.abs(v).max() or 1.0
    pitch = 220.0 * 2 ** (np.round((v / peak + 1) * 12) / 12)
    t = np.arange(NOTE) / RATE
    tone = np.sin(2 * np.pi * pitch[:, None] * t) + 0.4 * np.sin(4 * np.pi * pitch[:, None] * t)
    return (tone * (6000 + 8000 * np.abs(v)[:, None] / peak)).astype("<i2").tobytes()


def _classes() -> np.ndarray:
    """Spectrum bins -> pitch classes, as a matrix."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12))
    ok = (f >= LOWEST) & (f <= HIGHEST)
    out[np.flatnonzero(ok), np.round(12 * np.log2(f[ok] / 440.0)).astype(int) % 12] = 1
    return out


def chroma(pcm: bytes) -> np.ndarray:
    """Normalised energies (frames, 12)."""
    x = np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2").astype(float)
    if len(x) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP] * np.hanning(FRAME)
    c = (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ _classes()
    norm = np.sqrt((c * c).sum(1, keepdims=True))
    return np.where(norm > 1e-3, c / np.maximum(norm, 1e-3), 0)


def integers(c: np.ndarray) -> np.ndarray:
    """Packed integers of chroma frames: one for each position at which every filter fits."""
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(x0: np.ndarray, y0: int, x1: np.ndarray, y1: int) -> np.ndarray:
        return image[x1, y1] - image[x0, y1] - image[x1, y0] + image[x0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        a, b, y2 = at, at + w, y + h
        whole = area(a, y, b, y2)
        half_w, half_h, third_w, third_h = w // 2, h // 2, w // 3, max(1, h // 3)
        part = {
            0: lambda: whole / 2,
            1: lambda: area(a, y, b, y + half_h),
            2: lambda: area(a, y, a + half_w, y2),
            3: lambda: area(a, y, a + half_w, y + half_h) + area(a + half_w, y + half_h, b, y2),
            4: lambda: area(a, y + third_h, b, y + 2 * third_h) if h >= 3 else area(a, y, b, y + half_h),
            5: lambda: area(a + third_w, y, a + 2 * third_w, y2),
        }[kind]()
        value = np.log1p(part) - np.log1p(whole - part) if kind else np.log1p(whole) - np.log1p(area(a, 0, b, 12) - whole)
        two = np.searchsorted(CUTS, value)
        out = (out << np.uint32(2)) | (two ^ (two >> 1)).astype(np.uint32)  # Gray code: neighbours differ by a bit
    return out


def fingerprints(media: DataFrame) -> DataFrame:
    """id, prints (array of the packed integers as int) from id, pcm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "prints": [integers(chroma(p or b"")).view(np.int32) for p in pdf["pcm"]]})

    return media.mapInPandas(run, "id long, prints array<int>")


def rendered(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id, pcm: the media column made from a table of vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                yield pd.DataFrame({"id": part["id"], "pcm": [render(np.nan_to_num(np.array([x if x is not None else 0 for x in v], float))) if v is not None else b"" for v in part["v"]]})

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).mapInPandas(run, "id long, pcm binary")


def paired(x: np.ndarray) -> np.ndarray:
    """Each integer with the one after it in one of 64 bits."""
    return x[:-1].astype(np.uint64) | (x[1:].astype(np.uint64) << np.uint64(32))


def compared(query: np.ndarray, rows: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least share of differing bits over the offsets that have a seed, and its offset (of equal ones that with the most seeds, then the nearest), for each of rows.

    rows: recordings of one length as columns, pairs: paired(rows); a share of 2 where no offset of MIN_OVERLAP or more has a share that can
    be accepted. Differing bits are counted by pairs of integers; seeds only where these are few enough."""
    n, m = len(query), len(rows)
    error, best, most = np.full(rows.shape[1], 2.0), np.zeros(rows.shape[1], np.int64), np.zeros(rows.shape[1], np.int64)
    asked = paired(query)
    for offset in sorted(range(MIN_OVERLAP - n, m - MIN_OVERLAP + 1), key=lambda o: (abs(o), -o)):
        q, r = max(0, -offset), max(0, offset)
        overlap = min(n - q, m - r)
        if overlap < MIN_OVERLAP:
            continue
        limit, begun = (MAX_ERROR + 1e-6) * 32 * overlap, overlap // 2 * 2
        left = np.bitwise_count(pairs[r : r + begun : 2] ^ asked[q : q + begun : 2, None]).sum(0, dtype=np.uint16)
        i = np.flatnonzero(left <= limit)
        if len(i):
            bits = np.bitwise_count(rows[r : r + overlap, i] ^ query[q : q + overlap, None])
            seeds, e = (bits <= int(32 * MAX_ERROR)).sum(0), bits.sum(0, dtype=np.uint32) / (32 * overlap)
            better = (seeds > 0) & ((e < error[i]) | ((e == error[i]) & (seeds > most[i])))
            k = i[better]
            error[k], best[k], most[k] = e[better], offset, seeds[better]
    return error, best


def signed(x: np.ndarray) -> np.ndarray:
    """Bits of integers (recordings, integers) as 1 and -1, one after another."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1)
    return bits.astype(np.float32) * np.float32(2) - np.float32(1)


def compared_at_once(queries: np.ndarray, rows: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As compared, for queries of one length together (by row): products of signs are equal bits less differing ones, whole numbers that a float holds.

    signs: signed(rows.T)."""
    n, m = queries.shape[1], len(rows)
    asked, queries = signed(queries), queries.T
    shape = asked.shape[0], rows.shape[1]
    error, best, most = np.full(shape, 2.0), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for offset in sorted(range(MIN_OVERLAP - n, m - MIN_OVERLAP + 1), key=lambda o: (abs(o), -o)):
        q, r = max(0, -offset), max(0, offset)
        overlap = min(n - q, m - r)
        if overlap < MIN_OVERLAP:
            continue
        product = asked[:, 32 * q : 32 * (q + overlap)] @ signs[:, 32 * r : 32 * (r + overlap)].T
        a, i = np.nonzero(product >= 32 * overlap * (1 - 2 * (MAX_ERROR + 1e-6)))
        if len(i):
            bits = np.bitwise_count(rows[r : r + overlap, i] ^ queries[q : q + overlap, a])
            seeds, e = (bits <= int(32 * MAX_ERROR)).sum(0), bits.sum(0, dtype=np.uint32) / (32 * overlap)
            better = (seeds > 0) & ((e < error[a, i]) | ((e == error[a, i]) & (seeds > most[a, i])))
            k = a[better], i[better]
            error[k], best[k], most[k] = e[better], offset, seeds[better]
    return error, best


def alignments(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """query, other, offset, bit_error for every pair of classes whose best offset has few enough differing bits.

    classes, queries: class_id, prints. Only the classes of queries are looked up; copies are one class, so nothing is listed twice.
    """
    head = {"id": "<i8", "n": "<i4"}

    def blocks(d: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), BLOCK):
                    part = pdf.iloc[at : at + BLOCK]
                    n = np.array([len(p) for p in part["prints"]], np.int32)
                    yield pd.DataFrame({name: [pack({"id": part["class_id"].to_numpy(np.int64), "n": n}, b"".join(np.asarray(p, "<i4").tobytes() for p in part["prints"]))]})

        return d.where(f"class_id is not null and size(prints) >= {MIN_OVERLAP}").select("class_id", "prints").mapInPandas(run, f"{name} binary")

    def opened(block: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
        c, body = unpack(block, head)
        return c["id"], np.split(np.frombuffer(body, "<u4"), np.cumsum(c["n"])[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, o in zip(pdf["q"], pdf["o"]):
                (asks, wanted), (ids, prints) = opened(q), opened(o)
                length, asked = np.array([len(p) for p in prints]), np.array([len(p) for p in wanted])
                for n in np.unique(length):
                    at = np.flatnonzero(length == n)
                    rows = np.ascontiguousarray(np.array([prints[i] for i in at]).T)
                    signs = signed(rows.T) if n <= LONG else None
                    for m in np.unique(asked):
                        by = np.flatnonzero(asked == m)
                        queries = np.array([wanted[i] for i in by])
                        if n <= LONG and m <= LONG:
                            error, offset = compared_at_once(queries, rows, signs)
                        else:
                            pairs = paired(rows)
                            error, offset = map(np.array, zip(*(compared(x, rows, pairs) for x in queries)))
                        a, ok = np.nonzero((np.round(error, 6) <= MAX_ERROR) & (ids[at] != asks[by][:, None]))
                        if len(ok):
                            yield pd.DataFrame({"query": asks[by[a]], "other": ids[at[ok]], "offset": offset[a, ok].astype(np.int32), "bit_error": np.round(error[a, ok], 6)})

    queries = queries.repartition(-(-queries.count() // BLOCK) or 1)  # full blocks: the more queries at once, the less each costs
    pairs = blocks(queries, "q").crossJoin(blocks(classes, "o")).repartition(width(classes.sparkSession))
    return pairs.mapInPandas(run, "query long, other long, offset int, bit_error double")


def searched(media: DataFrame, every: int = 50) -> DataFrame:
    """One row for each recording: id, n_prints, class_id (the smallest id with the same integers), is_query, n_links (recordings' classes that
    align with a query's class, or with which a query aligns), best_id, best_offset, best_error. Queries: ids divisible by `every`."""
    prints = materialize(fingerprints(media).withColumn("key", F.xxhash64("prints")), "chroma-prints")
    # a class by its integers; the hash only narrows the groups, the array itself is grouped by
    ids = prints.groupBy("key", "prints").agg(F.min("id").alias("class_id"), F.max((F.col("id") % every == 0).cast("int")).alias("asks"))
    ids = materialize(ids, "chroma-classes")
    links = materialize(alignments(ids.select("class_id", "prints"), ids.where("asks = 1").select("class_id", "prints")), "chroma-links")
    both = links.select(F.col("query").alias("c"), "other", "offset", "bit_error").union(links.select("other", "query", -F.col("offset"), "bit_error"))
    best = both.groupBy("c").agg(F.count_distinct("other").alias("n_links"), F.min(F.struct("bit_error", "other", "offset")).alias("b"))
    x = prints.join(ids.select(F.col("key").alias("_k"), F.col("prints").alias("_p"), "class_id"), (F.col("key") == F.col("_k")) & (F.col("prints") == F.col("_p")))
    x = x.join(best, F.col("class_id") == F.col("c"), "left")
    return x.select("id", F.size("prints").cast("long").alias("n_prints"), "class_id", (F.col("id") % every == 0).alias("is_query"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("b.other").alias("best_id"), F.col("b.offset").alias("best_offset"), F.col("b.bit_error").alias("best_error"))
