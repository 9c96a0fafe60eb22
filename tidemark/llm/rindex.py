"""Substring dedup by a run-length index.

Removes every byte covered by a 100-byte string (a window) that also starts earlier in the corpus. Each window has an anchor: the leftmost
of its 32-byte grams with the least hash, a function of the window alone, so equal windows have equal anchors, and a corpus splits by
anchor hash into shards that need nothing of each other. The windows of one anchor position form a context of at most 168 bytes.

1. Anchors of all texts. Contexts are the phrases of a prefix-free parsing, and equal phrases are one entry of its dictionary with its earliest
   place, first within a task, then by shard; later copies of a phrase are marked there. Phrases are told apart by 108 bits of hashes.
2. Anchors with several phrases need their bytes, which are fetched from the texts.
3. A shard puts the phrases of an anchor in the order of their places and halves them, the halves again, and so on. The earlier halves are
   indexed: a run-length Burrows-Wheeler transform with the suffix positions of both ends of each run. The later halves, which are not in the
   index, are streamed through it from their ends, which gives their matching statistics: the length of the longest match at each place and, by
   the samples, a position where it occurs. Where the transform has another symbol, the nearest run ends above and below that have the
   right one are looked up, and the sample that agrees with the match for longer is taken. A window is marked where 100 bytes match, once
   these bytes have been compared with those at the position found. Every two phrases of an anchor meet so exactly once.
4. Marks return to their texts, which lose the bytes covered.

Null and short texts lose nothing. Rows that repeat doc_id and text are one document and get the same result; rows that repeat a doc_id with
other texts come in the order of the texts' hashes; a null doc_id comes last. An empty table gives an empty result; columns other
than doc_id and text are never read. Very long texts are read in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Columns, join, pack, routed, take, unpack
from .common import materialize, shards

LENGTH, GRAM = 100, 32
PIECE = 1 << 19
#: Anchors held by a task, and bytes of contexts that one index covers: bounds of memory that change no result.
FLUSH, SHARD = 300_000, 1 << 20
ENTRY = {"k": "<u8", "c": "<u8", "d": "<i8", "h": "<i8", "a": "<i4", "s": "<i4", "e": "<i4"}
MARK = {"d": "<i8", "h": "<i8", "s": "<i4", "e": "<i4"}
NEED = {"k": "<u8", "d": "<i8", "h": "<i8", "a": "<i4", "s": "<i4", "e": "<i4"}
BASE = 0x9E3779B97F4A7C15 | 1
NO_ID = np.iinfo(np.int64).max


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, and random values for bytes."""

    def __init__(self, n: int):
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)]))
        self.byte = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)

    def sums(self, b: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[b] * self.up[: len(b)], dtype=np.uint64)])


_POWERS: list[Powers] = []


def powers() -> Powers:
    if not _POWERS:
        _POWERS.append(Powers(PIECE + LENGTH))
    return _POWERS[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes) -> Iterator[Columns]:
    """k, c (hashes of anchor and context), a (anchor), s, e (first and last start of its windows), piece by piece."""
    p, w = powers(), LENGTH - GRAM + 1
    for base in range(0, max(0, len(text) - LENGTH + 1), PIECE):
        b = np.frombuffer(text, np.uint8, min(len(text) - base, PIECE + LENGTH - 1), base)
        sums = p.sums(b)
        n = len(b) - GRAM + 1
        gram = mix((sums[GRAM:] - sums[:n]) * p.down[:n])
        # the least hash in a window, of equal ones the leftmost: its place is in the low bits
        low = (gram & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64)
        m = 1
        while 2 * m <= w:
            low = np.minimum(low[:-m], low[m:])
            m *= 2
        low = np.minimum(low[: n - w + 1], low[w - m : w - m + n - w + 1]) if m < w else low
        first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(low) - 1]])
        key = low[first]
        a = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
        c = mix((sums[last + LENGTH] - sums[first]) * p.down[first]) + (last - first).astype(np.uint64) * np.uint64(0x9E3779B1) + (a - first).astype(np.uint64) * np.uint64(0x85EBCA77)
        yield {"k": key >> np.uint64(20), "c": c, "a": (a + base).astype(np.int32), "s": (first + base).astype(np.int32), "e": (last + base).astype(np.int32)}


def firsts(x: Columns) -> tuple[Columns, np.ndarray]:
    """Entries in the order (k, c, place), and for each the index of the first of its context."""
    x = take(x, np.lexsort((x["a"], x["h"], x["d"], x["c"], x["k"])))
    new = np.concatenate([[True], (x["k"][1:] != x["k"][:-1]) | (x["c"][1:] != x["c"][:-1])]) if len(x["k"]) else np.zeros(0, bool)
    return x, np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, int)


def copies(x: Columns, first: np.ndarray) -> np.ndarray:
    """Indices of entries that stand later than the first of their context (a repeated row stands at the same place)."""
    return np.flatnonzero((x["d"] != x["d"][first]) | (x["h"] != x["h"][first]) | (x["a"] != x["a"][first]))


class RunIndex:
    """Run-length BWT of phrases (symbol arrays, each closed by a symbol of its own) with suffix positions sampled at run ends."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        bits = max(1, int(text.max(initial=1)).bit_length())
        half = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for j in range(half):  # as many symbols as one integer holds, then ranks by twice as many each round
            key <<= bits
            key[: n - j] |= text[j:]
        while True:
            sa = np.argsort(key)
            ranked = key[sa]
            new = np.concatenate([[0], (ranked[1:] != ranked[:-1]).cumsum()])
            if new[-1] == n - 1:
                break
            rank = np.empty(n, np.int64)
            rank[sa] = new
            key = rank * (n + 1)
            key[: n - half] += rank[half:] + 1
            half *= 2
        last = text[sa - 1]  # of the first suffix: the text's end, which closes it
        self.heads = np.concatenate([[0], np.flatnonzero(last[1:] != last[:-1]) + 1])
        sizes = np.diff(np.append(self.heads, n))
        self.symbol = last[self.heads]
        # runs by symbol, so that the runs of a symbol beside any row are found by a search
        by = np.argsort(self.symbol, kind="stable")
        self.place = np.empty(len(by), np.int64)
        self.place[by] = np.arange(len(by))
        self.keys, self.sorted, self.sizes = self.symbol[by] * n + self.heads[by], self.symbol[by], sizes[by]
        self.before = np.cumsum(self.sizes) - self.sizes  # symbols less than c, and c in earlier runs: C[c] + rank
        self.top, self.bottom = sa[self.heads[by]], sa[self.heads[by] + self.sizes - 1]
        self.start = int(sa[0])
        p = powers() if n <= PIECE else grown(n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * p.up[:n], dtype=np.uint64)])
        self.down = p.down

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of what the text has in common from a and from b on, up to most: by halving and hashes."""
        got = np.zeros(len(a), np.int64)
        size = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        top = np.minimum(most, self.n - np.maximum(a, b))
        while size:
            ok = np.flatnonzero(got + size <= top)
            x, y = a[ok] + got[ok], b[ok] + got[ok]
            got[ok[(self.sums[x + size] - self.sums[x]) * self.down[x] == (self.sums[y + size] - self.sums[y]) * self.down[y]]] += size
            size >>= 1
        return got

    def stream(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of text[start:end], from the ends, in step: (which, place, position in the index) wherever LENGTH symbols match."""
        order = np.argsort(starts - ends, kind="stable")
        starts, ends = starts[order], ends[order]
        lengths = ends - starts
        row, at = np.zeros(len(order), np.int64), np.full(len(order), self.start, np.int64)
        matched = np.zeros(len(order), np.int64)
        for t in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-lengths, -t, "left"))  # phrases longer than t
            place = ends[:m] - 1 - t
            c = text[place]
            run = np.searchsorted(self.heads, row[:m], "right") - 1
            other = np.flatnonzero(self.symbol[run] != c)
            up = np.searchsorted(self.keys, c[other] * self.n + row[other], "right") - 1
            row[:m] = self.before[self.place[run]] + row[:m] - self.heads[run]
            at[:m] -= 1
            if len(other):
                want, was, most = c[other], at[other] + 1, matched[other]
                below = np.minimum(up + 1, len(self.keys) - 1)
                above = np.maximum(up, 0)
                has_up, has_down = (up >= 0) & (self.sorted[above] == want), (up + 1 < len(self.keys)) & (self.sorted[below] == want)
                high = np.where(has_up, self.common(was, self.bottom[above], most), -1)
                low = np.where(has_down, self.common(was, self.top[below], most), -1)
                use_low = low > high
                best = np.maximum(low, high)
                found = best >= 0
                row[other] = np.where(found, np.where(use_low, self.before[below], self.before[above] + self.sizes[above] - 1), 0)
                at[other] = np.where(found, np.where(use_low, self.top[below], self.bottom[above]) - 1, self.start)
                matched[other] = best  # one less than what matches now; -1 where the index has no such symbol
            matched[:m] += 1
            full = np.flatnonzero(matched[:m] >= LENGTH)
            if len(full):
                yield order[full], place[full], at[full]


_GROWN: list[Powers] = []


def grown(n: int) -> Powers:
    """Powers for an index longer than a piece (many phrases of one anchor)."""
    if not _GROWN or len(_GROWN[0].up) <= n:
        _GROWN[:] = [Powers(2 * n)]
    return _GROWN[0]


def spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each length, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def same_bytes(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a and b agree over LENGTH symbols from x and y on."""
    ok = np.ones(len(x), bool)
    for j in range(LENGTH):
        ok &= a[x + j] == b[y + j]
    return ok


def indexed(x: Columns, body: bytes) -> Columns:
    """Marks in phrases x, whose bytes stand one after another in body."""
    size = (x["e"] - x["s"] + LENGTH).astype(np.int64)
    at = np.cumsum(size) - size
    order = np.lexsort((x["a"], x["h"], x["d"], x["k"]))
    x, size, at = take(x, order), size[order], at[order]
    raw = np.frombuffer(body, np.uint8)
    first = np.flatnonzero(np.concatenate([[True], x["k"][1:] != x["k"][:-1]])) if len(size) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(size)))
    rank, count = np.arange(len(size)) - np.repeat(first, count), np.repeat(count, count)
    out = []
    for bit in range(int(count.max(initial=1) - 1).bit_length()):
        node = rank >> (bit + 1)  # only phrases of the same node meet: each has symbols of its own
        later = np.flatnonzero(rank >> bit & 1)
        earlier = np.flatnonzero((rank >> bit & 1 == 0) & ((2 * node + 1) << bit < count))
        many = len(earlier)

        def symbols(i: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
            n = size[i]
            starts = np.cumsum(n + gap) - n - gap
            text = np.zeros(int((n + gap).sum()), np.int64)
            text[spread(n, starts)] = raw[spread(n, at[i])] + (many + 256 * np.repeat(node[i], n))
            return text, starts

        text, starts = symbols(earlier, 1)
        text[starts + size[earlier]] = np.arange(many)
        query, begins = symbols(later, 0)
        index = RunIndex(text)
        for who, place, found in index.stream(query, begins, begins + size[later]):
            ok = same_bytes(query, place, text, found)
            who, place = who[ok], place[ok]
            w = later[who]
            s = (x["s"][w] + place - begins[who]).astype(np.int32)
            out.append({"d": x["d"][w], "h": x["h"][w], "s": s, "e": s})
    return join(out, MARK)


def merged(m: Columns) -> Columns:
    """Marks with neighbouring starts put together."""
    m = take(m, np.lexsort((m["s"], m["h"], m["d"])))
    if not len(m["d"]):
        return m
    new = np.concatenate([[True], (m["d"][1:] != m["d"][:-1]) | (m["h"][1:] != m["h"][:-1])])
    row = np.cumsum(new).astype(np.int64) << 32  # so that the running maximum starts anew with each document
    cut = new | np.concatenate([[True], (row + m["s"])[1:] > np.maximum.accumulate(row + m["e"])[:-1] + 1])
    at = np.flatnonzero(cut)
    return take(m, at) | {"e": np.maximum.reduceat(m["e"], at)}


def _rows(p: list[tuple[int, bytes]], kind: int) -> pd.DataFrame:
    return pd.DataFrame({"p": [r for r, _ in p], "kind": kind, "block": [b for _, b in p]}).astype({"p": "int32", "kind": "int32"})


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    n = shards(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("d", F.coalesce("doc_id", F.lit(NO_ID)))

    def by_doc(m: Columns) -> list[tuple[int, bytes]]:
        return [(r, pack(c)) for r, c in routed(m, (m["d"] % n).astype(np.int64))]

    def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Columns] = []

        def flush() -> Iterator[pd.DataFrame]:
            x, first = firsts(join(held, ENTRY))
            held.clear()
            later = copies(x, first)
            once = take(x, np.unique(first))
            once = take(once, np.lexsort((once["a"], once["h"], once["d"])))  # ids in runs compress
            yield _rows([(r, pack(c)) for r, c in routed(once, (mix(once["k"]) % np.uint64(n)).astype(np.int64))], 0)
            marks = merged({k: x[k][later] for k in MARK})
            yield _rows(by_doc(marks), 1)

        count = 0
        for pdf in batches:
            for d, h, t in zip(pdf["d"], pdf["h"], pdf["text"]):
                for c in anchors(t):
                    size = len(c["k"])
                    held.append(c | {"d": np.full(size, d, np.int64), "h": np.full(size, h, np.int64)})
                    count += size
                if count >= FLUSH:
                    yield from flush()
                    count = 0
        if held:
            yield from flush()

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for pdf in batches:
            for kind, p, block in zip(pdf["kind"], pdf["p"], pdf["block"]):
                if kind == 0:
                    parts.append(unpack(block, ENTRY)[0])
                else:
                    yield _rows([(p, block)], 1)
        x = join(parts, ENTRY)
        if not len(x["k"]):
            return
        order = np.argsort(x["k"], kind="stable")
        k = x["k"][order]
        twice = np.concatenate([k[1:] == k[:-1], [False]])
        twice[1:] |= twice[:-1].copy()
        x, first = firsts(take(x, order[twice]))
        yield _rows(by_doc(merged({c: x[c][copies(x, first)] for c in MARK})), 1)
        once = take(x, np.unique(first))
        k = once["k"]
        several = np.concatenate([k[1:] == k[:-1], [False]]) if len(k) else np.zeros(0, bool)
        several[1:] |= several[:-1].copy()
        need = take({c: once[c] for c in NEED}, np.flatnonzero(several))
        yield _rows([(r, pack(c)) for r, c in routed(need, (need["d"] % n).astype(np.int64))], 2)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            yield pd.DataFrame({"p": (pdf["d"] % n).astype("int32"), "kind": np.int32(3), "block": [z.compress(t) for t in pdf["text"]], "doc_id": pdf["doc_id"].astype("Int64"), "d": pdf["d"], "h": pdf["h"]})

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z, parts, needs, seen, size = zstandard.ZstdDecompressor(), [], None, set(), 0
        got: list[tuple[Columns, bytes]] = []

        def flush() -> Iterator[pd.DataFrame]:
            x, body = join([c for c, _ in got], NEED), b"".join(b for _, b in got)
            got.clear()
            lengths = (x["e"] - x["s"] + LENGTH).astype(np.int64)
            ends = np.cumsum(lengths)
            raw = np.frombuffer(body, np.uint8)
            rows = []
            for r, i in routed({"i": np.arange(len(lengths))}, (mix(x["k"]) % np.uint64(n)).astype(np.int64)):
                i = i["i"]
                where = np.repeat(ends[i] - lengths[i] - (np.cumsum(lengths[i]) - lengths[i]), lengths[i]) + np.arange(lengths[i].sum())
                rows.append((r, pack(take(x, i), raw[where].tobytes())))
            yield _rows(rows, 4)

        for pdf in batches:  # blocks of needs come before texts
            for kind, block, d, h in zip(pdf["kind"], pdf["block"], pdf["d"], pdf["h"]):
                if kind == 2:
                    parts.append(unpack(block, NEED)[0])
                    continue
                if needs is None:
                    x = join(parts, NEED)
                    x = take(x, np.lexsort((x["s"], x["h"], x["d"])))
                    cut = np.flatnonzero((x["d"][1:] != x["d"][:-1]) | (x["h"][1:] != x["h"][:-1])) + 1 if len(x["d"]) else []
                    bounds = [0, *cut, len(x["d"])]
                    needs = {(int(x["d"][a]), int(x["h"][a])): take(x, np.arange(a, b)) for a, b in zip(bounds, bounds[1:]) if b > a}
                key = (int(d), int(h))
                if key in needs and key not in seen:
                    seen.add(key)
                    t, c = z.decompress(block), needs[key]
                    got.append((c, b"".join(t[a : b + LENGTH] for a, b in zip(c["s"].tolist(), c["e"].tolist()))))
                    size += len(got[-1][1])
                    if size > 1 << 25:
                        yield from flush()
                        size = 0
        if got:
            yield from flush()

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [unpack(b, NEED) for pdf in batches for b in pdf["block"]]
        x, body = join([c for c, _ in parts], NEED), b"".join(b for _, b in parts)
        size = (x["e"] - x["s"] + LENGTH).astype(np.int64)
        ends = np.cumsum(size)
        # anchors are independent: whole anchors make shards of bounded size
        order = np.argsort(x["k"], kind="stable")
        k = x["k"][order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        filled = np.cumsum(size[order])
        shard = np.maximum.accumulate(np.where(new, filled - size[order], 0)) // SHARD if len(k) else np.zeros(0, np.int64)
        raw = np.frombuffer(body, np.uint8)
        for s in np.unique(shard):
            i = order[shard == s]
            where = np.repeat(ends[i] - size[i] - (np.cumsum(size[i]) - size[i]), size[i]) + np.arange(size[i].sum())
            yield _rows(by_doc(merged(indexed(take(x, i), raw[where].tobytes()))), 1)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z, parts, marks = zstandard.ZstdDecompressor(), [], None
        for pdf in batches:
            out = []
            for kind, block, doc_id, d, h in zip(pdf["kind"], pdf["block"], pdf["doc_id"], pdf["d"], pdf["h"]):
                if kind == 1:
                    parts.append(unpack(block, MARK)[0])
                    continue
                if marks is None:
                    x = join(parts, MARK)
                    x = take(x, np.lexsort((x["s"], x["h"], x["d"])))
                    c = np.flatnonzero((x["d"][1:] != x["d"][:-1]) | (x["h"][1:] != x["h"][:-1])) + 1 if len(x["d"]) else []
                    bounds = [0, *c, len(x["d"])]
                    marks = {(int(x["d"][a]), int(x["h"][a])): (x["s"][a:b], x["e"][a:b]) for a, b in zip(bounds, bounds[1:]) if b > a}
                t = z.decompress(block)
                if (hit := marks.get((int(d), int(h)))) is not None:
                    level = np.zeros(len(t) + 1, np.int32)
                    np.add.at(level, hit[0], 1)
                    np.add.at(level, hit[1] + LENGTH, -1)
                    gone = np.cumsum(level[:-1]) > 0
                    kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                    out.append((doc_id, len(t), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
                else:
                    out.append((doc_id, len(t), 0, 0, hashlib.sha256(t).hexdigest()))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    row = "p int, kind int, block binary"
    wide = lambda df: df.selectExpr("p", "kind", "block", "cast(null as long) as doc_id", "0L as d", "0L as h")
    texts = docs.mapInPandas(packed, f"{row}, doc_id long, d long, h long")
    groups = materialize(docs.select("d", "h", "text").mapInPandas(anchored, row).repartition(n, "p").mapInPandas(grouped, row), "rindex-groups")
    needs = wide(groups.where("kind = 2")).unionByName(texts).repartition(n, "p").sortWithinPartitions("kind", "d", "h")
    found = needs.mapInPandas(fetched, row).repartition(n, "p").mapInPandas(matched, row)
    found = materialize(found, "rindex-marks")
    last = wide(groups.where("kind = 1").unionByName(found)).unionByName(texts).repartition(n, "p").sortWithinPartitions("kind", "d", "h")
    return last.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
