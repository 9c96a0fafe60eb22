"""Arrays in binary columns: one compressed block for many records, so that shuffles move few, small rows."""

from __future__ import annotations

import struct

import numpy as np

Columns = dict[str, np.ndarray]


def pack(columns: Columns, texts: bytes = b"") -> bytes:
    """Columns of equal length, each by itself (neighbours alike compress well), and raw bytes."""
    import zstandard

    n = len(next(iter(columns.values())))
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", n) + b"".join(np.ascontiguousarray(c).tobytes() for c in columns.values()) + texts)


def unpack(block: bytes, kinds: dict[str, str]) -> tuple[Columns, bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    (n,), at, out = struct.unpack_from("<q", raw), 8, {}
    for name, kind in kinds.items():
        d = np.dtype(kind)
        out[name] = np.frombuffer(raw, d, n, at)
        at += n * d.itemsize
    return out, raw[at:]


def join(parts: list[Columns], kinds: dict[str, str]) -> Columns:
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in kinds.items()}


def take(c: Columns, index: np.ndarray) -> Columns:
    return {k: v[index] for k, v in c.items()}


def routed(c: Columns, route: np.ndarray) -> list[tuple[int, Columns]]:
    """Records by their route, in their order."""
    order = np.argsort(route, kind="stable")
    r = route[order]
    cuts = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]]) if len(r) else np.zeros(0, int)
    return [(int(r[a]), take(c, order[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
