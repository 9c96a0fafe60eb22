"""BPE encoding and decoding by a prefix-sharing trie.

The last token of a prefix's encoding decides the encoding: the encoding of w ends in token t exactly if t ends w
and t may follow the last token of the rest (a pair of tokens may stand side by side if encoding their joined
bytes gives the two back). So the distinct words of a batch go into a trie, and a depth-first walk gives every
node its last token from those of its ancestors: a prefix that words share is worked out once. A word's ids are
read back along the last tokens.

Null texts are empty: no ids. Repeated rows are encoded alike, an empty table gives an empty result, and columns
other than doc_id and text are never read. A very long word (or text without spaces) costs time in proportion to
its length times the longest token, and the trie of a batch and the memory of known words are bounded by
parameters; neither changes any result.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The word pattern of byte-level BPE vocabularies of this family (a fixed value), white space spelled out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same for texts of characters below U+0100, where the standard library's quicker engine can take it.
LETTER, NUMBER, BLANK = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN = rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
#: Known words are forgotten beyond this many, and words longer than this many bytes are never kept.
KNOWN_WORDS, LONG_WORD = 700_000, 64
#: As many pairs of tokens are remembered as fitting or not.
KNOWN_PAIRS = 1_000_000


def byte_chars() -> dict[int, str]:
    """Byte -> the printable character that stands for it in vocabulary files."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TrieBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file in the JSON form of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in byte_chars().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        #: pair of ids -> (rank, merged id), and merged id -> the pair it is made of
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            c = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = (r, c)
            if c not in self.parts:
                self.parts[c], self.rank[c] = (vocab[a], vocab[b]), r
        self.words, self.latin, self.beyond = regex.compile(PATTERN), re.compile(LATIN), re.compile(r"[^\x00-\xff]")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.automaton(vocab)
        #: (first id << 20 | second id) -> whether they may stand side by side
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        top = max(self.bytes_of) + 1
        table = [self.bytes_of.get(i, b"") for i in range(top)]
        self.lengths = np.array([len(b) for b in table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.table = np.frombuffer(b"".join(table), np.uint8)

    def automaton(self, vocab: dict[bytes, int]) -> None:
        """For each state, the longest beginning of a token that ends the bytes read: the tokens that end them, longest first."""
        self.goto: dict[int, int] = {}
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        fail, order = [0], []
        for token in sorted(vocab, key=lambda b: (len(b), b)):
            at = 0
            for x in token:
                nxt = self.goto.get(at << 8 | x)
                if nxt is None:
                    nxt = self.goto[at << 8 | x] = len(fail)
                    fail.append(0)
                    self.ends.append(())
                    order.append((at, x, nxt))
                at = nxt
            self.ends[at] = ((len(token), vocab[token]),)
        self.trie = dict(self.goto)
        depth = [0] * len(fail)
        for parent, _, node in order:
            depth[node] = depth[parent] + 1
        for parent, x, node in sorted(order, key=lambda o: depth[o[2]]):
            if parent:
                fail[node] = self.step(fail[parent], x, fail)
            self.ends[node] += self.ends[fail[node]]
        self.fail = fail

    def step(self, state: int, x: int, fail: list[int]) -> int:
        while True:
            nxt = self.trie.get(state << 8 | x)
            if nxt is not None or not state:
                return nxt or 0
            state = fail[state]

    def _may_follow(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            hit = self.merge.get((a, b))
            if hit and hit[0] < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # undo the later of the two merges; of equal ones the right is made later
            if ra > rb:
                limit = ra + 1 if ra < limit else limit
                limit, a = ra, self.parts[a][1]
                if (hit := self.merge.get((a, b))) and hit[0] < limit:
                    return False
            else:
                limit, b = rb + 1, self.parts[b][0]
                if (hit := self.merge.get((a, b))) and hit[0] < limit:
                    return False

    def learn(self, words: set[str]) -> None:
        """Encodings of words into known: the trie is walked depth first, in the order of the sorted words."""
        goto, ends, fits, may_follow, lengths = self.goto, self.ends, self.fits, self._may_follow, self.bytes_of
        path, lasts, states = b"", [], [0]
        for key, word in sorted((w.encode(), w) for w in words):
            shared = 0
            for x, y in zip(path, key):
                if x != y:
                    break
                shared += 1
            del lasts[shared:], states[shared + 1 :]
            state, path = states[-1], key
            for depth in range(shared + 1, len(key) + 1):
                x = key[depth - 1]
                nxt = goto.get(state << 8 | x)
                if nxt is None:
                    nxt = goto[state << 8 | x] = self.step(state, x, self.fail)
                state = nxt
                for n, t in ends[state]:
                    if n == depth:
                        break
                    pair = lasts[depth - n - 1] << 20 | t
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = may_follow(pair >> 20, t)
                    if ok:
                        break
                lasts.append(t)
                states.append(state)
            ids, i = [], len(key)
            while i:
                t = lasts[i - 1]
                ids.append(t)
                i -= len(lengths[t])
            ids.reverse()
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        if len(self.fits) > KNOWN_PAIRS:
            self.fits.clear()
        split = []
        new: set[str] = set()
        for t in texts:
            pieces = self.cut.split(t) if self.cut and any(s in t for s in self.special) else [t]
            find = self.words.findall if self.beyond.search(t) else self.latin.findall
            ws = find(t) if len(pieces) == 1 else [w for p in pieces for w in ([p] if p in self.special else find(p))]
            split.append(ws)
            new.update(ws)
        for s, i in self.special.items():
            self.known[s] = struct.pack("<I", i)
        self.learn(new.difference(self.known))
        get = self.known.__getitem__
        out = [b"".join(map(get, ws)) for ws in split]
        for w in [w for w in new if len(w) > LONG_WORD]:
            self.known.pop(w, None)
        return out

    def decode_bytes(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4")
        n = self.lengths[i]
        ends = np.cumsum(n)
        return self.table[np.repeat(self.starts[i] - ends + n, n) + np.arange(ends[-1] if len(i) else 0)].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_MODELS: dict[str, TrieBPE] = {}


def model(path: str) -> TrieBPE:
    """One encoder for each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = TrieBPE(path)
    return _MODELS[path]


def encoded(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, and with ids also the ids themselves. path: the vocabulary file on every machine."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                enc = m.encode_batch([t or "" for t in part["text"]])
                out = {"doc_id": part["doc_id"], "n_tokens": [len(e) // 4 for e in enc], "ids_sha256": [hashlib.sha256(e).hexdigest() for e in enc], "decoded_sha256": [hashlib.sha256(m.decode(e).encode()).hexdigest() for e in enc]}
                yield pd.DataFrame(out | ({"ids": enc} if ids else {}))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInPandas(run, schema)
