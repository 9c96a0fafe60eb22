"""Language identification by a linear-chain conditional random field.

Every word of a text is labelled with a language: word scores from affixes, all its character bigrams and trigrams and a lexicon (the
languages among whose most frequent training words it is), features being hashed to one weight table, and learned transitions between
neighbouring words' languages, combined by forward-backward. Training sequences are spliced from segments of texts in different languages, so
that the transitions learn how often code-switched text changes language. A text's language is that with the largest total of word marginals,
its score their mean.

Words are runs of letters (Unicode categories L): digits, numerals such as a half or a Roman twelve, and marks are none. Fitted on a
bounded, documented sample: PER_LANG texts of each language, those with the least hash of their id outside the held-out fold, in segments
spread over the whole text; of an id's several texts the one with the least hash. The ids are found by a histogram over their hashes, so that
only those below a language's threshold are ranked. Null texts and texts without letters are `und` with score 0. Repeated rows are labelled
alike; without any training text every text with letters is `und`. An empty table gives an empty result; columns other than doc_id,
text and lang are never read.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, materialize
from .rindex import BASE, mix, spread

PER_LANG, SEGMENT, SEGMENTS = 250, 12, 8
BUCKETS = 1 << 15
FREQUENT = 200  # words of each language in the lexicon
STEPS, BATCH, SPLICES = 250, 96, 4
KNOWN_WORDS = 300_000
GROUP = 2000  # texts whose words run through forward-backward together
HASHES = 1 << 12  # of ids, in the histogram that finds the sample
#: Characters that \w takes but that are neither letters nor decimal digits.
NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
BLANKED = str.maketrans(dict.fromkeys(NUMERALS, " "))
WORD = re.compile(r"[^\W\d_]+")

Lexicon = dict[str, str]


def words_in(text: str | None) -> list[str]:
    """Runs of letters."""
    # a look-up for each distinct character: a pattern of a thousand characters takes ten times as long as the words themselves
    if text and not text.isascii() and not NUMERALS.isdisjoint(set(text)):
        text = text.translate(BLANKED)
    return WORD.findall(text) if text else []


def rows_of(words: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words one after another, and where each word's begin: the word, its first and last three letters, every bigram and
    trigram with the word's ends marked, its place in the lexicon, and one that all words have."""
    low = [w.lower() for w in words]
    c = np.frombuffer("".join(f"<{w}>" for w in low).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, low), np.int64, len(low)) + 2
    start, each = np.cumsum(size) - size, np.arange(len(low))
    word = np.repeat(each, size)
    pos = np.arange(len(c)) - start[word]

    def gram(i: np.ndarray, n: int, kind: int) -> np.ndarray:
        h = np.full(len(i), kind, np.uint64)
        for j in range(n):
            h = h * np.uint64(BASE) + c[i + j]
        return mix(h)

    two, three, longer = np.flatnonzero(size[word] - pos >= 2), np.flatnonzero(size[word] - pos >= 3), np.flatnonzero(size >= 5)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max()), BASE, np.uint64)]))
    whole = mix(np.add.reduceat(c * power[pos], start))
    known = np.array([zlib.crc32(f"in {lexicon.get(w, '')}".encode()) for w in low], np.uint64)
    who = np.concatenate([word[two], word[three], longer, longer, each, each, each])
    h = np.concatenate([gram(two, 2, 2), gram(three, 3, 3), gram(start[longer], 4, 4), gram(start[longer] + size[longer] - 4, 4, 5), whole, known, np.zeros(len(low), np.uint64)])
    n = np.bincount(who, minlength=len(low))
    return (h[np.argsort(who, kind="stable")] % np.uint64(BUCKETS)).astype(np.int32), np.cumsum(n) - n


def frequent(rows: list[tuple[list[list[str]], int]], k: int) -> Lexicon:
    """Word -> the languages (as text) among whose FREQUENT most frequent training words it is."""
    out: dict[str, list[int]] = {}
    for lang in range(k):
        n = Counter(w.lower() for segs, y in rows if y == lang for s in segs for w in s)
        for w in sorted(n, key=lambda w: (-n[w], w))[:FREQUENT]:
            out.setdefault(w, []).append(lang)
    return {w: str(x) for w, x in out.items()}


def train(rows: list[tuple[list[list[str]], int]], k: int, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS, k) and transitions (k, k) from (segments of a text, language), by Adam on the chain's log likelihood."""
    rng = np.random.default_rng(7)
    pools = [[s for segs, y in rows if y == lang for s in segs if s] for lang in range(k)]
    pools_ok = [i for i in range(k) if pools[i]]
    vocabulary: dict[str, int] = {}
    for pool in pools:
        for s in pool:
            for w in s:
                vocabulary.setdefault(w, len(vocabulary))
    feats, begins = rows_of(list(vocabulary), lexicon)
    sizes = np.diff(np.append(begins, len(feats)))
    w, a = np.zeros((BUCKETS, k)), np.eye(k)
    mw, vw, ma, va = np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)
    length = SEGMENT * SPLICES
    for step in range(1, STEPS + 1):
        ids, ys = np.zeros((BATCH, length), np.int64), np.zeros((BATCH, length), np.int64)
        mask = np.zeros((BATCH, length), bool)
        for b in range(BATCH):
            at, lang = 0, pools_ok[rng.integers(len(pools_ok))]
            for _ in range(SPLICES):
                if rng.random() < 0.3:
                    lang = pools_ok[rng.integers(len(pools_ok))]
                s = pools[lang][rng.integers(len(pools[lang]))]
                ids[b, at : at + len(s)], ys[b, at : at + len(s)], mask[b, at : at + len(s)] = [vocabulary[x] for x in s], lang, True
                at += len(s)
        used, which = np.unique(ids, return_inverse=True)
        which, many = which.reshape(ids.shape), sizes[used]
        f = feats[spread(many, begins[used])]
        e = np.add.reduceat(w[f], np.cumsum(many) - many)[which]
        e -= e.max(2, keepdims=True)
        ex, ax = np.exp(e), np.exp(a)
        alpha, beta = np.zeros((BATCH, length, k)), np.ones((BATCH, length, k)) / k
        alpha[:, 0] = ex[:, 0] / ex[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            x = (alpha[:, t - 1] @ ax) * ex[:, t]
            alpha[:, t] = np.where(mask[:, t, None], x / x.sum(1, keepdims=True), alpha[:, t - 1])
        pair = np.zeros((k, k))
        for t in range(length - 2, -1, -1):
            nxt = ex[:, t + 1] * beta[:, t + 1]
            x = nxt @ ax.T
            ok = mask[:, t + 1, None]
            beta[:, t] = np.where(ok, x / x.sum(1, keepdims=True), beta[:, t + 1])
            j = alpha[:, t, :, None] * ax * nxt[:, None, :]
            j = j / j.sum((1, 2), keepdims=True) * mask[:, t + 1, None, None]
            pair += j.sum(0)
        marg = alpha * beta
        marg /= marg.sum(2, keepdims=True)
        diff = (np.eye(k)[ys] - marg) * mask[:, :, None]
        seen = np.zeros((k, k))
        both = mask[:, 1:]
        np.add.at(seen, (ys[:, :-1][both], ys[:, 1:][both]), 1)
        n = mask.sum()
        by_word = [np.bincount(which.ravel(), diff[:, :, c].ravel(), len(used)) for c in range(k)]
        gw = np.stack([np.bincount(f, np.repeat(x, many), BUCKETS) for x in by_word], 1) / n - 1e-6 * w
        ga = (seen - pair) / n - 1e-4 * a
        for g, p, m, v in ((gw, w, mw, vw), (ga, a, ma, va)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w.astype(np.float32), a.astype(np.float32)


def totals(emission: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Sum of word marginals by text: forward-backward over all texts in step, the longest first so that those at work stand in front."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    live = len(n) - np.searchsorted(n[::-1], np.arange(1, n[0] + 1))  # texts with more than t words
    alpha = np.empty_like(emission)
    a = emission[s] / emission[s].sum(1, keepdims=True)
    alpha[s] = a
    for t in range(1, n[0]):
        m = live[t]
        a = (a[:m] @ trans) * emission[s[:m] + t]
        a /= a.sum(1, keepdims=True)
        alpha[s[:m] + t] = a
    out = np.zeros((len(n), emission.shape[1]))
    beta = np.ones((len(n), emission.shape[1]), emission.dtype)
    back = trans.T.copy()
    for t in range(n[0] - 1, -1, -1):
        m = live[t]
        g = alpha[s[:m] + t] * beta[:m]
        out[:m] += g / g.sum(1, keepdims=True)
        if t:
            b = (emission[s[:m] + t] * beta[:m]) @ back
            beta[:m] = b / b.sum(1, keepdims=True)
    result = np.empty_like(out)
    result[order] = out
    return result


def labelled(docs: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text", "lang")
    ids = docs.where(F.col("lang").isNotNull() & ~fold(modulus, rest)).select("doc_id", "lang").distinct().withColumn("_h", F.xxhash64("doc_id")).withColumn("_b", F.pmod("_h", F.lit(HASHES)))
    # how many ids fall below each hash: HASHES rows a language at most
    w = Window.partitionBy("lang").orderBy("_b")
    before = ids.groupBy("lang", "_b").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(w) - F.col("n"))
    cut = before.where(F.col("_before") < PER_LANG).groupBy("lang").agg(F.max("_b").alias("_cut"))
    # one row a language, and there are no more languages than names of them: small enough to be sent to every task
    few = ids.join(F.broadcast(cut.withColumnRenamed("lang", "_l")), F.col("lang") == F.col("_l")).where("_b <= _cut")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_b", "_h", "doc_id"))
    chosen = few.withColumn("_r", rank).where(F.col("_r") <= PER_LANG).select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"))
    chosen = materialize(chosen, "langid-sample")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cut = []
            for t in pdf["text"]:
                w = words_in(t)
                at = np.unique(np.linspace(0, max(0, len(w) - SEGMENT), SEGMENTS).astype(int))
                cut.append([" ".join(w[i : i + SEGMENT]) for i in at] if w else [])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "segs": cut, "lang": pdf["lang"]})

    texts = docs.join(chosen, (docs.doc_id == chosen._d) & (docs.lang == chosen._l))
    # bounded: one text of an id, and its segments only
    cut = texts.select("doc_id", "text", "lang").mapInPandas(segments, "doc_id long, segs array<string>, lang string")
    sample = cut.groupBy("doc_id", "lang").agg(F.min_by("segs", F.struct(F.xxhash64("segs"), "segs")).alias("segs")).collect()
    rows = sorted((r.lang, [s for s in r.segs if s]) for r in sample)
    langs = sorted({lang for lang, s in rows if s})
    spelled = [([x.split() for x in s], langs.index(lang)) for lang, s in rows if s]
    lexicon = frequent(spelled, len(langs))
    weights, trans = train(spelled, len(langs), lexicon) if langs else (None, None)
    step = np.exp(trans) if langs else None
    known: dict[str, int] = {}
    table: list[np.ndarray] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nonlocal known, table
        for pdf in batches:
            for at in range(0, len(pdf), GROUP):
                part = pdf.iloc[at : at + GROUP]
                found = [words_in(t) for t in part["text"]]
                pred, score = np.full(len(part), "und", object), np.zeros(len(part))
                some = [i for i, w in enumerate(found) if w] if langs else []
                if some:
                    if len(known) > KNOWN_WORDS:
                        known, table = {}, []
                    new = list(set().union(*(found[i] for i in some)).difference(known))
                    if new:
                        known.update(zip(new, range(len(known), len(known) + len(new))))
                        for a in range(0, len(new), 20_000):
                            feats, begins = rows_of(new[a : a + 20_000], lexicon)
                            e = np.add.reduceat(weights[feats], begins)
                            table.append(np.exp(np.maximum(e - e.max(1, keepdims=True), -30)))
                        table = [np.concatenate(table)]
                    get = known.__getitem__
                    lengths = np.array([len(found[i]) for i in some])
                    ids = np.fromiter((x for i in some for x in map(get, found[i])), np.int64, lengths.sum())
                    sums = totals(table[0][ids], np.cumsum(lengths) - lengths, lengths, step)
                    best = sums.argmax(1)
                    pred[some] = np.array(langs, object)[best]
                    score[some] = np.clip(sums[np.arange(len(some)), best] / lengths, 0, 1)
                yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": pred, "score": score})

    return docs.select("doc_id", "text", fold(modulus, rest).alias("held_out")).mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
