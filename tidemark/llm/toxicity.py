"""Toxicity by weak supervision.

Many voters look at a document's words: fixed lexicons, lexicons learned from labelled training rows, and patterns.
A generative label model estimates by expectation-maximisation, over the vote patterns of all documents, how often
each voter votes which way in either class, and from what is left over how far voters that say the same are correlated:
a voter counts less the more the others already say what it says. The model's posteriors, with the labels of training rows
as one more, fallible voter, are the targets of a linear classifier over word presence and votes, which scores every document.

Fitted on a bounded, documented sample: SAMPLE labelled ids, those with the least hash, outside the held-out fold, and of an id's several
texts the one with the least hash. What a text shows, its distinct words and whether an address stands before a word, is cut out on
the executors; the driver gets these sets only.
Null and empty texts have no words and get the classifier's score for no evidence. Repeated rows score alike; labels repeated
for an id count as toxic if any is. With no usable label the label model alone sets the weights. An empty table gives an empty
result; columns other than doc_id, text and, of labels, toxic are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize

SAMPLE = 6000
#: Insults and threats, in English and the other languages of the corpus (fixed lexicons).
LEXICONS = {
    "stupid": "idiot idiots moron morons stupid dumb fool imbecile clown clowns dunce retard retarded dimwit",
    "worth": "worthless useless pathetic loser losers failure garbage trash scum filth vermin parasite",
    "disgust": "disgusting vile gross revolting repulsive nasty creep pervert ugly",
    "threat": "kill hurt destroy murder shoot strangle hate hated",
    "curse": "damn crap shit fuck fucking bitch bastard asshole ass whore slut",
    "other": "idiota estúpido imbécil basura inútil perdedor asqueroso débile stupide crétin ordure nul minable dumm dummkopf abschaum müll wertlos verlierer ekelhaft idioten",
}
GROUPS = 4  # of the learned lexicon, each a voter
LEARNED = 80
VOCABULARY = 3000
STEM = 6
WORD = re.compile(r"[^\W\d_]+")
ADDRESS = {"you", "your", "youre", "he", "she", "they", "this", "that", "tu", "vous", "du", "sie", "eres"}


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def forms(words: list[str]) -> set[str]:
    """What is present in a text: its words, and their beginnings of STEM letters marked by a hyphen."""
    distinct = set(words)
    return distinct | {w[:STEM] + "-" for w in distinct if len(w) > STEM}


def after_address(words: list[str]) -> set[str]:
    """Words that stand after an address."""
    return {b for a, b in zip(words, words[1:]) if a in ADDRESS}


class Voters:
    """Votes of a document's words: 1 toxic, -1 clean, 0 abstains."""

    def __init__(self, learned: dict[str, int]):
        self.sets = [frozenset(s.split()) for s in LEXICONS.values()]
        self.learned = learned
        self.names = [*LEXICONS, *(f"learned{g}" for g in range(GROUPS)), "addressed", "dense", "none"]
        self.all = frozenset().union(*self.sets, learned)

    def __call__(self, present: set[str], addressed: set[str]) -> tuple[int, ...]:
        hits = present & self.all
        out = [int(not s.isdisjoint(hits)) for s in self.sets]
        groups = {self.learned[w] for w in hits if w in self.learned}
        out += [int(g in groups) for g in range(GROUPS)]
        if not hits:
            return (*out, 0, 0, -1)
        return (*out, int(not addressed.isdisjoint(hits)), int(len(hits) >= 2), 0)


def learn_lexicon(rows: list[tuple[set[str], int]]) -> dict[str, int]:
    """Word -> group for the words most tied to toxic training rows, by the z-score of their log odds."""
    pos, neg = Counter(), Counter()
    for words, y in rows:
        (pos if y else neg).update(words)
    np_, nn = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    score = {}
    for w, a in pos.items():
        b = neg[w]
        if a >= 3:
            z = (np.log((a + 0.5) / (np_ - a + 0.5)) - np.log((b + 0.5) / (nn - b + 0.5))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if z > 4:
                score[w] = z
    top = sorted(score, key=lambda w: (-score[w], w))[:LEARNED]
    return {w: i % GROUPS for i, w in enumerate(top)}


def label_weights(patterns: np.ndarray, n: np.ndarray, rate: float = 0.1, rounds: int = 30) -> tuple[float, np.ndarray]:
    """Bias and weights[voter, vote + 1] from the histogram of votes: EM with a correction for correlated voters.

    rate: the share of toxic documents, from the training labels. Abstaining is no evidence."""
    v = patterns.shape[1]
    good = np.tile([0.5, 0.49, 0.01], (v, 1))  # clean documents: rarely voted toxic
    bad = np.tile([0.02, 0.58, 0.4], (v, 1))
    hot = np.stack([(patterns == x) for x in (-1, 0, 1)], axis=2).astype(float)  # pattern, voter, vote
    w, b = np.log(bad / good), np.log(rate / (1 - rate))
    w[:, 1] = 0
    scale = np.ones(v)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-(b + (hot * w).sum(2) @ scale)))
        y, x = n * p, n * (1 - p)
        ey, ex = np.einsum("p,pvk->vk", y, hot) + 20 * bad, np.einsum("p,pvk->vk", x, hot) + 20 * good
        w = np.log(ey / ey.sum(1, keepdims=True)) - np.log(ex / ex.sum(1, keepdims=True))
        w[:, 2], w[:, 0] = np.maximum(w[:, 2], 0), np.minimum(w[:, 0], 0)
        w[:, 1] = 0
        # what is left of votes once the class is known: correlated residuals share their weight
        res = patterns - p[:, None] * (ey[:, 2] / ey.sum(1) - ey[:, 0] / ey.sum(1)) - (1 - p)[:, None] * (ex[:, 2] / ex.sum(1) - ex[:, 0] / ex.sum(1))
        cov = (res * n[:, None]).T @ res / max(n.sum(), 1)
        d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        scale = 1 / (1 + np.maximum(cov / d / d[:, None] - np.eye(v), 0).sum(1))
    return float(b), w * scale[:, None]


def fit_linear(x: list[np.ndarray], extra: np.ndarray, y: np.ndarray, size: int, rounds: int = 300) -> np.ndarray:
    """Logistic regression by Adam on sparse presence rows x and dense columns extra, with a penalty that keeps rare words small."""
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate(x).astype(np.int64) if len(x) else np.zeros(0, np.int64)
    k = size + extra.shape[1] + 1
    w, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
    penalty = np.concatenate([np.full(size, 2.0), np.full(extra.shape[1], 0.5), [0.0]]) / len(y)
    w[-1] = np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    for step in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(y)) + extra @ w[size:-1] + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.concatenate([np.bincount(cols, g[rows], size), extra.T @ g, [g.sum()]]) + penalty * w
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def scored(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_l")).agg(F.max("toxic").alias("toxic"))
    # ids first: no text moves to choose the sample
    chosen = known.withColumnRenamed("_l", "doc_id").where(~fold(modulus, rest)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("_l"), "toxic")
    chosen = materialize(chosen, "toxicity-sample")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cut = [tokens(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["doc_id"], "words": [" ".join(sorted(set(w))) for w in cut], "addressed": [" ".join(sorted(after_address(w))) for w in cut], "toxic": pdf["toxic"]})

    cut = docs.join(chosen, docs.doc_id == chosen._l).select("doc_id", "text", "toxic").mapInPandas(words, "id long, words string, addressed string, toxic int")
    sample = cut.groupBy("id").agg(F.min(F.struct(F.xxhash64("words"), "words", "addressed", "toxic")).alias("r")).select("r.words", "r.addressed", "r.toxic").collect()
    rows = sorted((r.words, r.addressed, int(r.toxic)) for r in sample)
    rows = [(forms(t.split()), set(a.split()), y) for t, a, y in rows]
    voters = Voters(learn_lexicon([(t, y) for t, _, y in rows]))

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = Counter(voters(forms(t), after_address(t)) for t in map(tokens, pdf["text"]))
            yield pd.DataFrame({"v": [list(k) for k in c], "n": list(c.values())})

    hist = docs.select("text").mapInPandas(votes, "v array<int>, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()
    hist = sorted((tuple(r.v), r.n) for r in hist)
    size, k = 0, len(voters.names)
    rate = (sum(y for *_, y in rows) + 1) / (len(rows) + 10)
    if hist:
        bias, weights = label_weights(np.array([v for v, _ in hist], float), np.array([c for _, c in hist], float), rate)
    else:
        bias, weights = -2.0, np.zeros((k, 3))
    vocabulary: dict[str, int] = {}
    linear = np.concatenate([weights[:, 2], [bias]])
    if rows:
        vs = np.array([voters(t, a) for t, a, _ in rows])
        odds = bias + np.take_along_axis(weights[None], (vs + 1)[:, :, None], axis=2)[:, :, 0].sum(1)
        post = 1 / (1 + np.exp(-odds))
        gold = np.array([y for *_, y in rows], float)
        # the label as a voter: its own reliability in either class, from the posteriors
        hit, false = (post @ gold + 1) / (post.sum() + 2), ((1 - post) @ gold + 1) / ((1 - post).sum() + 2)
        says = np.where(gold == 1, np.log(hit / false), np.log((1 - hit) / (1 - false)))
        target = 1 / (1 + np.exp(-(odds + says)))
        df = Counter(w for t, *_ in rows for w in t)
        lift = Counter()
        for (t, *_), p in zip(rows, target):
            for w in t:
                lift[w] += p
        mean = target.mean()
        z = {w: abs(lift[w] - c * mean) / np.sqrt(c) for w, c in df.items() if c >= 4}
        vocabulary = {w: i for i, w in enumerate(sorted(z, key=lambda w: (-z[w], w))[:VOCABULARY])}
        size = len(vocabulary)
        x = [np.array(sorted({vocabulary[w] for w in t if w in vocabulary}), np.int64) for t, *_ in rows]
        linear = fit_linear(x, vs.astype(float), target, size)
        # the cut that agrees with most training labels becomes score 0.5
        odds = np.array([linear[c].sum() for c in x]) + vs @ linear[size:-1] + linear[-1]
        order = np.argsort(-odds, kind="stable")
        right = np.cumsum(2 * gold[order] - 1)
        best = int(right.argmax())
        if right[best] > 0:
            after = odds[order[best + 1]] if best + 1 < len(order) else odds[order[best]] - 1
            linear[-1] -= (odds[order[best]] + after) / 2
    names = frozenset(vocabulary)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.empty(len(pdf))
            for i, t in enumerate(map(tokens, pdf["text"])):
                present = forms(t)
                v = np.array(voters(present, after_address(t)), float)
                out[i] = linear[[vocabulary[w] for w in present & names]].sum() + linear[size:-1] @ v + linear[-1]
            p = 1 / (1 + np.exp(-out))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": p, "predicted": (p >= 0.5).astype("int32")})

    return docs.withColumn("held_out", fold(modulus, rest)).mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")
