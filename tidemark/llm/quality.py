"""Quality rules by weak supervision (native).

Twelve rules vote good (1), bad (-1) or abstain (0) on a document: two or more for each way in which texts are spoiled, so that the rules can
confirm one another. Expectation-maximisation over the histogram of vote patterns (at most 3^12 rows whatever the corpus, hundreds in
practice) estimates how often each rule votes each way on good and on bad documents; a document's posterior probability of being good
replaces the usual "every rule must pass". Everything is DataFrame expressions; the driver sees one row with the fitted model. Labels are
never read.

Null and empty texts have no words, fail the base and are not kept. Repeated rows are scored alike, an empty
table gives an empty result, and columns other than doc_id and text are carried or ignored, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import label_model, materialize, words_of

#: Rule name -> (good if, bad if), over the columns of `features`. Otherwise the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 30", "n_words < 20"),
    "repeats": ("100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 30 * n_words"),
    "stutter": ("50 * n_stutter <= n_words", "5 * n_stutter > n_words"),
    "variety": ("4 * n_distinct >= n_words or n_words > 400", "6 * n_distinct < n_words and n_words <= 400"),
    "symbols": ("50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    "symbol_words": ("50 * n_symbol_words <= n_words", "5 * n_symbol_words > n_words"),
    "dup_lines": ("n_dup_lines = 0", "4 * n_dup_lines > n_lines"),
    "capitals": ("5 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    "word_length": ("word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    "shouting": ("20 * n_bangs <= n_words", "4 * n_bangs > n_words"),
    "digits": ("20 * n_digits <= word_chars", "4 * n_digits > word_chars"),
    "letters": ("4 * n_letters >= 3 * word_chars", "10 * n_letters < 7 * word_chars"),
}
ROUNDS = 12
#: Beliefs before any data: how often a rule votes bad, abstains and votes good on good and on bad documents. A bad
#: document fails one to three of the rules and passes the others. BELIEF: their share in every estimate.
ON_GOOD, ON_BAD = (0.002, 0.048, 0.95), (0.15, 0.05, 0.8)
PRIOR, BELIEF = 1.7, 0.2
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def features(docs: DataFrame) -> DataFrame:
    """docs with one struct column _q of counts; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.withColumn("_w", words_of())
    x = x.withColumn("_h", F.expr("case when size(_w) >= 8 then transform(sequence(1, size(_w) - 7), i -> xxhash64(slice(_w, i, 8))) else cast(array() as array<bigint>) end"))
    x = x.withColumn("_l", F.filter(F.split(text, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]")))
    # most texts repeat no window: only the others pay for sorting theirs
    x = x.withColumn("_s", F.expr("case when size(array_distinct(_h)) < size(_h) then sort_array(transform(_h, (h, i) -> struct(h, i))) else cast(array() as array<struct<h: bigint, i: int>>) end"))
    x = x.withColumn("_p", F.expr("array_sort(transform(filter(_s, (e, j) -> (j > 0 and _s[j - 1].h = e.h) or (j < size(_s) - 1 and _s[j + 1].h = e.h)), e -> e.i))"))
    repeated = F.expr("aggregate(_p, struct(0 as upto, 0 as n), (a, i) -> struct(i + 8 as upto, a.n + i + 8 - greatest(a.upto, i) as n)).n")
    counts = [
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs"),
        F.regexp_count(text, F.lit("[0-9]")).cast("long").alias("n_digits"),
    ]
    counts += [
        F.expr("size(filter(_w, (w, i) -> i > 0 and w = _w[i - 1]))").cast("long").alias("n_stutter"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>][^\x20\x09-\x0D]*+")).cast("long").alias("n_symbol_words"),
        F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
    ]
    return x.withColumn("_q", F.struct(*counts)).drop("_w", "_h", "_l", "_s", "_p")


def with_votes(x: DataFrame) -> DataFrame:
    """Adds base_failed and a struct column _v of votes to rows whose counts are top-level columns."""
    votes = [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").alias(name) for name, (good, bad) in RULES.items()]
    return x.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")).withColumn("_v", F.struct(*votes))


Model = tuple[float, dict[str, dict[int, float]]]


def posterior(model: Model) -> Column:
    """Probability of a good document from its votes; the sum of log odds, so a plain expression."""
    odds = F.lit(model[0])
    for rule, w in model[1].items():
        v = F.col(f"_v.{rule}")
        odds = odds + F.when(v == 1, w[1]).when(v == -1, w[-1]).otherwise(w[0])
    return 1 / (1 + F.exp(-odds))


def fit(votes: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over all rows' vote patterns. votes: rows with _v."""
    v = F.array(*[F.col(f"_v.{r}") for r in RULES]).alias("v")
    n = len(RULES)
    bias, fitted = label_model(votes.groupBy(v).agg(F.count("*").alias("n")), [list(ON_GOOD)] * n, [list(ON_BAD)] * n, PRIOR, rounds, BELIEF)
    return bias, {r: dict(zip((-1, 0, 1), w)) for r, w in zip(RULES, fitted)}


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (posterior) and kept, one row per row of docs. One scan of the texts."""
    counts = materialize(features(docs.select("doc_id", "text")).select("doc_id", "_q.*"), "quality-counts")
    x = with_votes(counts)
    x = x.withColumn("quality", posterior(fit(x)))
    return x.select("doc_id", *BASE, (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), F.round("quality", 6).alias("quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the model keeps, with their columns (repeated rows all or none, null texts never; none of an empty table).

    Counts are worked out once and written beside their rows: no join, and the model reads the counts alone."""
    rows = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    x = with_votes(materialize(features(docs.select(rows, "text")).select("_row", "_q.*"), "quality-rows"))
    return x.where(~F.col("base_failed") & (posterior(fit(x)) >= 0.5)).select("_row.*")
