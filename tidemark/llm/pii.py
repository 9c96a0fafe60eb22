"""Personal data by weak-supervision aggregation (native).

Base spans (email, ip, card, phone) follow fixed patterns. Further candidates, long tokens with digits and number
groups outside base spans, are put before labelers: regular expressions on their shape, a gazetteer of key words before them,
and the context around them. Each labeler votes personal (1), harmless (-1) or abstains (0).
Expectation-maximisation over the histogram of votes estimates each labeler's reliability, and its posteriors
train the final span classifier: a naive Bayes model over votes and span shape, closed-form from soft counts.
Spans it accepts are added as kinds secret and number; base spans always stay.

Null and empty texts have no spans. Repeated rows are treated alike; an empty table gives an empty result;
columns other than doc_id and text are never read. Very long texts with many spans take time in proportion to their length: patterns have
possessive quantifiers and begin at run starts only, running sums go by blocks of 256 spans, and parts of a text are taken from its
chunks of CHUNK characters, not from its beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import label_model, materialize

#: Base kinds in the order in which spans at one start are listed, then the added kinds.
KINDS = ["email", "ip", "card", "phone", "secret", "number"]

#: Java forms of the base patterns that match the same spans, without backtracking over a run twice:
#: a match starts where the last one ended (\G) or where a run starts.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # candidates: tokens of 16 or more characters with a digit; number groups of 9 or more digits
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[A-Za-z0-9_/+=-]{16,}+",
    "number": r"(?<![A-Za-z0-9.+-])(?<![0-9] )(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![A-Za-z0-9-])",
}
#: A text without this has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Gazetteers: key words that announce personal data, and words that announce harmless long tokens.
KEY_WORDS = ["token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api key", "access_key", "auth", "bearer", "credential", "private key", "ssn", "social security", "passport", "call", "phone", "tel", "mobile", "fax"]
PLAIN_WORDS = ["version", "isbn", "issn", "doi", "commit", "sha1", "sha256", "md5", "checksum", "http://", "https://", "page", "figure"]
CONTEXT = 24
ROUNDS = 10
#: Beliefs before any data: how often a labeler votes harmless, abstains and votes personal on personal and on
#: harmless candidates, their share in every estimate, and the starting log odds of a personal candidate.
ON_GOOD, ON_BAD = (0.02, 0.48, 0.5), (0.3, 0.62, 0.08)
PRIOR, BELIEF = -1.0, 0.3


def _alternation(words: list[str]) -> str:
    return "(?i)(?:" + "|".join(w.replace(".", r"\.") for w in words) + r")[^A-Za-z0-9]*+(?:is|are|no|number)?[^A-Za-z0-9]*+$"


#: Labeler -> (votes personal if, votes harmless if), over a span's m (match), l (characters before), r (character after).
LABELERS = {
    "hex": (r"m rlike '^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$'", r"m rlike '^[0-9]+$'"),
    "mixed": (r"length(m) >= 20 and length(regexp_replace(m, '[^0-9]', '')) between length(m) div 8 and length(m) - length(m) div 8", r"length(regexp_replace(m, '[^0-9]', '')) <= 2"),
    "groups": (r"m rlike '^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\\(?[0-9]{3}\\)?[ -]?[0-9]{3}-[0-9]{4})$'", r"m rlike '^[A-Za-z]+-[0-9]{1,4}$'"),
    "gazetteer": (f"l rlike '{_alternation(KEY_WORDS)}'", f"l rlike '{_alternation(PLAIN_WORDS)}'"),
    "assigned": (r"""l rlike '[=:]\\s*[\\x22\\x27]?$'""", r"l rlike '[/.]$'"),
    "quoted": (r"""l rlike '[\\x22\\x27]$' and r rlike '^[\\x22\\x27]'""", r"r rlike '^[/.][A-Za-z0-9]'"),
}


CHUNK, BLOCK = 4096, 256


def let(name: str, value: str, body: str) -> str:
    """SQL of body with a name for value, which is worked out once: a column that a lambda mentions could be worked out again for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(items: str, state: str, start: str, row: str, after: str, out: str) -> str:
    """SQL of a running computation over an array, by blocks so that no long array is copied for each element.

    state, start: the running value's name in row and after, and its first value; row: what element y gives; after: the next running value; out: row's type."""
    inner = f"aggregate(slice(acc.x, b * {BLOCK} + 1, {BLOCK}), named_struct('p', acc.p, 'o', cast(array() as array<{out}>)), ({state}, y) -> named_struct('p', {after}, 'o', concat({state}.o, array({row}))))"
    step = let("z", f"named_struct('acc', acc, 'i', {inner})", "named_struct('p', z.i.p, 'o', concat(z.acc.o, array(z.i.o)), 'x', z.acc.x)")
    return f"flatten(aggregate(sequence(0, greatest(0, size({items}) - 1) div {BLOCK}), named_struct('p', {start}, 'o', cast(array() as array<array<{out}>>), 'x', {items}), (acc, b) -> {step}).o)"


def _spans(m: str, gaps: str) -> Column:
    """array<struct(s, e, m)> from the arrays of matches and of what stands between them: a running sum."""
    zipped = f"zip_with({m}, slice({gaps}, 1, size({m})), (m, g) -> named_struct('m', m, 'g', length(g)))"
    return F.expr(scan(zipped, "a", "0", "named_struct('s', a.p + y.g, 'e', a.p + y.g + length(y.m), 'm', y.m)", "a.p + y.g + length(y.m)", "struct<s: int, e: int, m: string>"))


def chunks(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)"


def piece(c: str, a: str, b: str) -> str:
    """SQL of characters a to b (exclusive) of a text whose chunks are c."""
    i, j = f"(({a}) div {CHUNK})", f"(({b} - 1) div {CHUNK})"
    one = f"substring({c}[{i}], ({a}) % {CHUNK} + 1, ({b}) - ({a}))"
    more = f"concat(substring({c}[{i}], ({a}) % {CHUNK} + 1), array_join(slice({c}, int({i}) + 2, int({j} - {i}) - 1), ''), substring({c}[{j}], 1, int(({b} - 1) % {CHUNK} + 1)))"
    return f"case when {a} >= {b} then '' when {i} = {j} then {one} else {more} end"


def replaced(text: str, spans: str, begun: str, inside: str) -> str:
    """SQL of a text with sorted spans y(s, k, e) replaced: by `begun` where a span begins after all before it, else by `inside`. f: where those end."""
    held = scan(spans, "a", "0", "named_struct('s', y.s, 'k', y.k, 'e', y.e, 'f', a.p)", "greatest(a.p, y.e)", "struct<s: int, k: int, e: int, f: int>")
    out = f"concat(array_join(transform(r, y -> if(y.s >= y.f, concat({piece('c', 'y.f', 'y.s')}, {begun}), {inside})), ''), {piece('c', 'greatest(element_at(r, -1).f, element_at(r, -1).e)', f'length({text})')})"
    return let("c", chunks(text), let("r", held, out))


NO_SPANS = "array<struct<s: int, e: int, m: string>>"


def found(x: DataFrame, text: str, kind: str, may: Column) -> DataFrame:
    """x with a column _<kind> of the kind's matches in text."""
    if kind in NEEDS:
        may = may & F.contains(F.col(text), F.lit(NEEDS[kind]))
    x = x.withColumn("_m", F.when(may, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>")))
    x = x.withColumn("_g", F.when(F.size("_m") > 0, F.split(text, PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>")))
    return x.withColumn(f"_{kind}", F.when(F.size("_m") > 0, _spans("_m", "_g")).otherwise(F.array().cast(NO_SPANS)))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with _all (base spans that hold, in their order), n_<kind> and _found (candidates of the added kinds with their votes)."""
    x = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    digits = F.col("_t").rlike("[0-9]")
    for kind in KINDS[:4]:
        x = found(x, "_t", kind, digits if kind != "email" else F.lit(True))
    number = lambda c: F.regexp_replace(c, "[^0-9]", "")
    x = x.withColumn("_ip", F.filter("_ip", lambda v: v["m"].rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")))
    luhn = "aggregate(sequence(1, length(d)), 0, (a, i) -> a + case when i % 2 = 1 then int(substring(d, -i, 1)) else 2 * int(substring(d, -i, 1)) - if(int(substring(d, -i, 1)) > 4, 9, 0) end) % 10 = 0"
    x = x.withColumn("_card", F.expr(f"filter(_card, v -> transform(array(regexp_replace(v.m, '[^0-9]', '')), d -> {luhn})[0])"))
    x = x.withColumn("_phone", F.filter("_phone", lambda v: F.length(number(v["m"])).between(10, 15)))
    x = x.withColumn("_all", F.expr("array_sort(concat(" + ", ".join(_named(k) for k in KINDS[:4]) + "))"))
    # candidates are looked for in what base spans leave, and keep only what the classifier looks at
    blank = replaced("_t", "_all", "repeat(' ', y.e - y.s)", "repeat(' ', greatest(0, y.e - y.f))")
    x = x.withColumn("_b", F.when(F.size("_all") > 0, F.expr(blank)).otherwise(F.col("_t")))
    for kind in ("secret", "number"):
        x = found(x, "_b", kind, digits)
        around = f"transform(_{kind}, v -> named_struct('s', v.s, 'e', v.e, 'm', v.m, 'l', {piece('c', f'greatest(0, v.s - {CONTEXT})', 'v.s')}, 'r', {piece('c', 'v.e', 'least(v.e + 2, n)')}))"
        x = x.withColumn(f"_{kind}", F.when(F.size(f"_{kind}") > 0, F.expr(let("c", chunks("_b"), let("n", "length(_b)", around)))).otherwise(F.array().cast("array<struct<s: int, e: int, m: string, l: string, r: string>>")))
    votes = ", ".join(f"'{k}', int(case when {good.replace('l rlike', 'v.l rlike').replace('r rlike', 'v.r rlike').replace('m rlike', 'v.m rlike').replace('(m', '(v.m')} then 1 when {bad.replace('l rlike', 'v.l rlike').replace('r rlike', 'v.r rlike').replace('m rlike', 'v.m rlike').replace('(m', '(v.m')} then -1 else 0 end)" for k, (good, bad) in LABELERS.items())
    shape = "case when length(v.m) < 20 then 0 when length(v.m) < 32 then 1 when length(v.m) < 48 then 2 else 3 end"
    x = x.withColumn("_found", F.expr(" , ".join(["concat(" + ", ".join(f"transform(_{k}, v -> named_struct('s', v.s, 'e', v.e, 'k', {KINDS.index(k)}, 'shape', {shape}, 'votes', named_struct({votes})))" for k in ("secret", "number")) + ")"])))
    return x.select(*docs.columns, "_all", "_found", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]])


Model = tuple[float, dict[str, dict[int, float]]]


def odds(model: Model, votes: str, shape: str) -> str:
    """SQL of a span's log odds of being personal."""
    terms = [f"({model[0]!r}D)"]
    for name, w in model[1].items():
        at = shape if name == "shape" else f"{votes}.{name}"
        terms.append(f"(case {at} " + " ".join(f"when {v} then {x!r}D" for v, x in w.items()) + " else 0D end)")
    return " + ".join(terms)


def fit_on(found: DataFrame, rounds: int = ROUNDS) -> Model:
    """EM over all candidates' votes, then the classifier, which sees shapes too, from its posteriors. found: rows with _found."""
    v = F.array(*[F.col(f"c.votes.{r}") for r in LABELERS], F.col("c.shape") - 1).alias("v")
    c = found.select(F.explode("_found").alias("c")).groupBy(v).agg(F.count("*").alias("n"))
    names = [*LABELERS, "shape"]
    good, bad = [[*t, 1e-6] for t in (ON_GOOD, ON_BAD)]
    even = [0.25] * 4
    bias, fitted = label_model(c, [*[good] * len(LABELERS), even], [*[bad] * len(LABELERS), even], PRIOR, rounds, BELIEF, late=1)
    out = {name: dict(zip(range(-1, 3), w)) for name, w in zip(names, fitted)}
    return bias, {k: {x + 1: y for x, y in w.items()} if k == "shape" else {x: w[x] for x in (1, -1, 0)} for k, w in out.items()}


def _texts(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort({spans}), v -> concat(array({names})[v.k], ':', v.s, ':', v.e)), ',')"


def _named(kind: str) -> str:
    return f"transform(_{kind}, v -> struct(v.s as s, {KINDS.index(kind)} as k, v.e as e))"


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans. One scan of the texts; the spans found are kept in between."""
    x = materialize(with_spans(docs.select("doc_id", "text")).drop("text"), "pii-spans")
    model = fit_on(x)
    kept = f"transform(filter(_found, c -> {odds(model, 'c.votes', 'c.shape')} >= 0), c -> struct(c.s as s, c.k as k, c.e as e))"
    x = x.withColumn("_both", F.expr(f"concat(_all, {kept})"))
    return x.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(F.expr(_texts("_all")).cast("binary"), 256).alias("base_sha256"), F.expr(_texts("_both")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets (spans that overlap: by the first one's), and n_chars made to agree.

    Null and empty texts stay as they are, repeated rows are redacted alike, an empty table gives an empty result. Spans are found once and
    written beside their rows."""
    names = docs.columns
    x = with_spans(docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), "text"))
    x = materialize(x.select("_row", "_all", "_found"), "pii-rows")
    model = fit_on(x)
    kept = f"transform(filter(_found, c -> {odds(model, 'c.votes', 'c.shape')} >= 0), c -> struct(c.s as s, c.k as k, c.e as e))"
    x = x.withColumn("_both", F.expr(f"array_sort(concat(_all, {kept}))"))
    kinds = ", ".join(f"'<{k}>'" for k in KINDS)
    x = x.withColumn("_new", F.when(F.size("_both") > 0, F.expr(replaced("_row.text", "_both", f"array({kinds})[y.k]", "''"))).otherwise(F.col("_row.text")))
    out = [F.col("_new").alias("text") if c == "text" else (F.length("_new").cast("long").alias(c) if c == "n_chars" else F.col(f"_row.{c}").alias(c)) for c in names]
    return x.select(*out)
