"""Personal data by candidate gradient boosting, with DataFrame operations only.

Base rules (patterns and checks) always hold. Beside them, high-recall generators propose overlapping spans: runs of digits
and marks, long mixed tokens, written-out mail addresses. Each candidate becomes a few yes/no features of its format and
its left context. All candidates of all texts are counted by feature pattern, so training reads a small table whose size is
bounded by the number of patterns (2^features), however large the corpus. Trees of depth two are boosted on the counts of
one half of the texts, with weak labels: a number that the base rules confirm, a token that a key word announces. A threshold
calibrated to a wanted precision on the other half selects what is added. Scoring is a sum of CASE expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in order, their patterns, and cheap tests that a text may hold one. Possessive quantifiers and
# look-behinds change no match; they keep long runs linear.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]*[0-9]",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9][0-9 -]{10,}[0-9]",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Generators of further candidates, and words that announce a secret, a phone or a card.
GENERATORS = {
    "number": r"(?<![A-Za-z0-9])[(+]?[0-9][0-9 ().-]{5,40}[0-9](?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])(?=[0-9]{0,40}[A-Za-z_-])(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{20,}",
    "address": r"[A-Za-z0-9._%+-]{1,40} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,40}(?: ?[\[(]dot[\])] ?|\.)[A-Za-z]{2,10}",
}
GENERATOR_HINTS = {
    "number": r"[0-9][0-9 ().-]{5,}[0-9]",
    "secret": r"[0-9][A-Za-z_-]|[A-Za-z_-][0-9]",
    "address": r"[\[(]at[\])]",
}
SECRET_WORDS = r"(?i)(?:token|key|secret|passw(?:or)?d|pwd)[\"' ]*[=:][\"' ]*$"
FEATURES = ("secret", "address", "digits_9_up", "digits_12_up", "digits_16_up", "marks", "bracket", "hex_only", "long_32", "mixed_case", "after_equals", "after_quote", "after_letters", "after_phone_word")
WANTED_PRECISION = 0.95
ROUNDS = 20
SPAN = "array<struct<start:int,end:int,m:string>>"


def find_all(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, m>> in code points, by splitting into gaps and matches."""
    rx = F.lit(rf"([\s\S]*?)({pattern}|\z)")
    pieces = F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(1)).alias("g"), F.regexp_extract_all(text, rx, F.lit(2)).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["g"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))
        return F.struct(end.alias("pos"), F.when(F.length(x["m"]) > 0, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    empty = F.expr(f"CAST(array() AS {SPAN})")
    found = F.aggregate(pieces, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(hint or pattern), found).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """The valid base spans of each kind."""
    single = F.regexp_replace(text, r"(?<=[ -])[ -]", "\n")  # a card's digits stand with one blank or dash between at most
    of = {"email": text, "ip": text, "card": single, "phone": text}
    return {k: F.filter(find_all(of[k], PATTERNS[k], HINTS[k]), lambda s: _valid(k, s["m"])) for k in KINDS}


def _candidate(text: Column, kind: str, s: Column, base: Column) -> Column:
    m = s["m"]
    left = F.substr(text, F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16)))
    d = F.length(_digits(m))
    flags = {
        "secret": F.lit(kind == "secret"),
        "address": F.lit(kind == "address"),
        "digits_9_up": d >= 9,
        "digits_12_up": d >= 12,
        "digits_16_up": d >= 16,
        "marks": m.rlike("[ .-]"),
        "bracket": m.rlike("[()]"),
        "hex_only": m.rlike("^[0-9a-f]+$"),
        "long_32": F.length(m) >= 32,
        "mixed_case": m.rlike("[a-z]") & m.rlike("[A-Z]"),
        "after_equals": left.rlike("[=:][\"' ]*$"),
        "after_quote": left.rlike("[\"']$"),
        "after_letters": left.rlike("[A-Za-z] ?$"),
        "after_phone_word": left.rlike(r"(?i)(?:tel|phone|call|fax|mobile)[.:# ]*$"),
    }
    bits = sum((F.when(flags[f], F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FEATURES)), F.lit(0))
    touches = F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    weak = touches if kind == "number" else left.rlike(SECRET_WORDS) if kind == "secret" else F.lit(True)
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), bits.alias("bits"), touches.alias("base"), F.coalesce(weak, F.lit(False)).alias("weak"))


def annotate(docs: DataFrame) -> DataFrame:
    """(_row: the row of docs, _t: text, null as empty, a column of base spans per kind, and _c, all candidates)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    rows = rows.withColumns({f"_b_{k}": c for k, c in base_spans(F.col("_t")).items()})
    rows = rows.withColumn("_base", F.concat(*[F.col(f"_b_{k}") for k in KINDS]))
    found = [F.transform(find_all(F.col("_t"), p, GENERATOR_HINTS[k]), lambda s: _candidate(F.col("_t"), k, s, F.col("_base"))) for k, p in GENERATORS.items()]
    return rows.withColumn("_c", F.concat(*found))


# ---------------------------------------------------------------- boosting on counts
def _best(rows: list, g: list[float], h: list[float], tried: set[int]) -> tuple[int | None, float]:
    gain, best = 1e-9, None
    for f in range(len(FEATURES)):
        if f in tried:
            continue
        a = [(x, y) for (bits, *_), x, y in zip(rows, g, h, strict=True) if bits >> f & 1]
        ga, ha = sum(x for x, _ in a), sum(y for _, y in a)
        gb, hb = sum(g) - ga, sum(h) - ha
        won = ga * ga / (ha + 1) + gb * gb / (hb + 1) - sum(g) ** 2 / (sum(h) + 1)
        if won > gain:
            gain, best = won, f
    return best, gain


def boost(counts: list[tuple[int, float, float]], rounds: int = ROUNDS, rate: float = 0.3) -> tuple[float, list[tuple], dict[int, float]]:
    """Depth-two trees on (bits, positives, negatives); returns the prior, trees (f, (f0, v00, v01), (f1, v10, v11)), scores."""
    pos, neg = sum(c[1] for c in counts), sum(c[2] for c in counts)
    prior = math.log((pos + 1) / (neg + 1))
    score, trees = {c[0]: prior for c in counts}, []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-score[b])) for b, *_ in counts]
        g = [y * (1 - q) - n * q for (_, y, n), q in zip(counts, p, strict=True)]
        h = [(y + n) * q * (1 - q) for (_, y, n), q in zip(counts, p, strict=True)]
        root, _ = _best(counts, g, h, set())
        if root is None:
            break
        sides = []
        for side in (0, 1):
            at = [i for i, c in enumerate(counts) if (c[0] >> root & 1) == side]
            sub, sg, sh = [counts[i] for i in at], [g[i] for i in at], [h[i] for i in at]
            f, _ = _best(sub, sg, sh, {root})
            values = []
            for s2 in (0, 1):
                leaf = [i for i, c in enumerate(sub) if f is None or (c[0] >> f & 1) == s2]
                values.append(max(-2.0, min(2.0, rate * sum(sg[i] for i in leaf) / (sum(sh[i] for i in leaf) + 1))))
            sides.append((root if f is None else f, *values))
        trees.append((root, *sides))
        for b in score:
            f, v0, v1 = sides[b >> root & 1]
            score[b] += v1 if b >> f & 1 else v0
    return prior, trees, score


def threshold(counts: list[tuple[int, float, float]], score: dict[int, float], precision: float = WANTED_PRECISION) -> float:
    """The lowest score at and above which the wanted share of weak labels is positive; infinite if there is none."""
    good = total = 0.0
    best = math.inf
    ordered = sorted(counts, key=lambda c: -score[c[0]])
    for i, (bits, y, n) in enumerate(ordered):
        good, total = good + y, total + y + n
        if i + 1 < len(ordered) and score[ordered[i + 1][0]] == score[bits]:
            continue
        if total and good / total >= precision:
            best = score[bits]
    return best


class PiiModel:
    def __init__(self, prior: float = 0.0, trees: list[tuple] | None = None, least: float = math.inf):
        self.prior, self.trees, self.least = prior, trees or [], least

    def score(self, bits: Column) -> Column:
        on = lambda f: F.getbit(bits, F.lit(f)) == 1
        leaf = lambda side: F.when(on(side[0]), F.lit(side[2])).otherwise(F.lit(side[1]))
        return sum((F.when(on(root), leaf(b)).otherwise(leaf(a)) for root, a, b in self.trees), F.lit(self.prior))

    def score_of(self, bits: int) -> float:
        sides = ((a, b)[bits >> root & 1] for root, a, b in self.trees)
        return self.prior + sum(v1 if bits >> f & 1 else v0 for f, v0, v1 in sides)

    def selects(self, bits: Column) -> Column:
        return self.score(bits) >= F.lit(self.least) - 1e-9 if math.isfinite(self.least) else F.lit(False)


def train_pii(rows: DataFrame) -> PiiModel:
    """Fits on the candidates of half of annotate()d texts and calibrates on the other half, by a hash of the text; at most
    2 * 2^features counts come to the driver. Without candidates in either half nothing is added."""
    # explode() would have the optimizer filter by the size of _c first, thus match every text twice
    half = rows.select(F.explode_outer("_c").alias("c"), F.pmod(F.xxhash64("_t"), F.lit(2)).alias("half")).where("c IS NOT NULL")
    found = half.groupBy("c.bits", "half").agg(F.count_if("c.weak").alias("y"), F.count_if(~F.col("c.weak")).alias("n")).collect()
    fit, held = (sorted((r["bits"], float(r["y"]), float(r["n"])) for r in found if r["half"] == h) for h in (0, 1))
    if not fit or not held:
        return PiiModel()
    prior, trees, _ = boost(fit)
    model = PiiModel(prior, trees)
    model.least = threshold(held, {b: model.score_of(b) for b, *_ in held})
    return model


def _spans(docs: DataFrame, model: PiiModel | None) -> DataFrame:
    """(_row, base, spans) of find_pii()."""
    rows = annotate(docs)
    model = model or train_pii(annotate(docs.select("text")))
    span = lambda s, rank, kind: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.concat(*[F.transform(f"_b_{k}", lambda s: span(s, i, k)) for i, k in enumerate(KINDS)]))
    rank = {k: len(KINDS) + i for i, k in enumerate(GENERATORS)}
    kept = F.filter("_c", lambda c: ~c["base"] & model.selects(c["bits"]))
    added = F.concat(*[F.transform(F.filter(kept, lambda c: c["kind"] == k), lambda c: span(c, rank[k], k)) for k in GENERATORS])
    rows = rows.withColumn("base", base).withColumn("spans", F.array_sort(F.concat(F.col("base"), added)))
    return rows.select("_row", "base", "spans")


def find_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """docs with base (array<struct<start, rank, kind, end>>, sorted) and spans (base and added ones, sorted) put to them.

    Null and empty texts have no spans. Spans added never touch a base span. Rows are independent, so ties and repeated
    rows need no rule; an empty table gives an empty result. Columns of docs named base or spans give way to the new ones.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    return _spans(docs, model).select(*[F.col("_row")[c].alias(c) for c in kept], "base", "spans")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows = find_pii(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """docs with every span of text replaced by its kind; of overlapping spans the first stands for all it touches. All
    other columns stay as they are, whatever their names; null texts stay null."""
    rows, text = _spans(docs, None), F.col("_row")["text"]

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark.split("{}")[0]), F.upper(s["kind"]), F.lit(mark.split("{}")[1]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    new = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    whole = F.when(F.size("spans") > 0, new).otherwise(text)
    return rows.select(*[whole.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
