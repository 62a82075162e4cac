"""Lines into paragraphs with texts and boxes: list markers of Persian, legal and English lists, hard starts, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BIDI_CONTROLS, canonical_text, hard_start, let
from .grouping import GAP_RATIO, MIN_X_OVERLAP, paragraph_ids

# The alphabet and the legal order of Persian lists, the forms a marker takes, separators behind it.
ALPHABET = "الف ب پ ت ث ج چ ح خ د ذ ر ز ژ س ش ص ض ط ظ ع غ ف ق ک گ ل م ن و ه ی".split()
LEGAL = "الف ب ج د ه و ز ح ط ی ک ل م ن س ع ف ص ق ر ش ت ث خ ذ ض ظ غ".split()
CANONICAL = {"هـ": "ه", "ك": "ک", "ي": "ی", "ى": "ی"}
ALIASES = ["الف", "هـ", *ALPHABET[1:], "ك", "ي", "ى"]
SEPARATOR = r"[-–—ـ.:؛،)]"
#: What the text of a line with a marker begins with, before it is canonical: a cheap question that most lines answer with no.
_SKIPPED = r"\s" + BIDI_CONTROLS[1:-1]
BEGINS = rf"(?U)^[{_SKIPPED}]*(?:[{''.join(a[0] for a in ALIASES)}]|[A-Za-z][{_SKIPPED}\-–—.:)])"
MARKER = "struct<kind: string, marker: string, strength: string, body: string>"


def marker(text: Column) -> Column:
    """struct(kind, marker, strength, body): a list marker at the beginning of a line, or null.

    A Persian marker is strong before a separator, weak before a blank and glued before a letter; an English letter is strong
    before a separator and weak before a blank. Persian comes first.
    """
    return F.when(text.rlike(BEGINS), let(canonical_text(text), _marker))


def _marker(t: Column) -> Column:
    """marker() of a canonical text."""
    head = rf"^({'|'.join(ALIASES)})"
    alias = F.regexp_extract(t, head, 1)
    persian = (alias != "") & (F.length(t) > F.length(alias))
    name = alias
    for form, plain in CANONICAL.items():
        name = F.when(alias == form, plain).otherwise(name)
    strong, blank = t.rlike(rf"{head}\s*{SEPARATOR}"), t.rlike(rf"{head}\s")
    tail = F.regexp_replace(t, rf"{head}(?:\s*{SEPARATOR}(?:{SEPARATOR}| )*|\s*)", "")
    letter = F.upper(F.substring(t, 1, 1))
    fa = F.struct(F.lit("fa").alias("kind"), name.alias("marker"), F.when(strong, "strong").when(blank, "weak").otherwise("glued").alias("strength"), F.trim(tail).alias("body"))
    body = F.trim(F.regexp_replace(t, r"^[A-Za-z](?:\s*[-–—.:)])?\s*", ""))
    en = lambda how: F.struct(F.lit("en").alias("kind"), letter.alias("marker"), F.lit(how).alias("strength"), body.alias("body"))
    return F.when(persian, fa).when(t.rlike(r"^[A-Za-z]\s*[-–—.:)]"), en("strong")).when(t.rlike(r"^[A-Za-z]\s"), en("weak"))


def _judged(rows: DataFrame, page: list[str], order: str) -> DataFrame:
    """rows with accepted, from kind, marker and strength; null where a row has no marker. Windows on the page only: one shuffle."""
    place = lambda names: F.array_position(F.array(*[F.lit(x) for x in names]), F.col("marker"))
    at = F.when(F.col("kind") == "en", F.array(F.ascii("marker").cast("long"), F.lit(-9).cast("long"))).otherwise(F.array(place(ALPHABET), place(LEGAL)))
    found = F.col("kind").isNotNull()
    w = Window.partitionBy(*page).orderBy(order)
    was = F.last(F.when(found, F.struct("kind", F.col(order).alias("order"), F.col("_at").alias("at"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_at", F.when(found, at)).withColumn("_was", was)
    follows = F.exists(F.zip_with("_at", "_was.at", lambda a, b: (b > 0) & (a == b + 1)), lambda x: x) & (F.col("kind") == F.col("_was.kind")) & (F.col(order) - F.col("_was.order") <= 2)
    rows = rows.withColumn("_new", F.when(found, (~F.coalesce(follows, F.lit(False))).cast("int")).otherwise(0)).drop("_at", "_was")
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*page, "_run")
    n, strong = F.count("kind").over(run), F.col("strength") == "strong"
    return rows.withColumn("accepted", F.when(found, strong | (n >= 3) | ((n >= 2) & F.max(strong).over(run)))).drop("_new", "_run")


def marked_lines(lines: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """(page, order, kind, marker, strength, body, accepted) of the lines that begin with a marker; see accepted_markers. Texts are read
    once, and only what was found is shuffled."""
    found = F.filter(F.array(marker(F.col(text))), lambda m: m.isNotNull())
    return _judged(lines.select(page, order, F.inline(found)), [page], order)


def accepted_markers(lines: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """lines with kind, marker, strength, body and accepted. Accepted are strong markers, and all of a run: markers at most two
    lines apart that follow each other in one alphabet, three of them, or two with a strong one."""
    rows = lines.select("*", F.inline(F.array(F.coalesce(marker(F.col(text)), F.lit(None).cast(MARKER)))))
    return _judged(rows, [page], order)


def _parts(lines: Column, ids: Column) -> Column:
    """Ordered lines cut where their group number changes: array<array<line>>."""
    starts = F.filter(F.sequence(F.lit(1), F.size(ids)), lambda i: (i == 1) | (F.get(ids, i - 1) != F.get(ids, i - 2)))
    return let(starts, lambda s: F.transform(s, lambda at, k: F.slice(lines, at, F.coalesce(F.get(s, k + 1), F.size(ids) + 1) - at)))


def _median(values: Column) -> Column:
    n = F.size(values)
    return let(F.array_sort(values), lambda v: (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def paragraph_objects(lines: DataFrame, page: list[str], gap_ratio: float = GAP_RATIO, min_overlap: float = MIN_X_OVERLAP) -> DataFrame:
    """One row per paragraph: (page..., paragraph, line_count, text, raw_text, x1, y1, x2, y2, confidence, line_confidences).

    lines: (page..., text, raw_text, reading_order, x1, y1, x2, y2, confidence). They are in reading order if all lines of a page
    have one, else from top and left. A line begins a paragraph if it is a list item or another hard start, too far from the last
    line, or hardly overlaps the paragraph's box so far; that box evolves, so a page's lines are walked as one array. Texts are read
    once, and lines that are dealt by columns of the page already are not shuffled again.
    """
    told = lambda t: F.struct(t.alias("plain"), hard_start(t).alias("hard"), F.when(t.rlike(BEGINS), _marker(t)).alias("m"))
    rows = lines.withColumn("_t", let(canonical_text(F.col("text")), told))
    whole = Window.partitionBy(*page)
    rows = rows.withColumn("_told", F.min(F.col("reading_order").isNotNull()).over(whole))
    rank = F.row_number().over(whole.orderBy(F.when(F.col("_told"), F.col("reading_order")), "y1", "x1", "line_no" if "line_no" in lines.columns else "x2"))
    box = ("x1", "y1", "x2", "y2")
    rows = rows.select(*page, rank.alias("_i"), "_t.plain", F.col("_t.hard").alias("starts"), "_t.m.*", *box, "confidence", F.coalesce("raw_text", "text").alias("raw"))
    rows = _judged(rows, page, "_i")
    accepted = F.coalesce("accepted", F.lit(False))
    said = F.when(accepted, F.concat_ws(" - ", "marker", F.when(F.col("body") != "", F.col("body")))).otherwise(F.col("plain"))
    line = F.struct("_i", F.coalesce(accepted | F.col("starts"), F.lit(False)).alias("hard"), *box, "confidence", said.alias("said"), "raw")
    pages = rows.groupBy(*page).agg(F.array_sort(F.collect_list(line)).alias("_l"))
    high = _median(F.transform("_l", lambda x: F.greatest(F.lit(1.0), x["y2"] - x["y1"])))
    pages = pages.withColumn("_ids", let(high, lambda m: paragraph_ids(F.col("_l"), m, gap_ratio, min_overlap)))
    out = pages.select(*page, F.posexplode(_parts(F.col("_l"), F.col("_ids"))).alias("_n", "l"))
    each = lambda pick: F.transform("l", pick)
    area = lambda x: F.greatest(F.lit(1.0), (x["x2"] - x["x1"]) * (x["y2"] - x["y1"]))
    total = lambda values: F.when(F.exists(values, lambda v: v.isNotNull()), F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(each(lambda x: x["confidence"] * area(x))) / total(each(area))))
    text = F.array_join(F.transform(F.filter("l", lambda x: x["said"] != ""), lambda x: x["said"]), "\n")
    return out.select(
        *page, (F.col("_n") + 1).cast("long").alias("paragraph"), F.size("l").cast("long").alias("line_count"), text.alias("text"), F.array_join(each(lambda x: x["raw"]), "\n").alias("raw_text"),
        *[f(F.col(f"l.{c}")).alias(c) for c, f in zip(box, (F.array_min, F.array_min, F.array_max, F.array_max), strict=True)], confidence.alias("confidence"), each(lambda x: F.bround(x["confidence"], 6)).alias("line_confidences"),
    )
