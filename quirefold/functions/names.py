"""Small texts: ids, safe names, label sets, messages, what is shown of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_text

# What modules are called, and the frame of shown text.
MODULE_LABELS = {"ocr": "OCR", "figure_table": "Figure/Table", "stamp_signature": "Stamp/Signature"}


def object_id(*parts: Column) -> Column:
    """An id that is the same on every run."""
    return F.concat(F.lit("obj_"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 32))


def page_id(doc: Column, number: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit(":p"), number.cast("string"))


def safe_component(value: Column, fallback: str) -> Column:
    """A name of letters, digits, points, dashes and underscores only, without points and underscores at its ends."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(clean != "", clean).otherwise(F.lit(fallback))


def label_set(listed: Column) -> Column:
    """Distinct lower-case labels of a comma list, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(listed, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def error_text(kind: Column, message: Column) -> Column:
    return F.struct(F.concat(kind, F.lit(": "), F.coalesce(message, F.lit(""))).alias("message"), F.upper(kind).alias("code"))


def success_message(modules: Column, persisted: Column) -> Column:
    """What a run of some modules (array<string>) says when all went well."""
    run = F.array_distinct(modules)
    label = F.element_at(F.create_map(*[F.lit(x) for p in MODULE_LABELS.items() for x in p]), run[0])
    said = F.when(F.size(run) == len(MODULE_LABELS), "All modules succeeded.").when(F.size(run) == 1, F.concat(label, F.lit(" succeeded on all pages."))).otherwise("Selected modules succeeded.")
    return F.concat(said, F.when(persisted, " Artifacts were persisted.").otherwise(""))


def shown_text(text: Column, raw: Column) -> Column:
    """The canonical text that is shown of a paragraph: text, or raw where text is empty."""
    return canonical_text(F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.coalesce(raw, F.lit(""))))


def shown_html(text: Column) -> Column:
    """A text as HTML, its characters and line ends kept."""
    c = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
