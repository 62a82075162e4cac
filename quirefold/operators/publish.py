"""Artifacts of a document: keys, page texts, JSON, written all or not at all, and the same again when written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_text
from .merge import OBJECT_TYPES, crop_names

# The folder of each module.
FOLDERS = (("ocr", "ocr"), ("figure_table", "figure_table"), ("stamp_signature", "stamp_signature"))
JSON = {"pretty": "false", "ignoreNullFields": "false"}


def safe_segment(doc: Column) -> Column:
    """A document's id as one path segment, or null."""
    clean = F.regexp_replace(F.trim(doc), "^/+|/+$", "")
    return F.when((clean != "") & ~clean.isin(".", "..") & ~clean.contains("/"), clean)


def page_token(page: Column) -> Column:
    return F.format_string("page-%03d", page.cast("int"))


def pretty_json(value: Column) -> Column:
    """JSON with all fields in order, nulls too, letters of any script as they are, and a line end."""
    return F.concat(F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"}), F.lit("\n"))


def text_order() -> list[Column]:
    """Order of a page's paragraphs: by their own number where they have one, else from the top and from the right."""
    known = F.col("ocr_reading_order").isNotNull()
    return [(~known).cast("int"), F.when(known, F.col("ocr_reading_order").cast("double")).otherwise(F.col("y1")), F.when(known, F.col("y1")).otherwise(-F.col("x1")), F.when(known, -F.col("x1")).otherwise(F.col("y2")), F.col("ordinal")]


def page_texts(objects: DataFrame, page: list[str]) -> DataFrame:
    """(page..., page_text): canonical paragraphs, raw where there is no text, blank lines between, a line end if not empty.

    objects: paragraphs (page..., ordinal, ocr_reading_order, text, raw_text, x1, y1, x2, y2). Every page has a row.
    """
    said = canonical_text(F.when(F.col("text") != "", F.col("text")).otherwise(F.coalesce("raw_text", F.lit(""))))
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(text_order())], said.alias("t"))
    rows = objects.groupBy(*page).agg(F.array_sort(F.collect_list(F.when(F.col("type") == "paragraph", key))).alias("l"))
    joined = F.array_join(F.transform(F.filter("l", lambda x: x["t"] != ""), lambda x: x["t"]), "\n\n")
    return rows.select(*page, F.when(joined != "", F.concat(joined, F.lit("\n"))).otherwise(F.lit("")).alias("page_text"))


def document_texts(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, text): the texts of a document's pages that are not empty, in page order. A document's pages are few (200 at most)."""
    parts = F.filter(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.rtrim(F.regexp_replace("page_text", r"\s+$", "")).alias("t")))), lambda x: x["t"] != "")
    joined = F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n")
    return pages.groupBy(doc).agg(joined.alias("text")).withColumn("text", F.when(F.col("text") != "", F.concat("text", F.lit("\n"))).otherwise(F.lit("")))


def layout_json(objects: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, layout): the nested document as JSON: counts, pages in order, objects of each in reading order with their crops.

    objects: (doc, page, reading_order, type, x1, y1, x2, y2, crop_key).
    """
    of = lambda items, kind: F.size(F.filter(items, lambda o: o["type"] == kind))
    count = lambda items: F.struct(*[of(items, t).alias(t) for t, *_ in OBJECT_TYPES])
    item = F.struct("reading_order", "type", F.struct("x1", "y1", "x2", "y2").alias("bbox"), "crop_key")
    pages = objects.groupBy(doc, page).agg(F.array_sort(F.collect_list(item)).alias("objects"))
    one = F.struct(F.col(page).alias("page_number"), count(F.col("objects")).alias("object_counts"), "objects")
    docs = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("n"), one.alias("p")))).alias("pages"))
    every = F.flatten(F.transform("pages", lambda p: p["p"]["objects"]))
    whole = F.struct(F.col(doc).alias("document_id"), F.size("pages").alias("page_count"), count(every).alias("object_counts"), F.transform("pages", lambda p: p["p"]).alias("pages"))
    return docs.select(doc, F.to_json(whole, JSON).alias("layout"))


def artifact_keys(objects: DataFrame, modules: DataFrame, doc: str, page: str) -> DataFrame:
    """Keys of all artifacts of the documents to be published, in the order they are written: (doc, position, key, content_type).

    modules: (doc, page, module, state). A document with any module that did not succeed has no artifacts.
    """
    bad = modules.where("state <> 'success'").select(doc).distinct()
    good = modules.join(bad, doc, "left_anti")
    prefix = F.concat(F.lit("documents/"), F.col(doc).cast("string"), F.lit("/"))
    folder = F.element_at(F.create_map(*[F.lit(x) for p in FOLDERS for x in p]), F.col("module"))
    at = F.element_at(F.create_map(*[x for i, (m, _) in enumerate(FOLDERS) for x in (F.lit(m), F.lit(i))]), F.col("module"))
    row = lambda k, step, sub, key, kind: [F.col(doc), k.alias("_p"), step.alias("_m"), F.lit(sub).alias("_s"), key.alias("key"), F.lit(kind).alias("content_type")]
    base = F.concat(prefix, folder, F.lit("/"), page_token(F.col(page)))
    raw = good.select(*row(F.col(page), at, 0, F.concat(base, F.lit(".json.txt")), "application/json; charset=utf-8"))
    text = good.where("module = 'ocr'").select(*row(F.col(page), at, 1, F.concat(base, F.lit("-text.txt")), "text/plain; charset=utf-8"))
    crops = crop_names(objects.join(bad, doc, "left_anti"), doc, page)
    of = F.element_at(F.create_map(*[F.lit(x) for t, m, _ in OBJECT_TYPES for x in (t, [m for m, _ in FOLDERS].index(m))]), F.col("type"))
    pictures = crops.select(F.col(doc), F.col(page).alias("_p"), of.cast("int").alias("_m"), (F.col("ordinal") + 1).cast("int").alias("_s"), F.col("crop_key").alias("key"), F.lit("image/png").alias("content_type"))
    last = good.select(doc).distinct()
    whole = last.select(*row(F.lit(1 << 30), F.lit(0), 0, F.concat(prefix, F.lit("OCR.txt")), "text/plain; charset=utf-8"))
    layout = last.select(*row(F.lit(1 << 30), F.lit(0), 1, F.concat(prefix, F.lit("layout.json")), "application/json; charset=utf-8"))
    rows = raw.unionByName(text).unionByName(pictures).unionByName(whole).unionByName(layout)
    n = F.row_number().over(Window.partitionBy(doc).orderBy("_p", "_m", "_s", "key"))
    return rows.withColumn("position", n).select(doc, "position", "key", "content_type")


def write_artifacts(artifacts: DataFrame, folder: str, doc: str) -> None:
    """Writes artifacts (doc, key, content), a folder per document. Documents written before are replaced whole, others stay, so
    writing again gives the same; a prefix that is empty or leaves its folder is refused before anything is written."""
    if not folder.strip("/") or any(s in (".", "..") for s in folder.split("/")):
        raise ValueError("artifacts need a folder of their own")
    artifacts.withColumn("document", safe_segment(F.col(doc).cast("string"))).where("document IS NOT NULL").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document").parquet(folder)
