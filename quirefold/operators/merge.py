"""Merging detector results: counts, states, orders, names, nested documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Object types with the module and folder each belongs to.
OBJECT_TYPES = (
    ("paragraph", "ocr", "ocr"),
    ("table", "figure_table", "tables"),
    ("figure", "figure_table", "figures"),
    ("stamp", "stamp_signature", "stamps"),
    ("signature", "stamp_signature", "signatures"),
)
# Labels that layout detectors give tables and figures.
TABLE_LABELS, FIGURE_LABELS = ("table",), ("figure", "image", "chart")


def map_label(label: Column) -> Column:
    """table, figure or null. Captions are refused only where a label is taken by its prefix or by a word in it."""
    n = F.lower(F.trim(label))
    return (
        F.when(n.isin(*TABLE_LABELS) | (n.startswith("table") & ~n.contains("caption")), "table")
        .when(n.isin(*FIGURE_LABELS), "figure")
        .when(n.rlike("figure|image|chart") & ~n.rlike("caption|title"), "figure")
    )


def type_counts(objects: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with a zero-filled count per type and their total."""
    return objects.groupBy(*keys).agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t, *_ in OBJECT_TYPES], F.count(F.lit(1)).alias("n_objects"))


def counts_rollup(objects: DataFrame, doc: str, page: str) -> DataFrame:
    """Page and document counts in one pass; page is null in a document's row."""
    out = objects.rollup(doc, page).agg(F.grouping_id().alias("level"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t, *_ in OBJECT_TYPES])
    return out.where("level < 3")


def roll_state(ok: Column, total: Column) -> Column:
    return F.when((total > 0) & (ok == total), "success").when((total > 0) & (ok == 0), "failed").otherwise("partial")


def weighted_confidence() -> Column:
    """Mean confidence weighted by area, an area counting as one pixel at least, inside [0, 1]."""
    area = F.greatest(F.lit(1.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("confidence") * area) / F.sum(area)))


def reading_order(objects: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("y1", "x1", "y2", "x2", "type", "ordinal")
    return objects.withColumn("reading_order", F.row_number().over(w))


def crop_names(objects: DataFrame, doc: str, page: str) -> DataFrame:
    """documents/{doc}/{folder}/page-NNN-{type}-NNN.png for visual objects, counted by page and type."""
    visual = objects.where("type <> 'paragraph'")
    n = F.row_number().over(Window.partitionBy(doc, page, "type").orderBy("ordinal"))
    folder = F.element_at(F.create_map(*[x for t, _, d in OBJECT_TYPES for x in (F.lit(t), F.lit(d))]), F.col("type"))
    return visual.withColumn("crop_key", F.format_string("documents/%s/%s/page-%03d-%s-%03d.png", F.col(doc).cast("string"), folder, F.col(page).cast("int"), F.col("type"), n))


def joined_text(rows: DataFrame, keys: list[str], order: str, text: str, sep: str) -> DataFrame:
    """Non-empty texts of a group joined in order."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text) != "", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), sep).alias("joined"))


def text_digests(rows: DataFrame, key: str, order: str, text: str, sep: str) -> DataFrame:
    """md5 of what joined_text makes of each key. Texts stream through in order, so that no group is held as a whole; rows without an
    order come last, as in SQL, and rows of equal order, which SQL leaves open, go by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, md5, empty = None, None, None, True
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], schema.field(0).type), pa.array([md5.hexdigest()])], [key, "digest"])
        for b in batches:
            schema = b.schema
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if md5 is None or k != now:
                    if md5 is not None:
                        yield done()
                    now, md5, empty = k, hashlib.md5(), True
                if t:
                    md5.update(t if empty else sep.encode() + t)
                    empty = False
        if md5 is not None:
            yield done()

    placed = rows.repartition(key).sortWithinPartitions(key, F.col(order).asc_nulls_last(), text).select(key, F.col(text).cast("binary").alias("t"))
    return placed.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, digest string")


def layout_documents(objects: DataFrame, doc: str, page: str) -> DataFrame:
    """One nested row per document: pages in order, objects of each in reading order."""
    placed = reading_order(objects, [doc, page])
    item = F.struct("reading_order", "type", "x1", "y1", "x2", "y2")
    pages = placed.groupBy(doc, page).agg(F.array_sort(F.collect_list(item)).alias("objects"))
    return pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page_number"), "objects"))).alias("pages"), F.count(F.lit(1)).alias("page_count"), F.sum(F.size("objects")).alias("object_count"))
