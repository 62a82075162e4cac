"""Joins of boxes on one page: exact union coverage, anti-joins on it, containment, nearest neighbours.

All joins are equi-joins on the page first, so a task holds pages, never the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import BOX, covered_share, overlap


def known_page(page: list[str]) -> Column:
    """False where a column of the page is null: boxes without a page share none."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in page])


def coverage_on_pages(objects: DataFrame, page: list[str], box: Column, region: Column) -> DataFrame:
    """Objects for which box holds, with coverage: the share of each that the objects of its page for which region holds cover
    together. All come as one frame; if that is dealt by any columns of the page already, nothing is shuffled."""
    regions = F.collect_list(F.when(region & known_page(page), F.struct(*BOX))).over(Window.partitionBy(*page))
    rows = objects.where(box | region).withColumn("_regions", regions).where(box)
    return rows.withColumn("coverage", covered_share(F.struct(*BOX), F.col("_regions"))).drop("_regions")


def union_coverage(boxes: DataFrame, regions: DataFrame, page: list[str], box_id: str) -> DataFrame:
    """(page..., box_id, coverage): the share of each box covered by at least one region of its page; 0 for empty boxes."""
    r = regions.select(*page, F.lit(None).cast(boxes.schema[box_id].dataType).alias(box_id), *BOX, F.lit(False).alias("_box"))
    rows = boxes.select(*page, box_id, *BOX, F.lit(True).alias("_box")).unionByName(r)
    return coverage_on_pages(rows, page, F.col("_box"), ~F.col("_box")).select(*page, box_id, "coverage")


def uncovered(boxes: DataFrame, regions: DataFrame, page: list[str], box_id: str, least: float = 0.65) -> DataFrame:
    """Boxes whose union coverage stays below `least`: the spatial anti-join."""
    return union_coverage(boxes, regions, page, box_id).where(F.col("coverage") < least)


def inside(lines: DataFrame, boxes: DataFrame, page: list[str], share: float = 0.8, confidence: float = 0.75) -> DataFrame:
    """Pairs of confident lines and boxes that hold at least `share` of the line."""
    b = boxes.select(*page, "box_id", *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    both = overlap(F.col("x1"), F.col("x2"), F.col("bx1"), F.col("bx2")) * overlap(F.col("y1"), F.col("y2"), F.col("by1"), F.col("by2"))
    return lines.where(F.col("confidence") >= confidence).join(b, page).where(both >= area * share)


def nearest(items: DataFrame, anchors: DataFrame, page: list[str], item_id: str) -> DataFrame:
    """The anchor with the nearest top left corner (L1), the first in order on ties; null on a page without anchors."""
    a = anchors.select(*page, F.col("ordinal").alias("anchor"), F.col("x1").alias("ax"), F.col("y1").alias("ay"))
    d = F.abs(F.col("x1") - F.col("ax")) + F.abs(F.col("y1") - F.col("ay"))
    return items.join(a, page, "left").groupBy(*page, item_id).agg(F.min_by("anchor", F.struct(d, F.col("anchor"))).alias("anchor"))


def rescued(boxes: DataFrame, figures: DataFrame, page: list[str], confidence: float = 0.8, share: float = 0.75) -> DataFrame:
    """Pages on which every unreadable box lies for `share` in one confident figure."""
    f = figures.where(F.col("confidence") >= confidence).select(*page, *[F.col(c).alias(f"f{c}") for c in ("x1", "y1", "x2", "y2")])
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    both = overlap(F.col("x1"), F.col("x2"), F.col("fx1"), F.col("fx2")) * overlap(F.col("y1"), F.col("y2"), F.col("fy1"), F.col("fy2"))
    one = boxes.join(f, page, "left").groupBy(*page, "ordinal").agg(F.coalesce(F.max(both / area >= share), F.lit(False)).alias("ok"))
    return one.groupBy(*page).agg(F.min("ok").alias("rescued"))
