"""Lines into paragraphs, rows and list runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import x_overlap_ratio

# Paragraph gaps, rows and list runs.
GAP_RATIO, MIN_X_OVERLAP, ROW_SHARE = 1.8, 0.15, 0.55


def paragraph_ids(lines: Column, median: Column, gap_ratio: float = GAP_RATIO, min_overlap: float = MIN_X_OVERLAP) -> Column:
    """Group numbers of ordered lines, array<struct<hard, x1, y1, x2, y2>>. A line begins a group if it is a hard start, too far
    below or above the last line, or hardly overlaps the group's box so far; that box evolves, hence a fold."""

    def step(a: Column, l: Column) -> Column:  # noqa: E741
        gap = l["y1"] - a["y2"]
        new = (F.size(a["out"]) == 0) | l["hard"] | (gap > median * gap_ratio) | (gap < -median) | (x_overlap_ratio(l["x1"], l["x2"], a["x1"], a["x2"]) < min_overlap)
        gid = a["gid"] + new.cast("int")
        return F.struct(
            gid.alias("gid"),
            F.when(new, l["x1"]).otherwise(F.least(a["x1"], l["x1"])).alias("x1"),
            F.when(new, l["x2"]).otherwise(F.greatest(a["x2"], l["x2"])).alias("x2"),
            l["y2"].alias("y2"),
            F.concat(a["out"], F.array(gid)).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("gid"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("x2"), F.lit(0.0).alias("y2"), F.expr("CAST(array() AS array<int>)").alias("out"))
    return F.aggregate(lines, zero, step, lambda a: a["out"])


def row_ids(boxes: Column, share: float = ROW_SHARE) -> Column:
    """Row numbers of boxes ordered by centre, array<struct<cy, h>>: a box joins the last row if its centre is near the row's mean."""

    def step(a: Column, b: Column) -> Column:
        mean, high = a["cy"] / F.greatest(a["n"], F.lit(1)), a["h"] / F.greatest(a["n"], F.lit(1))
        new = (a["n"] == 0) | (F.abs(b["cy"] - mean) > F.greatest(b["h"], high) * share)
        keep = (~new).cast("int")
        rid = a["rid"] + new.cast("int")
        return F.struct(
            rid.alias("rid"), (a["n"] * keep + 1).alias("n"), (a["cy"] * keep + b["cy"]).alias("cy"), (a["h"] * keep + b["h"]).alias("h"), F.concat(a["out"], F.array(rid)).alias("out")
        )

    zero = F.struct(F.lit(0).alias("rid"), F.lit(0).alias("n"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("h"), F.expr("CAST(array() AS array<int>)").alias("out"))
    return F.aggregate(boxes, zero, step, lambda a: a["out"])


def marker_runs(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines (doc, line_no, letter, strong) whose marker is accepted: in a run of following letters at most two lines apart, of
    three or of two with a strong one, or strong itself. Adds run and accepted."""
    order = Window.partitionBy(doc).orderBy("line_no")
    pos = F.ascii("letter")
    breaks = F.coalesce(((F.col("line_no") - F.lag("line_no").over(order) > 2) | (pos - F.lag(pos).over(order) != 1)).cast("int"), F.lit(1))
    runs = lines.withColumn("_b", breaks).withColumn("run", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")
    whole = Window.partitionBy(doc, "run")
    n, any_strong = F.count(F.lit(1)).over(whole), F.max("strong").over(whole)
    return runs.withColumn("accepted", (n >= 3) | ((n >= 2) & any_strong) | F.col("strong"))
