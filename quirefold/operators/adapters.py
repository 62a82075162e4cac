"""What detectors and recognisers give, as rows of objects and lines: thresholds, label maps, checks, source coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import polygon, restore
from .merge import OBJECT_TYPES, map_label

# Score thresholds, and the marks that class ids stand for.
TEXT_SCORE, LAYOUT_SCORE, MARK_SCORE = 0.45, 0.45, 0.5
MARKS = {0: "stamp", 1: "signature", 2: "checkbox_checked", 3: "checkbox_unchecked"}
MODULES = ("ocr", "figure_table", "stamp_signature")
NONE_FOUND = {"ocr": "no_text_detected", "figure_table": "no_figure_or_table_detected", "stamp_signature": "no_stamp_or_signature_detected"}


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def recognised_lines(results: DataFrame, page: list[str], least: float = TEXT_SCORE) -> DataFrame:
    """Parallel arrays texts, scores, boxes (array<double> of four) as lines (page..., reading_order, text, confidence, x1 .. y2).

    A missing score counts as 0; blank texts, scores below `least` and boxes that are none go. Lines are numbered from 0, from
    the top and, in a line, from the right.
    """
    rows = results.select(*page, F.posexplode(F.arrays_zip("texts", "scores", "boxes")).alias("_i", "r"))
    rows = rows.select(*page, "_i", F.col("r.texts").alias("text"), F.coalesce("r.scores", F.lit(0.0)).alias("score"), F.col("r.boxes").alias("b"))
    rows = rows.where((F.col("score") >= least) & F.col("text").rlike(r"(?U)\S") & (F.size("b") == 4))
    rows = rows.select(*page, "_i", "text", unit(F.col("score")).alias("confidence"), *[F.col("b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    n = F.row_number().over(Window.partitionBy(*page).orderBy("y1", F.desc("x1"), "y2", "_i")) - 1
    return rows.withColumn("reading_order", n).drop("_i")


def mark_objects(results: DataFrame, page: list[str], least: float = MARK_SCORE) -> DataFrame:
    """Parallel arrays xyxy, confidence, class_id, class_name as stamps and signatures. A known class id wins over a name."""
    rows = results.select(*page, F.posexplode("xyxy").alias("_i", "b"), "confidence", "class_id", "class_name")
    at = lambda c: F.get(F.col(c), F.col("_i"))
    known = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    rows = rows.select(*page, F.col("_i").alias("ordinal"), F.coalesce(F.try_element_at(known, at("class_id")), at("class_name")).alias("type"), F.coalesce(at("confidence"), F.lit(0.0)).alias("confidence"), *[F.col("b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    return rows.where(F.col("type").isin("stamp", "signature") & (F.col("confidence") >= least)).withColumn("confidence", unit(F.col("confidence")))


def layout_objects(items: DataFrame, scale_x: Column, scale_y: Column, width: Column, height: Column, least: float = LAYOUT_SCORE) -> DataFrame:
    """Layout items (label, confidence, x1 .. y2 in model pixels) as tables and figures in source pixels, with corners."""
    rows = items.where(F.col("confidence") >= least).withColumn("type", map_label(F.col("label"))).where("type IS NOT NULL")
    at = {"x1": (scale_x, width), "y1": (scale_y, height), "x2": (scale_x, width), "y2": (scale_y, height)}
    rows = rows.withColumns({c: restore(F.col(c), *s) for c, s in at.items()})
    return rows.withColumn("polygon", polygon(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])).withColumnRenamed("label", "source_label")


def quad_verdict(points: Column) -> Column:
    """ok, or why a detector's polygon, array<array<double>>, is none of four finite points."""
    fine = F.forall(points, lambda p: (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return F.when(points.isNull(), "missing").when((F.size(points) != 4) | ~F.coalesce(fine, F.lit(False)), "points").otherwise("ok")


def clipped(points: Column, width: Column, height: Column) -> Column:
    """Points inside the picture's pixels."""
    inside = lambda v, size: F.greatest(F.lit(0.0), F.least(size - 1, v))
    return F.transform(points, lambda p: F.struct(inside(p[0], width).alias("x"), inside(p[1], height).alias("y")))


def extent(points: Column) -> dict[str, Column]:
    """The box around points array<struct<x, y>>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def ordered_quad(points: Column) -> Column:
    """The four points from the top left, clockwise: least x + y, least y - x, greatest x + y, greatest y - x; the first on ties."""
    ranked = F.transform(points, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), (p["y"] - p["x"]).alias("d"), i.alias("i"), p.alias("p")))
    by = lambda key, sign: F.array_min(F.transform(ranked, lambda r: F.struct((r[key] * sign).alias("k"), r["i"].alias("i"), r["p"].alias("p"))))["p"]
    return F.array(by("s", 1), by("d", 1), by("s", -1), by("d", -1))


def object_verdict(columns: dict[str, Column]) -> Column:
    """ok, or the invariant that an object's box or confidence breaks."""
    x1, y1, x2, y2, c = (columns[k] for k in ("x1", "y1", "x2", "y2", "confidence"))
    return F.when((x1 < 0) | (y1 < 0), "negative").when((x2 < x1) | (y2 < y1), "order").when((c < 0) | (c > 1) | F.isnan(c), "confidence").otherwise("ok")


def document_objects(parts: dict[str, DataFrame], columns: list[str], doc: str, page: str) -> DataFrame:
    """All modules' objects of a document in one order (page, y1, x1, type, then module and ordinal), each module giving its own types only."""
    allowed = {m: [t for t, module, _ in OBJECT_TYPES if module == m] for m in MODULES}
    rows = None
    for i, m in enumerate(MODULES):
        if m in parts:
            part = parts[m].where(F.col("type").isin(*allowed[m])).select(*columns, F.lit(m).alias("module"), F.lit(i).alias("_m"))
            rows = part if rows is None else rows.unionByName(part)
    n = F.row_number().over(Window.partitionBy(doc).orderBy(page, "y1", "x1", "type", "_m", "ordinal"))
    return rows.withColumn("position", n).drop("_m")


def page_modules(pages: DataFrame, results: DataFrame, page: list[str], modules: tuple[str, ...] = MODULES) -> DataFrame:
    """A page with the states and warnings of its modules, in their order: (page..., states, warnings, n_objects).

    results: (page..., module, state, warnings, n_objects). A module without a result has failed, which is a warning; an ended
    module without objects warns that it found none. modules: the ones selected.
    """
    chosen = [m for m in MODULES if m in modules]
    if not chosen:
        raise ValueError("select a module at least")
    want = pages.select(*page, F.posexplode(F.array(*[F.lit(m) for m in chosen])).alias("_i", "module"))
    rows = want.join(results, [*page, "module"], "left")
    failed = F.col("state").isNull() | (F.col("state") == "failed")
    none = F.when(F.coalesce("n_objects", F.lit(0)) == 0, F.array(F.element_at(F.create_map(*[F.lit(x) for p in NONE_FOUND.items() for x in p]), F.col("module"))))
    said = F.when(failed, F.array(F.concat("module", F.lit("_failed")))).otherwise(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.coalesce(none, F.array().cast("array<string>"))))
    one = F.struct("_i", "module", F.when(failed, "failed").otherwise("success").alias("state"), said.alias("warnings"), F.coalesce("n_objects", F.lit(0)).cast("long").alias("n"))
    got = rows.groupBy(*page).agg(F.array_sort(F.collect_list(one)).alias("m"))
    ok = F.size(F.filter("m", lambda x: x["state"] == "success"))
    state = F.when(ok == F.size("m"), "success").when(ok == 0, "failed").otherwise("partial_success")
    return got.select(*page, state.alias("state"), F.map_from_entries(F.transform("m", lambda x: F.struct(x["module"], x["state"]))).alias("states"), F.flatten(F.transform("m", lambda x: x["warnings"])).alias("warnings"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_objects"))
