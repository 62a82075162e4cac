"""Pages with a native text layer: checks, regions it misses, recovered text put among it, embedded pictures, reading order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import BOX, clamp, covered_share
from ..functions.text import let, text_key
from .spatial import known_page, union_coverage

# Padding of native boxes, shares from which a region counts as covered, as a picture, as text already there.
PADDING, COVERED, FIGURE_COVERED, TEXT_COVERED, FIGURE_CONFIDENCE = 0.005, 0.65, 0.85, 0.5, 0.5
MOST_BLOCKS, MOST_IGNORED, MOST_IMAGES, MOST_CHARACTERS = 10_000, 100, 1_000, 100_000


def text_verdict(text: Column) -> Column:
    """ok, or what is wrong with the text of a native block."""
    return (
        F.when(text.isNull() | ~text.rlike(r"(?U)\S"), "blank")
        .when(F.length(text) > MOST_CHARACTERS, "long")
        .when(text.contains("�"), "replacement")
        .when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control")
        .otherwise("ok")
    )


def box_verdict(width: Column, height: Column) -> Column:
    """ok, or what is wrong with a native box of the columns x1 .. y2."""
    x1, y1, x2, y2 = (F.col(c) for c in BOX)
    return F.when((x1 < 0) | (y1 < 0) | (x2 < x1) | (y2 < y1), "order").when((x2 <= x1) | (y2 <= y1), "empty").when((x2 > width) | (y2 > height), "outside").otherwise("ok")


def native_blocks(pages: DataFrame, page: list[str], blocks: str = "blocks") -> DataFrame:
    """One row per block of array<struct<text, x1, y1, x2, y2>>, in order, 1-based, with confidence 1 and its verdict.

    A page's block is judged against the page's own width and height.
    """
    rows = pages.select(*page, "width", "height", F.posexplode(blocks).alias("_i", "b")).select(*page, "width", "height", (F.col("_i") + 1).alias("reading_order"), "b.*")
    bad, shape = text_verdict(F.col("text")), box_verdict(F.col("width"), F.col("height"))
    return rows.withColumn("verdict", F.when(bad != "ok", bad).otherwise(shape)).withColumn("confidence", F.lit(1.0)).drop("width", "height")


def padded(regions: DataFrame, width: Column, height: Column, share: float = PADDING) -> DataFrame:
    """Regions grown by a share of the longer side, inside the page."""
    pad = F.greatest(width, height) * share
    low, high = (lambda c: F.greatest(F.lit(0.0), F.col(c) - pad)), (lambda c, size: F.least(size, F.col(c) + pad))
    return regions.withColumns({"x1": low("x1"), "y1": low("y1"), "x2": high("x2", width), "y2": high("y2", height)})


def missing_regions(boxes: DataFrame, known: DataFrame, figures: DataFrame, page: list[str], box_id: str, width: Column, height: Column, least: float = COVERED) -> DataFrame:
    """Detected boxes of which padded native regions and confident figures cover less than `least` together."""
    regions = padded(known.select(*page, *BOX), width, height).unionByName(figures.where(F.col("confidence") >= FIGURE_CONFIDENCE).select(*page, *BOX))
    return union_coverage(boxes, regions, page, box_id).where(F.col("coverage") < least)


def _tagged(page: list[str], **frames: DataFrame) -> DataFrame:
    """Rows of several frames as one, those of each as a struct in the column named after it."""
    kinds = {n: f.select(F.struct(*[c for c in f.columns if c not in page]).alias(n)).schema[n].dataType for n, f in frames.items()}
    one = lambda n, f: f.select(*page, *[(F.struct(*[c for c in f.columns if c not in page]) if n == m else F.lit(None).cast(t)).alias(m) for m, t in kinds.items()])
    return reduce(DataFrame.unionByName, [one(n, f) for n, f in frames.items()])


def _nearest(item: Column, anchors: Column) -> Column:
    """struct(d, o, y) of the nearest of array<struct<reading_order, x1, y1>> (L1 of the top left corners, the first in order on
    ties), or null."""
    apart = lambda a: F.struct((F.abs(item["x1"] - a["x1"]) + F.abs(item["y1"] - a["y1"])).alias("d"), a["reading_order"].alias("o"), a["y1"].alias("y"))
    return F.array_min(F.transform(F.filter(anchors, lambda a: a["reading_order"].isNotNull()), apart))


def recovered_on_pages(rows: DataFrame, page: list[str], share: float = TEXT_COVERED) -> DataFrame:
    """A row per page with native and new, the arrays of its native blocks and of the lines that say something new (with as_image).

    rows have the structs line, native and image, each null where a row is none; see recovered_text. If rows are dealt by any
    columns of the page already, nothing is shuffled.
    """
    key = text_key(F.col("line.text"))
    line = F.when((key != "") & known_page(page), F.struct("line.ordinal", key.alias("key"), "line"))
    said = F.when(F.col("native").isNotNull(), text_key(F.col("native.text")))
    box = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[f"{c}.{x}" for x in BOX]))
    pages = rows.groupBy(*page).agg(*[F.collect_list(v).alias(n) for n, v in (("_lines", line), ("native", F.col("native")), ("_said", said), ("_blocks", box("native")), ("_images", box("image")))])
    new = F.filter("_lines", lambda x: ~F.array_contains("_said", x["key"]) & (covered_share(x["line"], F.col("_blocks")) < share))
    placed = F.array_sort(F.transform(new, lambda x: F.struct(x["key"], x["ordinal"], x["line"])))  # the first of each key stays
    first = let(placed, lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["key"] != x["key"])))
    shown = F.transform(first, lambda x: F.struct(x["line"].alias("line"), (covered_share(x["line"], F.col("_images")) >= COVERED).alias("as_image")))
    return pages.select(*page, "native", F.when(F.size("_lines") > 0, shown).otherwise(F.filter(shown, lambda x: F.lit(False))).alias("new"))


def recovered_text(lines: DataFrame, native: DataFrame, images: DataFrame, page: list[str], share: float = TEXT_COVERED) -> DataFrame:
    """Lines read again that say something new: (page..., ordinal, text, x1 .. y2, confidence, as_image).

    lines, native: (page..., ordinal, text, x1 .. y2). A line goes if it is blank, if its text without blanks is a native block's
    or an earlier line's, or if native blocks cover `share` of it. as_image: an embedded picture covers it.
    """
    rows = _tagged(page, line=lines, native=native.select(*page, "text", *BOX), image=images.select(*page, *BOX))
    return recovered_lines(recovered_on_pages(rows, page, share), page)


def recovered_lines(pages: DataFrame, page: list[str]) -> DataFrame:
    """The new lines of recovered_on_pages(), a row each."""
    return pages.select(*page, F.explode("new").alias("_l")).select(*page, "_l.line.*", "_l.as_image")


def merged_on_pages(pages: DataFrame, page: list[str]) -> DataFrame:
    """merged_order() of pages with the arrays native, array<struct<ordinal, reading_order, x1, y1>>, and new, array<struct<ordinal,
    x1, y1>>. Lines of a page without blocks keep their order from the top."""
    place = lambda order, side, y, own, ordinal: F.struct(order.cast("long").alias("a"), side.alias("side"), y.alias("y"), F.lit(own).alias("is_native"), ordinal.alias("ordinal"))
    own = F.transform("native", lambda a: place(a["reading_order"], F.lit(1), F.lit(0.0), True, a["ordinal"]))
    side = lambda r, n: F.when(n["o"].isNull() | (r["y1"] < n["y"]), 0).otherwise(2)
    late = F.transform("new", lambda r: let(F.when(known_page(page), _nearest(r, F.col("native"))), lambda n: place(F.coalesce(n["o"], F.lit(0)), side(r, n), r["y1"], False, r["ordinal"])))
    rows = pages.select(*page, F.posexplode(F.array_sort(F.concat(own, late))).alias("_i", "_r"))
    return rows.select(*page, "_r.ordinal", "_r.is_native", (F.col("_i") + 1).alias("reading_order"))


def merged_order(native: DataFrame, recovered: DataFrame, page: list[str]) -> DataFrame:
    """(page..., ordinal, is_native, reading_order): recovered lines beside their nearest native block, numbered anew from 1.

    A line above its block goes before it, others after it.
    """
    rows = _tagged(page, native=native.select(*page, "ordinal", "reading_order", "x1", "y1"), new=recovered.select(*page, "ordinal", "x1", "y1"))
    return merged_on_pages(rows.groupBy(*page).agg(F.collect_list("native").alias("native"), F.collect_list("new").alias("new")), page)


def layout_order(objects: DataFrame, page: list[str]) -> DataFrame:
    """objects with reading_order: on pages all of whose paragraphs are native, visual objects go beside their nearest
    paragraph, before it unless they are below its top; on others all objects go from top and left.

    A page is one row on the way; if objects are dealt by any columns of the page already, nothing is shuffled.
    """
    kept = [c for c in objects.columns if c not in page]
    text = F.col("type") == "paragraph"
    anchor = F.when(text, F.struct(F.col("ordinal").alias("reading_order"), "x1", "y1"))
    pages = objects.groupBy(*page).agg(F.collect_list(F.struct(*kept)).alias("_o"), F.collect_list(anchor).alias("_anchors"), F.min(F.when(text, F.col("native"))).alias("_native"))
    native = F.coalesce(F.col("_native") & known_page(page), F.lit(False))
    key = lambda a, b, c, x2, kind, o, i: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), c.alias("c"), x2.alias("x2"), kind.alias("kind"), o["ordinal"].alias("ordinal"), i.alias("i"))
    beside = lambda o, n, i: key(n["o"], F.when(o["y1"] <= n["y"], 0).otherwise(2), o["y1"], F.lit(None).cast("double"), F.lit(None).cast("string"), o, i)
    own = lambda o, i: key(o["ordinal"], F.lit(1), F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("string"), o, i)
    plain = lambda o, i: key(o["y1"], o["x1"], o["y2"], o["x2"], o["type"], o, i)
    keys = F.transform("_o", lambda o, i: F.when(~native, plain(o, i)).when(o["type"] == "paragraph", own(o, i)).otherwise(let(_nearest(o, F.col("_anchors")), lambda n: beside(o, n, i))))
    rows = pages.select(*page, "_o", F.array_sort(keys).alias("_k"))
    rows = rows.select(*page, F.posexplode(F.transform("_k", lambda k: F.get("_o", k["i"]))).alias("_n", "_r"))
    return rows.select(*page, *[f"_r.{c}" for c in kept], (F.col("_n") + 1).alias("reading_order")).select(*objects.columns, "reading_order")


def figures_on_pages(rows: DataFrame, page: list[str], share: float = FIGURE_COVERED) -> DataFrame:
    """embedded_figures() of rows with the structs image and figure, each null where a row is none. A page is one row on the way; if
    rows are dealt by any columns of the page already, nothing is shuffled."""
    image = F.when(F.col("image").isNotNull(), F.struct("image.ordinal", *[f"image.{c}" for c in BOX]))
    figure = F.when(F.col("figure").isNotNull(), F.struct(*[f"figure.{c}" for c in BOX]))
    pages = rows.groupBy(*page).agg(F.array_sort(F.collect_list(image)).alias("_images"), F.collect_list(figure).alias("_known"))

    def step(a: Column, x: Column) -> Column:
        more = F.struct(F.concat(a["known"], F.array(F.struct(*[x[c].alias(c) for c in BOX]))).alias("known"), F.concat(a["taken"], F.array(x)).alias("taken"))
        return F.when(covered_share(x, a["known"]) < share, more).otherwise(a)

    zero = F.struct(F.col("_known").alias("known"), F.filter("_images", lambda x: F.lit(False)).alias("taken"))
    taken = F.aggregate("_images", zero, step, lambda a: a["taken"])
    return pages.where(F.size("_images") > 0).select(*page, F.inline(taken))


def embedded_figures(images: DataFrame, figures: DataFrame, page: list[str], share: float = FIGURE_COVERED) -> DataFrame:
    """Embedded pictures (page..., ordinal, x1 .. y2) that become figures: in order, each that known figures and those added
    before it cover less than `share` of. A page is a row's unit; its pictures are few (MOST_IMAGES)."""
    return figures_on_pages(_tagged(page, image=images.select(*page, "ordinal", *BOX), figure=figures.select(*page, *BOX)), page, share)


def crop_around(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """Whole pixels of a recovery crop: eight before and nine after a box's whole corners, inside the page."""
    whole = lambda c: c.cast("int")
    return [clamp(whole(x1) - 8, 0, width), clamp(whole(y1) - 8, 0, height), F.least(width, whole(x2) + 9), F.least(height, whole(y2) + 9)]


def unexpected_script(native: Column, recovered: Column) -> Column:
    """Whether a page with Latin or Arabic letters enough gets Chinese characters from a second reading only."""
    return (F.regexp_count(native, F.lit(r"\p{L}")) > 30) & ~native.rlike("[一-鿿]") & recovered.rlike("[一-鿿]")
