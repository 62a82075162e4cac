"""Queries over native text layers, detector results and published artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import adapters, merge, native, publish
from ..session import table
from .queries import _COVER, _REGIONS
from .registry import query
from .views import OBJECTS, objects

PAGE = ["doc_id", "page"]


def _with(**named: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in named.items()) + " "


def _cover(boxes: str, regions: str, tag: str) -> str:
    """The coverage steps of union_coverage in SQL, their names ending in tag."""
    out = _COVER.replace(_REGIONS, regions).replace("FROM boxes", f"FROM ({boxes})")
    for name in ("clip", "edges", "slabs", "parts", "area", "cov"):
        for before, after in ((f"{name} AS (", f"{name}{tag} AS ("), (f"FROM {name} ", f"FROM {name}{tag} "), (f"JOIN {name} ", f"JOIN {name}{tag} "), (f"FROM {name})", f"FROM {name}{tag})"), (f"FROM {name}\n", f"FROM {name}{tag}\n")):
            out = out.replace(before, after)
    return out.strip()


# ---------------------------------------------------------------- native text layers
_PADDED = "SELECT doc_id, page, greatest(0.0, x1 - 5) AS x1, greatest(0.0, y1 - 5) AS y1, least(1000.0, x2 + 5) AS x2, least(1000.0, y2 + 5) AS y2 FROM o WHERE type IN ('stamp', 'signature', 'table') UNION ALL SELECT doc_id, page, x1, y1, x2, y2 FROM o WHERE type = 'figure' AND confidence >= 0.5"
_PARAGRAPHS = "SELECT * FROM o WHERE type = 'paragraph'"


@query(_with(o=OBJECTS).strip() + ", " + _cover(_PARAGRAPHS, _PADDED, "") + " SELECT doc_id, page, ordinal, coverage FROM cov WHERE coverage < 0.65")
def native_missing_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    size = F.lit(1000.0)
    m = native.missing_regions(o.where("type = 'paragraph'"), o.where("type IN ('stamp', 'signature', 'table')"), o.where("type = 'figure'"), PAGE, "ordinal", size, size)
    return m.withColumn("coverage", F.round("coverage", 6))


_BAD = "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text || chr(65533) WHEN 2 THEN text || chr(7) WHEN 3 THEN '  ' ELSE text || chr(9) END"


@query(f"""SELECT doc_id, line AS reading_order, CASE WHEN trim(replace(t, chr(9), ' ')) = '' THEN 'blank' WHEN length(t) > 100000 THEN 'long' WHEN contains(t, chr(65533)) THEN 'replacement' WHEN contains(t, chr(7)) THEN 'control' WHEN line % 4 = 3 THEN 'empty' WHEN line * 50 + 40 > 100 + doc_id % 300 THEN 'outside' ELSE 'ok' END AS verdict, 1.0::double AS confidence
FROM (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1)::int AS line FROM (SELECT doc_id, string_split({_BAD}, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))""")
def native_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id") % 5
    odd = F.when(k == 1, F.concat(t, F.lit("�"))).when(k == 2, F.concat(t, F.lit("\x07"))).when(k == 3, F.lit("  ")).when(k == 4, F.concat(t, F.lit("\t"))).otherwise(t)
    block = lambda l, i: F.struct(l.alias("text"), F.lit(10.0).alias("x1"), ((i + 1) * 50.0).alias("y1"), F.when((i + 1) % 4 == 3, 10.0).otherwise(90.0).alias("x2"), ((i + 1) * 50.0 + 40).alias("y2"))
    pages = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.lit(100.0).alias("width"), (100.0 + F.col("doc_id") % 300).alias("height"), F.transform(F.split(odd, "\n"), block).alias("blocks"))
    return native.native_blocks(pages, ["doc_id"]).select("doc_id", "reading_order", "verdict", "confidence")


_SAID = "type || ' ' || (x1::int % 7) || CASE WHEN ordinal % 5 = 0 THEN ' ' ELSE '' END"
_NATIVE, _LATE, _IMAGES = "SELECT * FROM s WHERE type = 'paragraph'", "SELECT * FROM s WHERE type IN ('stamp', 'signature')", "SELECT doc_id, page, x1, y1, x2, y2 FROM o WHERE type = 'table'"
_FRESH = f"""n1 AS (SELECT s.*, regexp_replace(text, '\\s+', '', 'g') AS key FROM ({_LATE}) s),
n2 AS (SELECT * FROM n1 WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.type = 'paragraph' AND t.doc_id = n1.doc_id AND t.page = n1.page AND regexp_replace(t.text, '\\s+', '', 'g') = n1.key)),
{_cover('SELECT * FROM n2', "SELECT doc_id, page, x1, y1, x2, y2 FROM s WHERE type = 'paragraph'", '_a')},
n3 AS (SELECT n2.* FROM n2 JOIN cov_a USING (doc_id, page, ordinal) WHERE coverage < 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id, page, key ORDER BY ordinal) = 1),
{_cover('SELECT * FROM n3', _IMAGES, '_b')}"""
_SPOKEN = f"SELECT *, replace({_SAID}, 'signature', 'stamp') AS text FROM o"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a text, stamps and signatures sharing theirs."""
    said = F.concat("type", F.lit(" "), (F.col("x1").cast("int") % 7).cast("string"), F.when(F.col("ordinal") % 5 == 0, " ").otherwise(""))
    return objects(spark, sf_dir).withColumn("text", F.replace(said, F.lit("signature"), F.lit("stamp")))


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their native blocks and new lines, from one scan of the objects."""
    o, item = _spoken(spark, sf_dir), F.struct("ordinal", F.col("ordinal").alias("reading_order"), "text", *native.BOX)
    kind = lambda *types: F.when(F.col("type").isin(*types), item)
    rows = o.select(*PAGE, kind("stamp", "signature").alias("line"), kind("paragraph").alias("native"), kind("table").alias("image"))
    return native.recovered_on_pages(rows.where("line IS NOT NULL OR native IS NOT NULL OR image IS NOT NULL"), PAGE)


@query(_with(o=OBJECTS, s=_SPOKEN).strip() + ", " + _FRESH + " SELECT doc_id, page, ordinal, text, coverage >= 0.65 AS as_image FROM n3 JOIN cov_b USING (doc_id, page, ordinal)")
def recovered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.recovered_lines(_recovered(spark, sf_dir), PAGE).select(*PAGE, "ordinal", "text", "as_image")


@query(
    _with(o=OBJECTS, s=_SPOKEN).strip()
    + ", "
    + _FRESH
    + """, na AS (SELECT doc_id, page, ordinal, x1, y1 FROM s WHERE type = 'paragraph'),
ne AS (SELECT n3.doc_id, n3.page, n3.ordinal, n3.y1, na.ordinal AS ao, na.y1 AS ay, row_number() OVER (PARTITION BY n3.doc_id, n3.page, n3.ordinal ORDER BY abs(n3.x1 - na.x1) + abs(n3.y1 - na.y1), na.ordinal) AS rk FROM n3 LEFT JOIN na USING (doc_id, page)),
al AS (SELECT doc_id, page, ordinal, true AS is_native, ordinal AS a, 1 AS sd, 0.0 AS y FROM na UNION ALL SELECT doc_id, page, ordinal, false, coalesce(ao, 0), CASE WHEN ao IS NULL OR y1 < ay THEN 0 ELSE 2 END, y1 FROM ne WHERE rk = 1)
SELECT doc_id, page, ordinal, is_native, row_number() OVER (PARTITION BY doc_id, page ORDER BY a, sd, y, is_native, ordinal)::int AS reading_order FROM al"""
)
def native_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _recovered(spark, sf_dir)
    return native.merged_on_pages(pages.withColumn("new", F.transform("new", lambda x: x["line"])), PAGE)


@query(
    _with(o=OBJECTS).strip()
    + """, p AS (SELECT doc_id, page, ordinal AS ao, x1 AS ax, y1 AS ay FROM o WHERE type = 'paragraph' AND doc_id % 3 <> 0), w AS (SELECT DISTINCT doc_id, page FROM p),
ne AS (SELECT o.doc_id, o.page, o.ordinal, ao, CASE WHEN y1 <= ay THEN 0 ELSE 2 END AS sd, row_number() OVER (PARTITION BY o.doc_id, o.page, o.ordinal ORDER BY abs(x1 - ax) + abs(y1 - ay), ao) AS rk FROM o JOIN p USING (doc_id, page) WHERE type <> 'paragraph'),
k AS (SELECT o.*, w.doc_id IS NOT NULL AS nat, ao, sd FROM o LEFT JOIN w USING (doc_id, page) LEFT JOIN (SELECT * FROM ne WHERE rk = 1) n USING (doc_id, page, ordinal))
SELECT doc_id, page, ordinal, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN nat THEN CASE WHEN type = 'paragraph' THEN ordinal ELSE ao END ELSE y1 END, CASE WHEN nat THEN CASE WHEN type = 'paragraph' THEN 1 ELSE sd END ELSE x1 END, CASE WHEN nat THEN CASE WHEN type = 'paragraph' THEN 0 ELSE y1 END ELSE y2 END, CASE WHEN nat THEN 0 ELSE x2 END, CASE WHEN nat THEN '' ELSE type END, ordinal)::int AS reading_order FROM k"""
)
def native_layout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir).withColumn("native", F.col("doc_id") % 3 != 0).drop("confidence")
    return native.layout_order(o, PAGE).select(*PAGE, "ordinal", "reading_order")


@query()
def embedded_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential, so without SQL; tests hold it against a count of pixels."""
    item, kind = F.struct("ordinal", *native.BOX), F.col("type")
    image, figure = F.when(kind.isin("table", "stamp", "signature"), item), F.when(kind == "figure", item)
    rows = objects(spark, sf_dir).select(*PAGE, image.alias("image"), figure.alias("figure"))
    return native.figures_on_pages(rows.where("image IS NOT NULL OR figure IS NOT NULL"), PAGE)


@query(_with(o=OBJECTS) + "SELECT doc_id, ordinal, greatest(0, least(600, trunc(x1)::int - 8)) AS cx1, greatest(0, least(800, trunc(y1)::int - 8)) AS cy1, least(600, trunc(x2)::int + 9) AS cx2, least(800, trunc(y2)::int + 9) AS cy2 FROM o")
def recovery_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = native.crop_around(*[F.col(x) for x in native.BOX], F.lit(600), F.lit(800))
    return objects(spark, sf_dir).select("doc_id", "ordinal", *[v.alias(n) for v, n in zip(c, ("cx1", "cy1", "cx2", "cy2"), strict=True)])


_CJK = "CASE doc_id % 3 WHEN 0 THEN '漢字' WHEN 1 THEN 'text' ELSE '漢' || text END"


@query(f"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g')) > 30 AND NOT regexp_matches(coalesce(text, ''), '[一-鿿]') AND regexp_matches({_CJK.replace('|| text', '')}, '[一-鿿]') AS refused FROM documents".replace("ELSE '漢'  END", "ELSE '漢' END"))
def script_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("doc_id") % 3 == 0, "漢字").when(F.col("doc_id") % 3 == 1, "text").otherwise("漢")
    return table(spark, sf_dir, "documents").select("doc_id", native.unexpected_script(F.coalesce("text", F.lit("")), second).alias("refused"))


# ---------------------------------------------------------------- detectors and recognisers
_ITEMS = "SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS i, l_partkey % 500 AS x, l_suppkey % 70 AS y, l_quantity AS q, l_discount * 10 AS score, l_partkey AS k FROM lineitem"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ITEMS.replace("FROM lineitem", "FROM {li}"), li=table(spark, sf_dir, "lineitem"))


def _listed(rows: DataFrame, **cols) -> DataFrame:
    one = F.array_sort(F.collect_list(F.struct("i", *[c.alias(n) for n, c in cols.items()])))
    g = rows.groupBy("doc_id").agg(one.alias("l"))
    return g.select("doc_id", *[F.col("l")[n].alias(n) for n in cols])


@query(f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY y, -x, y2, i) - 1)::int AS reading_order, text, least(1.0, score) AS confidence, x::double AS x1, y::double AS y1 FROM (SELECT *, y + q AS y2, CASE k % 6 WHEN 0 THEN ' ' ELSE 'line ' || k END AS text, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_ITEMS})) WHERE i < n - 1 AND score >= 0.45 AND trim(text) <> ''")
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    box = F.array(F.col("x").cast("double"), F.col("y").cast("double"), F.col("x") + 90.0, F.col("y") + F.col("q"))
    r = _listed(_items(spark, sf_dir), texts=F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit("line "), k.cast("string"))), scores=F.col("score"), boxes=box)
    r = r.withColumn("scores", F.slice("scores", F.lit(1), F.size("scores") - 1))  # the last line has no score
    return adapters.recognised_lines(r, ["doc_id"]).select("doc_id", "reading_order", "text", "confidence", "x1", "y1")


@query(f"SELECT doc_id, i::int AS ordinal, type, least(1.0, score) AS confidence, x::double AS x1 FROM (SELECT *, CASE k % 6 WHEN 0 THEN 'stamp' WHEN 1 THEN 'signature' WHEN 2 THEN 'checkbox_checked' WHEN 3 THEN 'checkbox_unchecked' WHEN 4 THEN 'stamp' ELSE 'logo' END AS type FROM ({_ITEMS})) WHERE type IN ('stamp', 'signature') AND score >= 0.5")
def mark_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 6
    box = F.array(F.col("x").cast("double"), F.col("y").cast("double"), F.col("x") + 90.0, F.col("y") + F.col("q"))
    r = _listed(_items(spark, sf_dir), xyxy=box, confidence=F.col("score"), class_id=k.cast("int"), class_name=F.when(k == 5, "logo").otherwise("stamp"))
    return adapters.mark_objects(r, ["doc_id"]).select("doc_id", "ordinal", "type", "confidence", "x1")


@query(f"SELECT doc_id, i AS ordinal, type, round(least(600.0, x / 0.5), 6) AS x1, round(least(800.0, (y + q) / 0.25), 6) AS y2, least(600.0, (x + 90) / 0.5) AS corner FROM (SELECT *, CASE k % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'figure' ELSE NULL END AS type FROM ({_ITEMS})) WHERE type IS NOT NULL AND score >= 0.45")
def layout_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 4
    r = _items(spark, sf_dir).select("doc_id", F.col("i").alias("ordinal"), F.when(k == 0, " Table ").when(k == 1, "chart").when(k == 2, "figure_body").otherwise("figure_caption").alias("label"), F.col("score").alias("confidence"), F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), (F.col("x") + 90.0).alias("x2"), (F.col("y") + F.col("q")).alias("y2"))
    o = adapters.layout_objects(r, F.lit(0.5), F.lit(0.25), F.lit(600.0), F.lit(800.0))
    return o.select("doc_id", "ordinal", "type", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"), F.col("polygon")[1]["x"].alias("corner"))


_QUAD = "[{'x': x::double, 'y': y::double}, {'x': x + 90.0, 'y': y + 5.0}, {'x': x + 85.0, 'y': y + q}, {'x': x - 3.0, 'y': y + q - 4}]"
_CLIP = f"list_transform({_QUAD}, lambda p: {{'x': greatest(0.0, least(399.0, p.x)), 'y': greatest(0.0, least(99.0, p.y))}})"


@query(f"""WITH q AS (SELECT doc_id, i, {_CLIP} AS c, k % 5 AS kind FROM ({_ITEMS})),
e AS (SELECT *, list_min(list_transform(c, lambda p: p.x)) AS x1, list_min(list_transform(c, lambda p: p.y)) AS y1, list_max(list_transform(c, lambda p: p.x)) AS x2, list_max(list_transform(c, lambda p: p.y)) AS y2 FROM q),
v AS (SELECT doc_id, i, unnest(c) AS p, generate_subscripts(c, 1) AS j FROM q)
SELECT doc_id, i AS ordinal, CASE WHEN kind = 4 THEN 'points' WHEN kind = 3 THEN 'missing' WHEN x2 <= x1 OR y2 <= y1 THEN 'area' ELSE 'ok' END AS verdict, CASE WHEN kind < 3 THEN x1 END AS x1, CASE WHEN kind < 3 THEN y2 END AS y2,
  CASE WHEN kind < 3 THEN tl END AS top_left, CASE WHEN kind < 3 THEN tr END AS top_right FROM e JOIN (SELECT doc_id, i, arg_min(p.x, (p.x + p.y) * 10 + j * 0.0001) AS tl, arg_min(p.y, (p.y - p.x) * 10 + j * 0.0001) AS tr FROM v GROUP BY ALL) USING (doc_id, i)""")
def detector_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, q = F.col("x"), F.col("y"), F.col("q")
    point = lambda a, b: F.array(a.cast("double"), b.cast("double"))
    quad = F.array(point(x, y), point(x + 90, y + 5), point(x + 85, y + q), point(x - 3, y + q - 4))
    k = F.col("k") % 5
    r = _items(spark, sf_dir).select("doc_id", F.col("i").alias("ordinal"), F.when(k == 4, F.slice(quad, 1, 3)).when(k < 3, quad).alias("points"))
    c, bad = adapters.clipped(F.col("points"), F.lit(400.0), F.lit(100.0)), adapters.quad_verdict(F.col("points"))
    r = r.withColumn("bad", bad).withColumn("c", F.when(F.col("bad") == "ok", c))
    r = r.withColumns(adapters.extent(F.col("c")))
    verdict = F.when(F.col("bad") != "ok", F.col("bad")).when((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), "area").otherwise("ok")
    o = adapters.ordered_quad(F.col("c"))
    return r.select("doc_id", "ordinal", verdict.alias("verdict"), "x1", "y2", F.when(F.col("bad") == "ok", o[0]["x"]).alias("top_left"), F.when(F.col("bad") == "ok", o[1]["y"]).alias("top_right"))


@query(_with(o=OBJECTS) + "SELECT doc_id, ordinal, CASE type WHEN 'paragraph' THEN 'ocr' WHEN 'table' THEN 'figure_table' WHEN 'figure' THEN 'figure_table' ELSE 'stamp_signature' END AS module, row_number() OVER (PARTITION BY doc_id ORDER BY page, y1, x1, type, ordinal)::int AS position FROM o")
def document_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    return adapters.document_objects({m: o for m in adapters.MODULES}, ["doc_id", "page", "ordinal", "type", "x1", "y1"], "doc_id", "page").select("doc_id", "ordinal", "module", "position")


_MODULE = "CASE type WHEN 'paragraph' THEN 'ocr' WHEN 'table' THEN 'figure_table' WHEN 'figure' THEN 'figure_table' ELSE 'stamp_signature' END"


@query(
    _with(o=OBJECTS).strip()
    + f""", r AS (SELECT doc_id, page, {_MODULE} AS module, count(*) AS n, (doc_id + page) % 5 = 0 AND {_MODULE} = 'ocr' AS bad FROM o GROUP BY ALL),
w AS (SELECT p.doc_id, p.page, m.module, m.i, CASE WHEN r.n IS NULL OR bad THEN 'failed' ELSE 'success' END AS state, CASE WHEN r.n IS NULL OR bad THEN m.module || '_failed' ELSE 'w' || r.n END AS said, coalesce(n, 0) AS n FROM (SELECT DISTINCT doc_id, page FROM o) p, (VALUES ('ocr', 0), ('figure_table', 1), ('stamp_signature', 2)) m(module, i) LEFT JOIN r ON r.doc_id = p.doc_id AND r.page = p.page AND r.module = m.module)
SELECT doc_id, page, CASE WHEN count(*) FILTER (state = 'success') = 3 THEN 'success' WHEN count(*) FILTER (state = 'success') = 0 THEN 'failed' ELSE 'partial_success' END AS state, string_agg(said, ',' ORDER BY i) AS warnings, string_agg(state, ',' ORDER BY i) AS states, sum(n)::bigint AS n_objects FROM w GROUP BY ALL"""
)
def page_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    module = F.when(F.col("type") == "paragraph", "ocr").when(F.col("type").isin("table", "figure"), "figure_table").otherwise("stamp_signature")
    r = o.groupBy(*PAGE, module.alias("module")).agg(F.count(F.lit(1)).alias("n_objects"))
    r = r.withColumn("state", F.when(((F.col("doc_id") + F.col("page")) % 5 == 0) & (F.col("module") == "ocr"), "failed").otherwise("success")).withColumn("warnings", F.array(F.concat(F.lit("w"), F.col("n_objects").cast("string"))))
    m = adapters.page_modules(o.select(*PAGE).distinct(), r, PAGE)
    return m.select(*PAGE, "state", F.array_join("warnings", ",").alias("warnings"), F.array_join(F.transform(F.array(*[F.lit(x) for x in adapters.MODULES]), lambda k: F.col("states")[k]), ",").alias("states"), "n_objects")


# ---------------------------------------------------------------- artifacts
_ORDERED = "CASE WHEN doc_id % 2 = 0 AND ordinal % 3 > 0 THEN 9 - ordinal END"
_TEXT = "CASE WHEN ordinal % 4 = 0 THEN '' ELSE type || '  no ' || ordinal || ' .' END"


def _texted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    n = F.col("ordinal")
    text = F.when(n % 4 == 0, "").otherwise(F.concat("type", F.lit("  no "), n.cast("string"), F.lit(" .")))
    return o.withColumns({"ocr_reading_order": F.when((F.col("doc_id") % 2 == 0) & (n % 3 > 0), 9 - n), "text": text, "raw_text": F.when(n % 8 > 0, F.concat(F.lit("raw "), n.cast("string")))})


_PAGE_TEXT = f"""t AS (SELECT doc_id, page, ordinal, type, x1, y1, y2, {_ORDERED} AS ro, CASE WHEN {_TEXT} <> '' THEN type || ' no ' || ordinal || '.' ELSE coalesce(CASE WHEN ordinal % 8 > 0 THEN 'raw ' || ordinal END, '') END AS said FROM o),
pt AS (SELECT doc_id, page, coalesce(string_agg(said, chr(10) || chr(10) ORDER BY (ro IS NULL)::int, coalesce(ro, y1), CASE WHEN ro IS NULL THEN -x1 ELSE y1 END, CASE WHEN ro IS NULL THEN y2 ELSE -x1 END, ordinal) FILTER (type = 'paragraph' AND said <> '') || chr(10), '') AS page_text FROM t GROUP BY ALL)"""


@query(_with(o=OBJECTS).strip() + ", " + _PAGE_TEXT + " SELECT * FROM pt")
def ocr_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.page_texts(_texted(spark, sf_dir), PAGE)


@query(_with(o=OBJECTS).strip() + ", " + _PAGE_TEXT + " SELECT doc_id, coalesce(string_agg(rtrim(page_text, chr(10)), chr(10) || chr(10) ORDER BY page) FILTER (page_text <> '') || chr(10), '') AS text FROM pt GROUP BY doc_id")
def ocr_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.document_texts(publish.page_texts(_texted(spark, sf_dir), PAGE), "doc_id", "page")


_KEY = "CASE WHEN type <> 'paragraph' THEN printf('documents/%s/%s/page-%03d-%s-%03d.png', doc_id::varchar, CASE type " + " ".join(f"WHEN '{t}' THEN '{d}'" for t, _, d in merge.OBJECT_TYPES) + " END, page, type, row_number() OVER (PARTITION BY doc_id, page, type ORDER BY ordinal)) END"
_N = ", ".join(f"'{t}': count(*) FILTER (type = '{t}')" for t, *_ in merge.OBJECT_TYPES)


@query(
    _with(o=OBJECTS).strip()
    + f""", k AS (SELECT *, {_KEY} AS crop_key, row_number() OVER (PARTITION BY doc_id, page ORDER BY y1, x1, y2, x2, type, ordinal) AS ro FROM o),
p AS (SELECT doc_id, page, {{'page_number': page, 'object_counts': {{{_N}}}, 'objects': list({{'reading_order': ro, 'type': type, 'bbox': {{'x1': x1::int, 'y1': y1::int, 'x2': x2::int, 'y2': y2::int}}, 'crop_key': crop_key}} ORDER BY ro)}} AS pg FROM k GROUP BY doc_id, page),
c AS (SELECT doc_id, {{{_N}}} AS n FROM o GROUP BY doc_id)
SELECT doc_id, to_json({{'document_id': doc_id, 'page_count': count(*), 'object_counts': any_value(n), 'pages': list(pg ORDER BY page)}})::varchar AS layout FROM p JOIN c USING (doc_id) GROUP BY doc_id"""
)
def layout_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = merge.reading_order(objects(spark, sf_dir), PAGE)
    n = F.row_number().over(Window.partitionBy(*PAGE, "type").orderBy("ordinal"))
    folder = F.element_at(F.create_map(*[x for t, _, d in merge.OBJECT_TYPES for x in (F.lit(t), F.lit(d))]), F.col("type"))
    key = F.when(F.col("type") != "paragraph", F.format_string("documents/%s/%s/page-%03d-%s-%03d.png", F.col("doc_id").cast("string"), folder, F.col("page").cast("int"), F.col("type"), n))
    o = o.withColumn("crop_key", key).withColumns({c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")})
    return publish.layout_json(o, "doc_id", "page")


@query(
    _with(o=OBJECTS).strip()
    + f""", m AS (SELECT DISTINCT doc_id, page, x.module, x.i FROM o, (VALUES ('ocr', 0), ('figure_table', 1), ('stamp_signature', 2)) x(module, i)), g AS (SELECT * FROM m WHERE doc_id % 4 > 0),
k AS (SELECT *, {_KEY} AS crop_key FROM o WHERE doc_id % 4 > 0),
a AS (SELECT doc_id, page AS p, i AS m, 0 AS s, printf('documents/%s/%s/page-%03d.json.txt', doc_id::varchar, module, page) AS key, 'application/json; charset=utf-8' AS content_type FROM g
  UNION ALL SELECT doc_id, page, 0, 1, printf('documents/%s/ocr/page-%03d-text.txt', doc_id::varchar, page), 'text/plain; charset=utf-8' FROM g WHERE module = 'ocr'
  UNION ALL SELECT doc_id, page, CASE WHEN type IN ('table', 'figure') THEN 1 ELSE 2 END, ordinal + 1, crop_key, 'image/png' FROM k WHERE crop_key IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, 1073741824, 0, 0, 'documents/' || doc_id || '/OCR.txt', 'text/plain; charset=utf-8' FROM g UNION ALL SELECT DISTINCT doc_id, 1073741824, 0, 1, 'documents/' || doc_id || '/layout.json', 'application/json; charset=utf-8' FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, m, s, key)::int AS position, key, content_type FROM a"""
)
def artifact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    modules = o.select(*PAGE).distinct().select(*PAGE, F.explode(F.array(*[F.lit(m) for m in adapters.MODULES])).alias("module"))
    modules = modules.withColumn("state", F.when((F.col("doc_id") % 4 == 0) & (F.col("module") == "ocr"), "failed").otherwise("success"))
    return publish.artifact_keys(o, modules, "doc_id", "page")
