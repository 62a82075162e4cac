"""Queries over the layout operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from ..operators import grouping, merge, spatial
from ..session import table
from ..sources import objects as src
from ..streaming import jobs
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .views import LINES_SQL, OBJECTS, lines, objects

def _where(**named: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in named.items()) + " "


# ---------------------------------------------------------------- text
NORM_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), '[\\t\\x0b\\x0c\\x{{85}}\\p{{Z}}]+', ' ', 'g'), "
    "'(?m)^ +| +$', '', 'g'), ' +([،؛؟!?.,:\\)\\]\\}}»])', '\\1', 'g'), '([\\(\\[\\{{«]) +', '\\1', 'g'), ' ' || chr(10))"
)


@query("SELECT doc_id, " + NORM_SQL.format(t="nfc_normalize(coalesce(text, ''))") + " AS canonical FROM documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.canonical_text(F.col("text"), compose=True).alias("canonical"))


@query(f"SELECT doc_id, translate('٠ي' || text || 'ك٩', '{tx.ARABIC}', '{tx.PERSIAN}') AS persian FROM documents")
def translate_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("٠ي"), "text", F.lit("ك٩"))
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(s, tx.ARABIC, tx.PERSIAN).alias("persian"))


@query(f"SELECT doc_id, array_to_string(list_reverse(regexp_extract_all(text, '{tx.LTR_TOKEN}|(?s:.)')), '') AS logical FROM documents")
def visual_to_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.visual_to_logical(F.col("text")).alias("logical"))


@query(
    rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</?\s*(?:{tx.BREAK_TAGS})\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g'), '[ \t]*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain FROM pages"
)
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("plain"))


@query(rf"SELECT conv_id, turn, regexp_replace(role || ': ' || text, '^\s*(?:{'|'.join(tx.ROLES)})\s*:\s*', '', 'i') AS said FROM conversations")
def strip_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = tx.strip_role(F.concat(F.col("role"), F.lit(": "), F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))


@query(
    """WITH g AS (SELECT doc_id, max(n) AS r FROM (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, hash(substr(text, i, 120)) AS k FROM (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS i FROM documents WHERE length(text) >= 960)) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, coalesce(r, 0) AS repeats, CASE WHEN len(regexp_extract_all(regexp_replace(text, '<[^>]*>', '', 'g'), '\\p{L}')) < 2 THEN 'unusable' WHEN regexp_matches(text, '\\\\[A-Za-z_]+>') THEN 'artifact'
WHEN regexp_matches(text, '(?i)^day\\s+\\[\\[1\\]\\]') OR (length(text) - length(replace(text, chr(8204), '')) >= 40 AND length(text) - length(replace(text, chr(8204), '')) > 2 * (length(text) - length(replace(text, ' ', '')))) THEN 'damaged'
WHEN coalesce(r, 0) >= 8 AND r * 120 >= length(text) * 0.2 THEN 'repetition' ELSE 'ok' END AS verdict FROM documents LEFT JOIN g USING (doc_id)"""
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", tx.passage_repeats(F.col("text")).alias("repeats"))
    return d.select("doc_id", "repeats", tx.quality_verdict(F.col("text"), F.col("repeats")).alias("verdict"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in tx.VISUAL_WORDS) + "]"


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: list_contains({_WORDS}, w)))::int AS score, len(regexp_extract_all(text, '[A-Za-z]+'))::int AS words FROM documents")
def caption_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", tx.visual_score(F.col("text")).alias("score"), words.alias("words"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY regexp_replace(text, '\\s+', '', 'g')")
def text_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    key = F.sha2(tx.text_key(F.col("text")), 256)  # a digest is shuffled, not the text
    return d.groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", "n")


# ---------------------------------------------------------------- geometry
@query(_where(o=OBJECTS) + "SELECT doc_id, ordinal, greatest(0.0, least(600.0, x1 / 0.5)) AS rx1, greatest(0.0, least(800.0, y1 / 0.25)) AS ry1, x2 * 0.5 AS fx2, y2 * 0.25 AS fy2 FROM o")
def restore_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    sx, sy = F.lit(0.5), F.lit(0.25)
    return objects(spark, sf_dir).select(
        "doc_id", "ordinal", geo.restore(F.col("x1"), sx, F.lit(600.0)).alias("rx1"), geo.restore(F.col("y1"), sy, F.lit(800.0)).alias("ry1"), geo.forward(F.col("x2"), sx).alias("fx2"), geo.forward(F.col("y2"), sy).alias("fy2")
    )


@query(
    "SELECT p_partkey, CASE WHEN greatest(w, h) > 2500 THEN greatest(1, round_even(w * 2500 / greatest(w, h)::double, 0)::int) ELSE w END AS rw, CASE WHEN greatest(w, h) > 2500 THEN greatest(1, round_even(h * 2500 / greatest(w, h)::double, 0)::int) ELSE h END AS rh "
    "FROM (SELECT p_partkey, (p_size * 97)::int AS w, (1 + p_partkey % 4001)::int AS h FROM part)"
)
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97).cast("int").alias("w"), (1 + F.col("p_partkey") % 4001).cast("int").alias("h"))
    w, h = geo.bounded_size(F.col("w"), F.col("h"))
    return p.select("p_partkey", w.alias("rw"), h.alias("rh"))


_REGIONS = "SELECT doc_id, page, x1, y1, x2, y2 FROM o WHERE type IN ('table', 'figure')"
_COVER = f"""clip AS (SELECT b.doc_id, b.page, b.ordinal, greatest(b.x1, r.x1) a1, greatest(b.y1, r.y1) b1, least(b.x2, r.x2) a2, least(b.y2, r.y2) b2 FROM boxes b JOIN ({_REGIONS}) r USING (doc_id, page)
  WHERE least(b.x2, r.x2) > greatest(b.x1, r.x1) AND least(b.y2, r.y2) > greatest(b.y1, r.y1)),
edges AS (SELECT DISTINCT doc_id, page, ordinal, a1 AS s FROM clip UNION SELECT doc_id, page, ordinal, a2 FROM clip),
slabs AS (SELECT doc_id, page, ordinal, s AS s1, lead(s) OVER (PARTITION BY doc_id, page, ordinal ORDER BY s) AS s2 FROM edges),
parts AS (SELECT s.doc_id, s.page, s.ordinal, s1, s2, b1, b2, max(b2) OVER (PARTITION BY s.doc_id, s.page, s.ordinal, s1 ORDER BY b1, b2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM slabs s JOIN clip USING (doc_id, page, ordinal) WHERE s2 IS NOT NULL AND a1 <= s1 AND a2 >= s2),
area AS (SELECT doc_id, page, ordinal, sum((s2 - s1) * greatest(0.0, b2 - greatest(b1, coalesce(m, b1)))) AS covered FROM parts GROUP BY ALL),
cov AS (SELECT b.doc_id, b.page, b.ordinal, round(coalesce(covered, 0.0) / ((x2 - x1) * (y2 - y1)), 6) AS coverage FROM boxes b LEFT JOIN area USING (doc_id, page, ordinal)) """
_BOXES = "SELECT * FROM o WHERE type = 'paragraph'"


def _boxes_regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = objects(spark, sf_dir)
    return o.where("type = 'paragraph'"), o.where("type IN ('table', 'figure')").select("doc_id", "page", "x1", "y1", "x2", "y2")


@query(_where(o=OBJECTS, boxes=_BOXES)[:-1] + ", " + _COVER + "SELECT * FROM cov")
def union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spatial.coverage_on_pages(objects(spark, sf_dir), ["doc_id", "page"], F.col("type") == "paragraph", F.col("type").isin("table", "figure"))
    return o.select("doc_id", "page", "ordinal", F.round("coverage", 6).alias("coverage"))


@query(_where(o=OBJECTS, boxes=_BOXES)[:-1] + ", " + _COVER + "SELECT doc_id, page, ordinal FROM cov WHERE coverage < 0.65")
def uncovered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, regions = _boxes_regions(spark, sf_dir)
    return spatial.uncovered(boxes, regions, ["doc_id", "page"], "ordinal").select("doc_id", "page", "ordinal")


_OV = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query(_where(o=OBJECTS) + f"SELECT a.doc_id, a.page, a.ordinal, b.ordinal AS box_id FROM o a JOIN o b USING (doc_id, page) WHERE a.type IN ('stamp', 'signature') AND b.type = 'table' AND a.confidence >= 0.75 AND {_OV} >= (a.x2 - a.x1) * (a.y2 - a.y1) * 0.8")
def verifier_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    boxes = o.where("type = 'table'").withColumnRenamed("ordinal", "box_id")
    return spatial.inside(o.where("type IN ('stamp', 'signature')"), boxes, ["doc_id", "page"]).select("doc_id", "page", "ordinal", "box_id")


@query(_where(o=OBJECTS) + "SELECT doc_id, page, ordinal, arg_min(anchor, d * 1000 + anchor) AS anchor FROM (SELECT a.doc_id, a.page, a.ordinal, b.ordinal AS anchor, abs(a.x1 - b.x1) + abs(a.y1 - b.y1) AS d FROM (SELECT * FROM o WHERE type <> 'paragraph') a LEFT JOIN (SELECT * FROM o WHERE type = 'paragraph') b USING (doc_id, page)) GROUP BY ALL")
def nearest_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    return spatial.nearest(o.where("type <> 'paragraph'"), o.where("type = 'paragraph'"), ["doc_id", "page"], "ordinal")


@query(
    _where(o=OBJECTS)
    + f"SELECT doc_id, page, bool_and(ok) AS rescued FROM (SELECT a.doc_id, a.page, a.ordinal, coalesce(bool_or({_OV} / ((a.x2 - a.x1) * (a.y2 - a.y1)) >= 0.75), false) AS ok FROM (SELECT * FROM o WHERE type = 'paragraph') a LEFT JOIN (SELECT * FROM o WHERE type = 'figure' AND confidence >= 0.8) b USING (doc_id, page) GROUP BY ALL) GROUP BY ALL"
)
def figure_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = objects(spark, sf_dir)
    return spatial.rescued(o.where("type = 'paragraph'"), o.where("type = 'figure'"), ["doc_id", "page"])


@query(_where(o=OBJECTS) + "SELECT doc_id, ordinal, least(greatest(floor(x1), 0), 999)::bigint AS cx1, least(greatest(floor(y1), 0), 999)::bigint AS cy1, greatest(least(ceil(x2), 1000), least(greatest(floor(x1), 0), 999) + 1)::bigint AS cx2, greatest(least(ceil(y2), 1000), least(greatest(floor(y1), 0), 999) + 1)::bigint AS cy2 FROM o")
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geo.crop_window(*[F.col(x) for x in ("x1", "y1", "x2", "y2")], F.lit(1000), F.lit(1000))
    return objects(spark, sf_dir).select("doc_id", "ordinal", *[v.cast("long").alias(n) for v, n in zip(c, ("cx1", "cy1", "cx2", "cy2"), strict=True)])


# ---------------------------------------------------------------- projections, counts, states
_LABELS = "list_value('table', 'table_caption', 'image', 'figure_title', 'chart', 'text', 'figure', 'seal', 'Table_body')"


@query(
    f"SELECT p_partkey, label, CASE WHEN n = 'table' OR (n LIKE 'table%' AND NOT contains(n, 'caption')) THEN 'table' WHEN n IN ('figure', 'image', 'chart') THEN 'figure' WHEN regexp_matches(n, 'figure|image|chart') AND NOT regexp_matches(n, 'caption|title') THEN 'figure' END AS type FROM (SELECT p_partkey, label, lower(trim(label)) AS n FROM (SELECT p_partkey, {_LABELS}[(p_partkey % 9)::int + 1] AS label FROM part))"
)
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("table", "table_caption", "image", "figure_title", "chart", "text", "figure", "seal", "Table_body")])
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 9 + 1).cast("int")).alias("label"))
    return p.withColumn("type", merge.map_label(F.col("label")))


_COUNTS = ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t, *_ in merge.OBJECT_TYPES)


@query(_where(o=OBJECTS) + f"SELECT doc_id, {_COUNTS}, count(*) AS n_objects FROM o GROUP BY doc_id")
def object_counts_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.type_counts(objects(spark, sf_dir), ["doc_id"])


@query(_where(o=OBJECTS) + f"SELECT doc_id, page, grouping_id(doc_id, page) AS level, {_COUNTS} FROM o GROUP BY ROLLUP (doc_id, page) HAVING grouping_id(doc_id, page) < 3")
def counts_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.counts_rollup(objects(spark, sf_dir), "doc_id", "page")


_STATE = "CASE WHEN {n} > 0 AND {ok} = {n} THEN 'success' WHEN {n} > 0 AND {ok} = 0 THEN 'failed' ELSE 'partial' END"


@query(f"SELECT doc, page, {_STATE.format(ok='ok', n='n')} AS state FROM (SELECT o_custkey AS doc, o_orderkey % 3 AS page, count(*) FILTER (o_orderstatus = 'O') AS ok, count(*) AS n FROM orders GROUP BY ALL)")
def page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 3).alias("page"))
    return o.agg(merge.roll_state(F.count_if(F.col("o_orderstatus") == "O"), F.count(F.lit(1))).alias("state"))


@query(f"SELECT c_custkey AS doc, {_STATE.format(ok='ok', n='n')} AS state FROM (SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'O') AS ok, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)")
def doc_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("ok"), F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("doc"), merge.roll_state(F.coalesce("ok", F.lit(0)), F.coalesce("n", F.lit(0))).alias("state"))


@query(_where(o=OBJECTS) + "SELECT doc_id, page, round(greatest(0.0, least(1.0, sum(confidence * greatest(1.0, (x2 - x1) * (y2 - y1))) / sum(greatest(1.0, (x2 - x1) * (y2 - y1))))), 6) AS confidence FROM o GROUP BY doc_id, page")
def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).groupBy("doc_id", "page").agg(F.round(merge.weighted_confidence(), 6).alias("confidence"))


@query(_where(o=OBJECTS) + "SELECT doc_id, page, median(greatest(1.0, y2 - y1)) AS height FROM o GROUP BY doc_id, page")
def median_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir).groupBy("doc_id", "page").agg(F.median(F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))).alias("height"))


@query(_where(o=OBJECTS) + "SELECT doc_id, page, ordinal, row_number() OVER (PARTITION BY doc_id, page ORDER BY y1, x1, y2, x2, type, ordinal) AS reading_order FROM o")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.reading_order(objects(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "page", "ordinal", F.col("reading_order").cast("long").alias("reading_order"))


_FOLDER = "CASE type " + " ".join(f"WHEN '{t}' THEN '{d}'" for t, _, d in merge.OBJECT_TYPES) + " END"


@query(_where(o=OBJECTS) + f"SELECT doc_id, ordinal, printf('documents/%s/%s/page-%03d-%s-%03d.png', doc_id::varchar, {_FOLDER}, page, type, row_number() OVER (PARTITION BY doc_id, page, type ORDER BY ordinal)) AS crop_key FROM o WHERE type <> 'paragraph'")
def crop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.crop_names(objects(spark, sf_dir), "doc_id", "page").select("doc_id", "ordinal", "crop_key")


@query(_where(o=OBJECTS) + "SELECT doc_id, count(*) AS page_count, sum(n)::bigint AS object_count, string_agg(page || ':' || s, ';' ORDER BY page) AS layout FROM (SELECT doc_id, page, count(*) AS n, string_agg(type, ',' ORDER BY y1, x1, y2, x2, type, ordinal) AS s FROM o GROUP BY doc_id, page) GROUP BY doc_id")
def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda p: F.concat_ws(":", p["page_number"].cast("string"), F.array_join(F.transform(p["objects"], lambda o: o["type"]), ","))
    d = merge.layout_documents(objects(spark, sf_dir), "doc_id", "page")
    return d.select("doc_id", "page_count", "object_count", F.array_join(F.transform("pages", page), ";").alias("layout"))


# ---------------------------------------------------------------- lines
@query(_where(l=LINES_SQL) + "SELECT doc_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY line_no) || chr(10) AS joined FROM l WHERE trim(text) <> '' GROUP BY doc_id")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(spark, sf_dir).withColumn("text", F.trim("text")).where("text <> ''")  # noqa: E741
    return merge.joined_text(l, ["doc_id"], "line_no", "text", "\n\n").select("doc_id", F.concat("joined", F.lit("\n")).alias("joined"))


@query("SELECT source, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.text_digests(table(spark, sf_dir, "documents"), "source", "doc_id", "text", "\n\n")


_MARK = "SELECT doc_id, line_no, CASE WHEN s <> '' THEN s ELSE w END AS letter, s <> '' AS strong FROM (SELECT doc_id, line_no, regexp_extract(t, '^\\s*([A-Z])\\s*[-–—.:)]\\s*\\S', 1) AS s, regexp_extract(t, '^\\s*([A-Z])\\s+\\S', 1) AS w FROM (SELECT doc_id, line_no, CASE WHEN doc_id % 3 = 0 THEN chr((65 + line_no % 26)::int) || '. ' || text ELSE text END AS t FROM l)) WHERE s <> '' OR w <> ''"


@query(
    _where(l=LINES_SQL, m=_MARK)[:-1]
    + ", b AS (SELECT *, coalesce((line_no - lag(line_no) OVER w > 2 OR ascii(letter) - lag(ascii(letter)) OVER w <> 1)::int, 1) AS brk FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM b) "
    "SELECT doc_id, line_no, letter, run::bigint AS run, (count(*) OVER q >= 3 OR (count(*) OVER q >= 2 AND bool_or(strong) OVER q) OR strong) AS accepted FROM r WINDOW q AS (PARTITION BY doc_id, run)"
)
def marker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = lines(spark, sf_dir)  # noqa: E741
    lettered = F.when(F.col("doc_id") % 3 == 0, F.concat(F.chr(65 + F.col("line_no") % 26), F.lit(". "), F.col("text"))).otherwise(F.col("text"))
    m = l.select("doc_id", "line_no", tx.english_marker(lettered).alias("m")).where("m IS NOT NULL").select("doc_id", "line_no", "m.letter", "m.strong")
    return grouping.marker_runs(m).select("doc_id", "line_no", "letter", "run", "accepted")


_BOXED = "SELECT doc_id, line_no, (100 + (n % 7) * 60)::double AS x1, (260 + (n % 7) * 60)::double AS x2, y::double AS y1, (y + 30)::double AS y2, n % 11 = 0 AS hard FROM (SELECT *, sum(30 + CASE WHEN n % 5 = 0 THEN 80 ELSE 10 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS y FROM l)"
_FOLD = """list_reduce(ls, lambda a, x: CASE WHEN len(a.o) = 0 OR x.h OR x.y1 - a.y2 > 54 OR x.y1 - a.y2 < -30 OR greatest(0.0, least(x.x2, a.x2) - greatest(x.x1, a.x1)) / greatest(1.0, least(x.x2 - x.x1, a.x2 - a.x1)) < 0.15
  THEN {'h': x.h, 'x1': x.x1, 'x2': x.x2, 'y1': x.y1, 'y2': x.y2, 'g': a.g + 1, 'o': list_append(a.o, a.g + 1)} ELSE {'h': x.h, 'x1': least(a.x1, x.x1), 'x2': greatest(a.x2, x.x2), 'y1': x.y1, 'y2': x.y2, 'g': a.g, 'o': list_append(a.o, a.g)} END,
  {'h': false, 'x1': 0.0::double, 'x2': 0.0::double, 'y1': 0.0::double, 'y2': 0.0::double, 'g': 0, 'o': []::int[]})"""


@query(
    _where(l=LINES_SQL, bx=_BOXED)[:-1]
    + ", c AS (SELECT doc_id, list({'h': hard, 'x1': x1, 'x2': x2, 'y1': y1, 'y2': y2, 'g': 0, 'o': []::int[]} ORDER BY line_no) AS ls FROM bx GROUP BY doc_id), f AS (SELECT doc_id, "
    + _FOLD
    + " AS r FROM c) SELECT doc_id, r.g AS n_paragraphs, array_to_string(r.o, ',') AS groups FROM f"
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.sum(30 + F.when(F.col("n") % 5 == 0, 80).otherwise(10)).over(Window.partitionBy("doc_id").orderBy("line_no"))
    l = lines(spark, sf_dir).withColumn("y", y.cast("double"))  # noqa: E741
    x1 = (100 + (F.col("n") % 7) * 60).cast("double")
    box = F.struct("line_no", (F.col("n") % 11 == 0).alias("hard"), x1.alias("x1"), (x1 + 160).alias("x2"), F.col("y").alias("y1"), (F.col("y") + 30).alias("y2"))
    g = l.groupBy("doc_id").agg(F.array_sort(F.collect_list(box)).alias("ls"))
    ids = g.select("doc_id", grouping.paragraph_ids(F.col("ls"), F.lit(30.0)).alias("g"))
    return ids.select("doc_id", F.array_max("g").alias("n_paragraphs"), F.array_join(F.col("g").cast("array<string>"), ",").alias("groups"))


_ROWFOLD = """list_reduce(ls, lambda a, x: CASE WHEN a.n = 0 OR abs(x.cy - a.cy / greatest(a.n, 1)) > 0.55 * greatest(x.h, a.h / greatest(a.n, 1)) THEN {'cy': x.cy, 'h': x.h, 'n': 1, 'g': a.g + 1, 'o': list_append(a.o, a.g + 1)}
  ELSE {'cy': a.cy + x.cy, 'h': a.h + x.h, 'n': a.n + 1, 'g': a.g, 'o': list_append(a.o, a.g)} END, {'cy': 0.0::double, 'h': 0.0::double, 'n': 0, 'g': 0, 'o': []::int[]})"""


@query(
    _where(o=OBJECTS)[:-1]
    + ", c AS (SELECT doc_id, page, list({'cy': (y1 + y2) / 2, 'h': y2 - y1, 'n': 0, 'g': 0, 'o': []::int[]} ORDER BY (y1 + y2) / 2, -(x1 + x2) / 2, ordinal) AS ls FROM o GROUP BY ALL) SELECT doc_id, page, array_to_string("
    + _ROWFOLD
    + ".o, ',') AS rows FROM c"
)
def row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.struct(((F.col("y1") + F.col("y2")) / 2).alias("cy"), (-(F.col("x1") + F.col("x2")) / 2).alias("cx"), "ordinal", (F.col("y2") - F.col("y1")).alias("h"))
    g = objects(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(b)).alias("bs"))
    return g.select("doc_id", "page", F.array_join(grouping.row_ids(F.col("bs")).cast("array<string>"), ",").alias("rows"))


# ---------------------------------------------------------------- sources, sets, jobs
_HOST = "site1.example.org"


@query(
    f"""SELECT page_id, CASE WHEN s NOT IN ('http', 'https') THEN 'scheme' WHEN contains(a, '@') THEN 'credentials' WHEN contains(url, '#') THEN 'fragment'
WHEN lower(regexp_extract(a, '^(?:[^@]*@)?([^:]*)', 1)) <> '{_HOST}' OR coalesce(try_cast(nullif(regexp_extract(a, ':([0-9]+)$', 1), '') AS int), CASE WHEN s = 'https' THEN 443 ELSE 80 END) <> 443 THEN 'authority'
WHEN len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) > 0 THEN 'path' ELSE 'ok' END AS verdict
FROM (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS a, regexp_extract(url, '^[A-Za-z]+://[^/?#]*/+([^?#]*)', 1) AS p FROM pages)"""
)
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", src.url_verdict(F.col("url"), _HOST).alias("verdict"))


@query("SELECT o_custkey AS doc, o_orderkey % 7 AS page_number, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 7).alias("page_number"))
    return o.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT 'missing' AS side, n AS key FROM (SELECT l_partkey AS n FROM lineitem EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'unknown', n FROM (SELECT o_custkey AS n FROM orders EXCEPT SELECT l_partkey FROM lineitem)")
def env_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return a.subtract(b).select(F.lit("missing").alias("side"), "key").unionByName(b.subtract(a).select(F.lit("unknown").alias("side"), "key"))


_MOCK = ", ".join(f"('{t}', {a}, {b}, {c}, {d}, {e})" for t, a, b, c, d, e in src.MOCK_BOXES)


@query(f"SELECT page_id, type, round(x1 * width, 3) AS x1, round(y1 * height, 3) AS y1, round(x2 * width, 3) AS x2, round(y2 * height, 3) AS y2, confidence::double AS confidence FROM (SELECT page_id, 600 + page_id % 400 AS width, 1000.0 AS height FROM pages), (VALUES {_MOCK}) AS t(type, x1, y1, x2, y2, confidence)".replace("x1 * width", "x1::double * width").replace("x2 * width", "x2::double * width").replace("y1 * height", "y1::double * height").replace("y2 * height", "y2::double * height"))
def mock_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", (600 + F.col("page_id") % 400).alias("width"), F.lit(1000.0).alias("height"))
    return src.mock_detections(p).select("page_id", "type", "x1", "y1", "x2", "y2", "confidence")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS double) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", src.json_number(F.col("props"), "$.k").alias("k"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("r", r).where("r <= 5").select("user_id", "event_id")


@query("SELECT user_id AS job_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS status, count(*) AS n_events, arg_max(event_type, {'t': ts, 'e': event_id}) IN ('completed', 'failed') AS terminal FROM events GROUP BY user_id")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", "event_id")
    return jobs.latest_state(e, order=("ts", "event_id"))


@query("SELECT o_custkey AS doc, coalesce(string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'), 'partial') AS message FROM orders GROUP BY o_custkey")
def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.when(F.col("o_orderstatus") == "F", F.struct("o_orderkey", "o_orderpriority"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(failed)).alias("f"))
    return o.select("doc", F.when(F.size("f") > 0, F.array_join(F.transform("f", lambda x: x["o_orderpriority"]), "; ")).otherwise(F.lit("partial")).alias("message"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")
