"""Queries over model text: artifacts, plain answers, grounded spans, list markers and paragraphs with texts and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model_text as mt
from ..functions import text as tx
from ..operators import paragraphs as par
from ..session import table
from .registry import query, quoted
from .views import LINES_SQL, lines

# ---------------------------------------------------------------- answers of a model, made of documents
#: (remainder of doc_id, what stands before and after the text)
WRAPS = (
    (1, "<|im_start|>assistant\n", "\n<|im_end|>"),
    (2, "data:image/png;base64,QUJD+/= \nuser: ", "\n0</|im_start|>|user|l3</|ref|>"),
    (3, "<p>The image shows a field.</p><p>There are clouds in the sky</p><div>", "</div>\n\\modifier{x}\n[caption]\n\\12\nNone None"),
    (4, "<table><tr><td>a</td></tr></table>\n\nimage [[1, 2, 3, 4]]\nfunction=\"get_pdf_text\"/>\n", "\n\nThis is a photograph of\n\nIt is red"),
    (5, "\\ |im_end|>text\r\n</assistant>\n", "\x0b｜user｜>x"),
    (6, "there are two\n\nyou can see it\n\n\\** ", "\n\nرنگ the image"),
)


def answer_column() -> F.Column:
    c, key = F.col("text"), F.col("doc_id") % 7
    return F.coalesce(*[F.when(key == k, F.concat(F.lit(a), c, F.lit(b))) for k, a, b in WRAPS], c)


ANSWER_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {quoted(a)} || text || {quoted(b)}" for k, a, b in WRAPS) + " ELSE text END"


def _drop(value: str, *patterns: str, by: str = "''") -> str:
    for p in patterns:
        value = f"regexp_replace({value}, {quoted(p)}, {by}, 'g')"
    return value


_EDGE = r"^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$"
_STRIPPED = _drop("l", *mt.FAMILIES, mt.BROKEN_TOKEN, mt.MODIFIER, mt.ROLE_PREFIX, _EDGE)
_COUNT = " + ".join(f"len(regexp_extract_all(l, {quoted(p)}))" for p in mt.FAMILIES)
_VOCABULARY = "[" + ", ".join(map(quoted, tx.VISUAL_WORDS)) + "]"
_SCORE = f"len(list_filter(regexp_extract_all(lower(b), '[a-z]+'), lambda w: list_contains({_VOCABULARY}, w)))"
_PREPARED = _drop(_drop(f"replace(regexp_replace(coalesce({ANSWER_SQL}, ''), '\\r\\n?', chr(10), 'g'), '｜', '|')", mt.DATA_URI, by="chr(10)"), mt.BLOCK_TAG, by="chr(10)")
_MODEL_SQL = f"""
WITH a AS (SELECT doc_id, {_drop(_PREPARED, mt.SPAN_TAG)} AS t FROM documents),
ls AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS x FROM a)),
st AS (SELECT doc_id, i, l, {_STRIPPED} AS s, {_COUNT} AS n FROM (SELECT doc_id, i, {_drop("raw", _EDGE)} AS l FROM ls)),
cl AS (SELECT doc_id, i, l, {_drop(f"CASE WHEN regexp_matches(s, {quoted(mt.ROLE_ALONE)}) OR regexp_matches(s, {quoted(mt.DEBRIS)}) OR (n >= 2 AND NOT regexp_matches(s, '[؀-ۿ]') AND length({_drop('s', '[^\\p{L}\\p{N}_]')}) <= 8) THEN '' ELSE s END", mt.ESCAPED_MARK, _EDGE)} AS c FROM st),
jo AS (SELECT doc_id, string_agg(CASE WHEN regexp_matches(l, {quoted(mt.DROPPED_LINE)}) OR regexp_matches(c, {quoted(mt.EMPTY_LINE)}) THEN '' ELSE c END, chr(10) ORDER BY i) AS j FROM cl GROUP BY doc_id),
bl AS (SELECT doc_id, {_drop("unnest(x)", _EDGE)} AS b, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(j, '\\n\\s*\\n+') AS x FROM jo)),
co AS (SELECT *, b <> '' AND regexp_matches(b, '[A-Za-z]') AND NOT regexp_matches(b, '[؀-ۿ]') AS latin, regexp_matches(b, {quoted(mt.CAPTION)}) OR (len(regexp_extract_all(b, '[A-Za-z]+')) >= 8 AND {_SCORE} >= 4) OR (regexp_matches(b, {quoted(mt.CAPTION_FIELD)}) AND {_SCORE} >= 3) AS own, regexp_matches(b, {quoted(mt.CAPTION_MORE)}) AS more FROM bl),
la AS (SELECT *, max(CASE WHEN latin AND own THEN i END) OVER w AS hit, max(CASE WHEN NOT (latin AND (own OR more)) THEN i END) OVER w AS other FROM co WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ke AS (SELECT doc_id, string_agg(b, chr(10) || chr(10) ORDER BY i) AS k FROM la WHERE b <> '' AND NOT (latin AND (own OR more) AND hit IS NOT NULL AND hit > coalesce(other, 0)) GROUP BY doc_id)
SELECT a.doc_id, {_drop("regexp_replace(coalesce(k, ''), '\\n{3,}', chr(10) || chr(10), 'g')", _EDGE)} AS stripped FROM a LEFT JOIN ke USING (doc_id)"""


@query(_MODEL_SQL)
def clean_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mt.strip_artifacts(answer_column()).alias("stripped"))


@query(f"SELECT doc_id, line_no, {_COUNT} AS n_tokens FROM (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN '<|user|> ' || text || '</|ref|>' WHEN 1 THEN '| eos | ' || text || '<assistant>' ELSE text END AS l FROM ({LINES_SQL}))")
def control_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("line_no") % 3, F.col("text")
    marked = F.when(k == 0, F.concat(F.lit("<|user|> "), t, F.lit("</|ref|>"))).when(k == 1, F.concat(F.lit("| eos | "), t, F.lit("<assistant>"))).otherwise(t)
    return lines(spark, sf_dir).select("doc_id", "line_no", mt.token_count(marked).alias("n_tokens"))


#: Plain answers: (remainder of turn, before, after)
MARKUP = ((0, "*<|im_end|> # ", "\n```\nx\n```"), (1, "</im_start><br/>\n* one\n+ two\n\n\n\n**", "**\n__\n***"), (2, "\\<|im_start|> <|x|>", "<br>tail\n## head\n\\*_"))
_PLAIN = "CASE turn % 4 " + " ".join(f"WHEN {k} THEN {quoted(a)} || text || {quoted(b)}" for k, a, b in MARKUP) + " ELSE text END"


def _plain_sql() -> str:
    c = _drop(f"regexp_replace(coalesce({_PLAIN}, ''), '\\r\\n?', chr(10), 'g')", _EDGE)
    for p in (mt.BROKEN_HEADER.replace(r"\u0600-\u06ff", "؀-ۿ"), mt.LEADING):
        c = f"regexp_replace({c}, {quoted(p)}, '')"
    for p, by in mt.PLAIN_RULES:
        c = f"regexp_replace({c}, {quoted(p)}, {'chr(10)' if by == chr(10) else 'chr(10) || chr(10)' if by == chr(10) * 2 else quoted(by.replace('$1', chr(92) + '1'))}, 'g')"
    return f"SELECT conv_id, turn, {_drop(c, _EDGE)} AS plain FROM conversations"


@query(_plain_sql())
def plain_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("turn") % 4, F.col("text")
    content = F.coalesce(*[F.when(k == r, F.concat(F.lit(a), t, F.lit(b))) for r, a, b in MARKUP], t)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", mt.plain_response(content).alias("plain"))


_BOX = "[[' || (p_partkey * 37 % 600) || ', ' || (p_partkey * 11 % 500) || ', ' || (p_partkey * 37 % 600 + 100) || ', ' || (p_partkey * 11 % 500 + p_size) || '], [5, 900, 1500, 1200.5]]"
_GROUND = f"'x<|ref|> ' || p_name || ' <|/ref|>\n<|det|>{_BOX}<|/det|> <|ref|>  <|/ref|><|det|>[1,2,3,4]<|/det|><|ref|>' || p_type || '<|/ref|><|det|>' || CASE p_partkey % 3 WHEN 0 THEN '(10, 20, 30, 40)' WHEN 1 THEN '[9, 9, 9, 9]' ELSE '[1, 2, 3]' END || '<|/det|>'"


@query(
    f"""WITH g AS (SELECT p_partkey, p_name, p_type, {_GROUND} AS content, [[(p_partkey * 37 % 600), p_partkey * 11 % 500, p_partkey * 37 % 600 + 100, p_partkey * 11 % 500 + p_size], [5, 900, 999, 999]] AS b FROM part),
s AS (SELECT p_partkey, 0 AS i, trim(p_name) AS text, list_min(list_transform(b, lambda x: x[1])) / 999.0 * 1200 AS x1, list_min(list_transform(b, lambda x: x[2])) / 999.0 * 1600 AS y1, list_max(list_transform(b, lambda x: x[3])) / 999.0 * 1200 AS x2, list_max(list_transform(b, lambda x: x[4])) / 999.0 * 1600 AS y2 FROM g
  UNION ALL SELECT p_partkey, 2, trim(p_type), CASE WHEN p_partkey % 3 = 0 THEN 10 / 999.0 * 1200 END, CASE WHEN p_partkey % 3 = 0 THEN 20 / 999.0 * 1600 END, CASE WHEN p_partkey % 3 = 0 THEN 30 / 999.0 * 1200 END, CASE WHEN p_partkey % 3 = 0 THEN 40 / 999.0 * 1600 END FROM g)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY y1 NULLS FIRST, -x1 NULLS FIRST, i) - 1)::int AS reading_order, text, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM s"""
)
def grounded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: c.cast("string")
    k, up = F.col("p_partkey"), F.col("p_partkey") * 37 % 600
    down = k * 11 % 500
    box = F.concat(F.lit("[["), n(up), F.lit(", "), n(down), F.lit(", "), n(up + 100), F.lit(", "), n(down + F.col("p_size")), F.lit("], [5, 900, 1500, 1200.5]]"))
    odd = F.when(k % 3 == 0, "(10, 20, 30, 40)").when(k % 3 == 1, "[9, 9, 9, 9]").otherwise("[1, 2, 3]")
    content = F.concat(F.lit("x<|ref|> "), "p_name", F.lit(" <|/ref|>\n<|det|>"), box, F.lit("<|/det|> <|ref|>  <|/ref|><|det|>[1,2,3,4]<|/det|><|ref|>"), "p_type", F.lit("<|/ref|><|det|>"), odd, F.lit("<|/det|>"))
    s = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(mt.grounded_spans(content, F.lit(1200), F.lit(1600))).alias("reading_order", "s"))
    return s.select("p_partkey", "reading_order", "s.text", *[F.round(f"s.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


# ---------------------------------------------------------------- list markers and paragraphs
_FA = "[" + ", ".join(map(quoted, par.ALPHABET)) + "]"
_LEGAL = "[" + ", ".join(map(quoted, par.LEGAL)) + "]"
#: Lines whose beginnings are list markers of all kinds.
_LISTED = f"""SELECT doc_id, line_no, n, CASE doc_id % 4 WHEN 0 THEN {_LEGAL}[(line_no % 28)::int + 1] || '- ' || text WHEN 1 THEN {_FA}[(line_no % 32)::int + 1] || text WHEN 2 THEN chr((65 + line_no % 26)::int) || ') ' || text ELSE text END AS text FROM ({LINES_SQL})"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("line_no") % k + 1).cast("int"))
    t, d = F.col("text"), F.col("doc_id") % 4
    marked = F.when(d == 0, F.concat(pick(par.LEGAL, 28), F.lit("- "), t)).when(d == 1, F.concat(pick(par.ALPHABET, 32), t)).when(d == 2, F.concat(F.chr(65 + F.col("line_no") % 26), F.lit(") "), t)).otherwise(t)
    return lines(spark, sf_dir).select("doc_id", "line_no", "n", marked.alias("text"))


_ALIAS = "|".join(par.ALIASES)
_CANONICAL = "CASE a " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in par.CANONICAL.items()) + " ELSE a END"
_MARKS = f"""v AS (SELECT *, {_drop("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$")} AS t FROM q),
k AS (SELECT *, regexp_extract(t, '^(?:{_ALIAS})') AS a, regexp_extract(t, '^([A-Za-z])(?:\\s*[-–—.:)])', 1) AS es, regexp_extract(t, '^([A-Za-z])\\s', 1) AS ew FROM v),
m AS (SELECT *, CASE WHEN a <> '' AND length(t) > length(a) THEN 'fa' WHEN es <> '' OR ew <> '' THEN 'en' END AS kind,
  CASE WHEN a <> '' AND length(t) > length(a) THEN {_CANONICAL} WHEN es <> '' THEN upper(es) WHEN ew <> '' THEN upper(ew) END AS marker,
  CASE WHEN a <> '' AND length(t) > length(a) THEN CASE WHEN regexp_matches(t, '^(?:{_ALIAS})\\s*{par.SEPARATOR}') THEN 'strong' WHEN regexp_matches(t, '^(?:{_ALIAS})\\s') THEN 'weak' ELSE 'glued' END WHEN es <> '' THEN 'strong' WHEN ew <> '' THEN 'weak' END AS strength FROM k),
c AS (SELECT *, list_position({_FA}, marker) AS p1, list_position({_LEGAL}, marker) AS p2, ascii(marker) AS p3 FROM m WHERE kind IS NOT NULL),
b AS (SELECT *, coalesce((line_no - lag(line_no) OVER w > 2 OR kind <> lag(kind) OVER w OR NOT coalesce(CASE WHEN kind = 'en' THEN p3 = lag(p3) OVER w + 1 ELSE p1 = lag(p1) OVER w + 1 OR p2 = lag(p2) OVER w + 1 END, false))::int, 1) AS brk FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM b),
acc AS (SELECT doc_id, line_no, kind, marker, strength, (strength = 'strong' OR count(*) OVER q >= 3 OR (count(*) OVER q >= 2 AND bool_or(strength = 'strong') OVER q)) AS accepted FROM r WINDOW q AS (PARTITION BY doc_id, run))"""


@query(f"WITH q AS ({_LISTED}), {_MARKS} SELECT doc_id, line_no, kind, marker, strength, accepted FROM acc")
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return par.marked_lines(_listed(spark, sf_dir), "doc_id", "line_no", "text").select("doc_id", "line_no", "kind", "marker", "strength", "accepted")


_STARTS = r"(?i)^(?:ماده|تبصره|فصل|بخش|بند|chapter|section|article|clause)(?:$|[-–—ـ.:؛،()0-9۰-۹٠-٩\s])|^\s*[\(\[]?[0-9۰-۹٠-٩]+(?:[\)\]]|[-–—ـ.:])\s*|^\s*(?:[•●▪◦◾■□*]|[-–—])\s+"
_PLACED = f"""q AS (SELECT *, (100 + n % 7 * 60)::double AS x1, (260 + n % 7 * 60)::double AS x2, y::double AS y1, (y + 24 + n % 9)::double AS y2, (n % 100) / 100.0 AS confidence FROM (SELECT *, sum(30 + CASE WHEN n % 5 = 0 THEN 80 ELSE 10 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS y FROM ({_LISTED})))"""
_FOLD = """list_reduce(ls, lambda a, x: CASE WHEN len(a.o) = 0 OR x.h OR x.y1 - a.y2 > a.m * 1.8 OR x.y1 - a.y2 < -a.m OR greatest(0.0, least(x.x2, a.x2) - greatest(x.x1, a.x1)) / greatest(1.0, least(x.x2 - x.x1, a.x2 - a.x1)) < 0.15
  THEN {'h': x.h, 'x1': x.x1, 'x2': x.x2, 'y1': x.y1, 'y2': x.y2, 'm': a.m, 'g': a.g + 1, 'o': list_append(a.o, a.g + 1)} ELSE {'h': x.h, 'x1': least(a.x1, x.x1), 'x2': greatest(a.x2, x.x2), 'y1': x.y1, 'y2': x.y2, 'm': a.m, 'g': a.g, 'o': list_append(a.o, a.g)} END,
  {'h': false, 'x1': 0.0::double, 'x2': 0.0::double, 'y1': 0.0::double, 'y2': 0.0::double, 'm': med, 'g': 0, 'o': []::int[]})"""
_BODY = rf"""CASE WHEN accepted THEN trim(marker || CASE WHEN body = '' THEN '' ELSE ' - ' || body END) ELSE t END"""


@query(
    f"""WITH {_PLACED}, {_MARKS},
h AS (SELECT v.*, coalesce(accepted, false) AS accepted, marker, coalesce(accepted, false) OR regexp_matches(t, {quoted(_STARTS)}) AS hard,
  regexp_replace(CASE WHEN kind = 'fa' THEN regexp_replace(t, '^(?:{_ALIAS})(?:\\s*{par.SEPARATOR}(?:{par.SEPARATOR}| )*|\\s*)', '') ELSE regexp_replace(t, '^[A-Za-z](?:\\s*[-–—.:)])?\\s*', '') END, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS body FROM v LEFT JOIN acc USING (doc_id, line_no)),
f AS (SELECT doc_id, ls, {_FOLD}.o AS o FROM (SELECT doc_id, median(greatest(1.0, y2 - y1)) AS med, list({{'h': hard, 'x1': x1, 'x2': x2, 'y1': y1, 'y2': y2, 'm': 0.0::double, 'g': 0, 'o': []::int[]}} ORDER BY line_no) AS ls FROM h GROUP BY doc_id)),
g AS (SELECT doc_id, unnest(o) AS paragraph, row_number() OVER (PARTITION BY doc_id) AS rn, generate_subscripts(o, 1) - 1 AS line_no FROM f)
SELECT doc_id, paragraph::bigint AS paragraph, count(*) AS line_count, md5(coalesce(string_agg({_BODY}, chr(10) ORDER BY line_no) FILTER ({_BODY} <> ''), '')) AS text_md5, md5(string_agg(text, chr(10) ORDER BY line_no)) AS raw_md5,
  min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(greatest(0.0, least(1.0, sum(confidence * greatest(1.0, (x2 - x1) * (y2 - y1))) / sum(greatest(1.0, (x2 - x1) * (y2 - y1))))), 6) AS confidence FROM h JOIN g USING (doc_id, line_no) GROUP BY doc_id, paragraph"""
)
def paragraph_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.col("n")
    y = F.sum(30 + F.when(n % 5 == 0, 80).otherwise(10)).over(Window.partitionBy("doc_id").orderBy("line_no")).cast("double")
    x1 = (100 + n % 7 * 60).cast("double")
    placed = _listed(spark, sf_dir).withColumn("y1", y).withColumns({"x1": x1, "x2": x1 + 160, "y2": F.col("y1") + 24 + n % 9, "confidence": n % 100 / 100, "raw_text": F.col("text"), "reading_order": F.lit(None).cast("int")})
    p = par.paragraph_objects(placed, ["doc_id"])
    return p.select("doc_id", "paragraph", "line_count", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.md5(F.col("raw_text").cast("binary")).alias("raw_md5"), "x1", "y1", "x2", "y2", F.round("confidence", 6).alias("confidence"))
