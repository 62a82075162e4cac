"""Queries over requests, model payloads, small texts and the life of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images, names
from ..session import table
from ..sources import requests as req
from ..streaming import jobs
from .registry import query

_STORE = req.Store("https://media.example.org/files", "scans")
#: Addresses made of page ids: what stands before the rest of the address, by remainder.
_URLS = (
    "https://media.example.org/files/scans/documents/", "http://media.example.org/files/scans/documents/", "https://u:p@media.example.org/files/scans/", "https://media.example.org/files/other/",
    "https://MEDIA.example.org:443/files/scans/a%20b/", "ftp://media.example.org/files/scans/", "https://media.example.org/scans/", "https://media.example.org/files/scans/../", "https://media.example.org/files/scans",
)
_URL = "['" + "', '".join(_URLS) + "'][(page_id % 9)::int + 1] || CASE WHEN page_id % 9 < 8 THEN 'page ' || page_id || '.png' ELSE '' END || CASE page_id % 4 WHEN 0 THEN '?sig=x+y' WHEN 1 THEN '#top' ELSE '' END"


@query(
    f"""WITH a AS (SELECT page_id, page_id % 9 AS k, {_URL} AS url FROM pages),
v AS (SELECT *, CASE WHEN k = 5 THEN 'scheme' WHEN k = 2 THEN 'credentials' WHEN contains(url, '#') THEN 'fragment' WHEN k = 1 THEN 'authority' WHEN k = 6 THEN 'base path' WHEN k = 8 THEN 'no key' WHEN k = 3 THEN 'bucket' WHEN k = 7 THEN 'segment' ELSE 'ok' END AS verdict FROM a)
SELECT page_id, verdict, CASE WHEN verdict = 'ok' THEN CASE k WHEN 0 THEN 'documents/' ELSE 'a b/' END || 'page ' || page_id || '.png' END AS key,
  CASE WHEN verdict = 'ok' THEN 'https://media.example.org/files/scans/' || CASE k WHEN 0 THEN 'documents/' ELSE 'a%20b/' END || 'page%20' || page_id || '.png' END AS source_url FROM v"""
)
def object_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    head = F.element_at(F.array(*[F.lit(u) for u in _URLS]), (k % 9 + 1).cast("int"))
    url = F.concat(head, F.when(k % 9 < 8, F.concat(F.lit("page "), k.cast("string"), F.lit(".png"))).otherwise(""), F.when(k % 4 == 0, "?sig=x+y").when(k % 4 == 1, "#top").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", req.object_reference(url, _STORE).alias("r")).select("page_id", "r.verdict", "r.key", "r.source_url")


@query(f"SELECT event_id, CASE event_id % 5 WHEN 2 THEN 'not an object' WHEN 3 THEN 'invalid' ELSE 'ok' END AS verdict, CASE event_id % 5 WHEN 0 THEN replace(props, ' ', '') WHEN 1 THEN '{{}}' WHEN 4 THEN '{{}}' END AS value FROM events")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.col("props")).when(k == 1, "").when(k == 2, "[1]").when(k == 3, '{"k"')
    return table(spark, sf_dir, "events").select("event_id", req.object_field(raw).alias("f")).select("event_id", "f.verdict", "f.value")


@query(
    """WITH f AS (SELECT o_custkey AS doc, list(o_orderpriority ORDER BY o_orderkey) AS ns, count(*) AS n FROM orders GROUP BY o_custkey), x AS (SELECT doc, n, unnest(ns) AS name, generate_subscripts(ns, 1) AS i FROM f)
SELECT doc, CASE WHEN doc % 4 = 1 THEN 100 + i ELSE i END::int AS page_number, CASE WHEN doc % 4 = 1 THEN 'id' || i ELSE doc || ':p' || i END AS page_id, CASE WHEN name = '5-LOW' THEN 'page_' || i || '.image' ELSE name END AS filename,
  CASE doc % 4 WHEN 2 THEN 'length' WHEN 3 THEN 'invalid' ELSE 'ok' END AS verdict FROM x"""
)
def page_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    listed = F.transform("l", lambda x: F.when(x["o_orderpriority"] == "5-LOW", "").otherwise(x["o_orderpriority"]))
    given = F.to_json(F.transform("l", lambda x, i: F.struct(F.concat(F.lit("id"), (i + 1).cast("string")).alias("page_id"), (i + 101).alias("page_number"))))
    k = F.col("doc") % 4
    raw = F.when(k == 1, given).when(k == 2, F.concat(F.lit('[{"page_number": 1},'), F.substring(given, 2, 1 << 30))).when(k == 3, '{"page_number": 1}').otherwise("")
    return req.page_descriptors(o.select("doc", listed.alias("names"), raw.alias("raw")), "doc", "raw", "names")


@query(
    """WITH p AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 1 + o_orderkey % 5 END AS page_number, CASE WHEN o_custkey % 5 = 0 THEN 'p' || (o_orderkey % 7) END AS page_id FROM orders),
q AS (SELECT *, coalesce(page_number, position + 1) AS n, coalesce(page_id, doc || ':p' || coalesce(page_number, position + 1)) AS id FROM p),
d AS (SELECT doc, count(*) AS n_pages, count(*) > count(DISTINCT n) AS n2, count(*) > count(DISTINCT id) AS i2, bool_or(o_orderkey % 31 = 0) AS away, bool_or(position = 3 AND doc % 7 = 0) AS other FROM q GROUP BY doc)
SELECT doc, CASE WHEN other THEN 'native page' WHEN n2 THEN 'page_number' WHEN i2 THEN 'page_id' WHEN n_pages > 12 THEN 'pages' WHEN away THEN 'prefix' ELSE 'ok' END AS verdict, n_pages FROM d"""
)
def request_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    key = F.concat(F.lit("documents/"), F.when(k % 31 == 0, "other").otherwise(c.cast("string")), F.lit("/images/x.png"))
    p = table(spark, sf_dir, "orders").withColumn("position", i).select(c.alias("doc"), "position", F.when(c % 3 == 0, 1 + k % 5).alias("page_number"), F.when(c % 5 == 0, F.concat(F.lit("p"), (k % 7).cast("string"))).alias("page_id"), key.alias("key"), F.when((F.col("position") == 3) & (c % 7 == 0), -1).alias("native_number"))
    return req.request_verdicts(p, "doc", most=12)


@query(
    """SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS content, CASE WHEN bool_or(turn = 1 AND conv_id % 7 = 0) THEN 'error' WHEN conv_id % 3 = 0 THEN 'unfinished' WHEN conv_id % 3 = 1 THEN 'length' ELSE 'ok' END AS verdict FROM conversations GROUP BY conv_id"""
)
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    k = F.col("conv_id") % 3
    line = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"), F.when((F.col("turn") == 1) & (F.col("conv_id") % 7 == 0), "busy").alias("error"), (last & (k > 0)).alias("done"), F.when(last & (k == 1), "length").when(last & (k == 2), "stop").alias("done_reason")))
    return req.streamed_answers(c.select("conv_id", "turn", line.alias("line")), ["conv_id"], "turn", "line")


@query("SELECT event_id, replace(props, ' ', '') AS payload FROM events")
def unwrapped_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("event_id") % 3, F.col("props")
    nested = F.when(k == 0, p).when(k == 1, F.concat(F.lit('{"res": '), p, F.lit("}"))).otherwise(F.concat(F.lit('{"json": {"res": '), p, F.lit("}}")))
    return table(spark, sf_dir, "events").select("event_id", req.unwrapped(nested).alias("payload"))


_SAFE = r"regexp_replace(regexp_replace(coalesce({}, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')"


@query(f"SELECT page_id, CASE WHEN {_SAFE.format('url')} <> '' THEN {_SAFE.format('url')} ELSE 'page' END AS name, page_id || ':p' || (page_id % 7) AS default_id, 'obj_' || left(sha256(page_id || '|table|3'), 32) AS object_id, replace(replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), chr(10), '<br>') AS html FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", names.safe_component(F.col("url"), "page").alias("name"), names.page_id(k, k % 7).alias("default_id"), names.object_id(k, F.lit("table"), F.lit(3)).alias("object_id"), names.shown_html(F.col("url")).alias("html"))


_MODULES = "CASE o_custkey % 3 WHEN 0 THEN 'All modules succeeded.' WHEN 1 THEN 'Figure/Table succeeded on all pages.' ELSE 'Selected modules succeeded.' END"


@query(f"SELECT o_orderkey, {_MODULES} || CASE WHEN o_orderkey % 2 = 0 THEN ' Artifacts were persisted.' ELSE '' END AS message, o_orderpriority || ': ' || o_orderstatus AS error, upper(o_orderpriority) AS code FROM orders")
def run_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 3
    of = lambda *m: F.array(*[F.lit(x) for x in m])
    run = F.when(k == 0, of(*names.MODULE_LABELS)).when(k == 1, of("figure_table", "figure_table")).otherwise(of("ocr", "figure_table"))
    e = names.error_text(F.col("o_orderpriority"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.success_message(run, F.col("o_orderkey") % 2 == 0).alias("message"), e["message"].alias("error"), e["code"].alias("code"))


# ---------------------------------------------------------------- pictures
_INK = "list_transform(range(0, 240), lambda y: ((y * 7 + event_id * 13) % 29 * ((y + event_id) % 5))::int)"


@query(
    f"""WITH e AS (SELECT event_id, {_INK} AS ink FROM events), c1 AS (SELECT *, list_min(ink[69:92]) AS m1 FROM e), 
k1 AS (SELECT *, list_sort(list_transform(list_filter(range(68, 92), lambda y: ink[y + 1] = m1), lambda y: [abs(y - 80), y]))[1][2] AS cut1 FROM c1),
c2 AS (SELECT *, list_min(ink[greatest(cut1 + 1, 148) + 1:172]) AS m2 FROM k1)
SELECT event_id, cut1::int AS cut1, list_sort(list_transform(list_filter(range(greatest(cut1 + 1, 148), 172), lambda y: ink[y + 1] = m2), lambda y: [abs(y - 160), y]))[1][2]::int AS cut2 FROM c2"""
)
def region_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = F.transform(F.sequence(F.lit(0), F.lit(239)), lambda y: ((y * 7 + F.col("event_id") * 13) % 29 * ((y + F.col("event_id")) % 5)).cast("int"))
    cuts = images.region_cuts(F.col("ink"), 3)
    return table(spark, sf_dir, "events").select("event_id", ink.alias("ink")).select("event_id", cuts[1].alias("cut1"), cuts[2].alias("cut2"))


# ---------------------------------------------------------------- jobs
_STATUS = "CASE event_type WHEN 'click' THEN 'processing' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t.isin("click", "view"), "processing").when(t == "purchase", "completed").when(t == "error", "failed").otherwise("cancelled")
    return table(spark, sf_dir, "events").select((F.col("event_id") % 2500).alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), "ts")


@query(
    f"""WITH e AS (SELECT event_id % 2500 AS job_id, event_id AS seq, {_STATUS} AS status, ts FROM events), f AS (SELECT job_id, min(seq) AS last, arg_min(status, seq) AS s FROM e WHERE status <> 'processing' GROUP BY job_id),
g AS (SELECT e.*, coalesce(last, 9223372036854775807) AS last, s FROM e LEFT JOIN f USING (job_id))
SELECT job_id, coalesce(CASE WHEN any_value(s) = 'cancelled' THEN 'failed' ELSE any_value(s) END, 'processing') AS status, CASE any_value(s) WHEN 'cancelled' THEN 'CANCELLED' WHEN 'failed' THEN 'FAILED' END AS error_code,
  count(*) FILTER (status = 'cancelled' AND seq > last AND s = 'completed') AS conflicts, count(*) FILTER (seq > last) AS ignored, max(ts) FILTER (seq <= last) + INTERVAL 7 DAY AS expires, any_value(s) IS NOT NULL AS callback FROM g GROUP BY job_id"""
)
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.lifecycle(_events(spark, sf_dir))


@query("SELECT user_id, least(CASE user_id % 6 WHEN 5 THEN 99 ELSE user_id % 6 + 1 END, 3)::int AS attempts, user_id % 6 < 3 AS delivered, list_sum(list_transform(range(1, least(CASE user_id % 6 WHEN 5 THEN 99 ELSE user_id % 6 + 1 END, 3)::int), lambda k: least(2 ** (k - 1), 8)))::int AS waited FROM (SELECT DISTINCT user_id FROM events)".replace("list_sum(", "coalesce(list_sum(").replace("lambda k: least(2 ** (k - 1), 8)))::int", "lambda k: least(2 ** (k - 1), 8))), 0)::int"))
def callback_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 6
    first = F.when(k == 5, F.lit(None)).otherwise(k + 1)  # the first attempt that would go through
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", jobs.callback(first.cast("int"), 3).alias("c")).select("user_id", "c.attempts", "c.delivered", "c.waited")

