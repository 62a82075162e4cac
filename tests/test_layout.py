"""Vectors for the layout operators."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quirefold.functions import geometry as geo
from quirefold.functions import text as tx
from quirefold.operators import grouping, merge, spatial
from quirefold.plans.queries import QUERIES
from quirefold.sources import objects as src
from quirefold.streaming import jobs


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a  b\r\nc\t d ", "a b\nc d"), ("x ,y ( z )", "x,y (z)"), ("می ‌ رود", "می‌رود"), ("‏ab‮", "ab"), ("  a", "a"), ("", "")],
)
def test_canonical_text(spark, raw, want):
    assert one(spark, tx.canonical_text(F.col("t")), t=raw) == want


def test_composition_and_persian(spark):
    assert one(spark, tx.canonical_text(F.col("t"), compose=True), t="é") == "é"
    assert one(spark, tx.persian_text(F.col("t")), t="كتاب ٣") == "کتاب ۳"


def test_visual_to_logical_keeps_tokens(spark):
    assert one(spark, tx.visual_to_logical(F.col("t")), t="AB-12 دج") == "جد AB-12"


def test_tags_and_roles(spark):
    assert one(spark, tx.strip_tags(F.col("t")), t="<p>a<b>b</b></p><br/>c") == "ab\nc"
    assert one(spark, tx.strip_role(F.col("t")), t="Assistant : hi") == "hi"


@pytest.mark.parametrize(("text", "want"), [("<b>1</b>", "unusable"), ("ab \\foo> cd", "artifact"), ("Day [[1]] abc", "damaged"), ("plain words", "ok"), ("abcdefghij" * 120, "repetition")])
def test_quality_gate(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.quality_verdict(F.col("t"), tx.passage_repeats(F.col("t"))).alias("v")).first()["v"] == want


def test_markers_and_starts(spark):
    assert tuple(one(spark, tx.english_marker(F.col("t")), t="A. text")) == ("A", True)
    assert tuple(one(spark, tx.english_marker(F.col("t")), t="B text")) == ("B", False)
    assert one(spark, tx.hard_start(F.col("t")), t="Section 4") and one(spark, tx.hard_start(F.col("t")), t="12) x") and not one(spark, tx.hard_start(F.col("t")), t="sectional")


@pytest.mark.parametrize(("label", "want"), [("Table", "table"), ("table_caption", None), ("image", "figure"), ("figure_title", None), ("bar chart", "figure"), ("seal", None)])
def test_label_map(spark, label, want):
    assert one(spark, merge.map_label(F.col("l")), l=label) == want


def test_geometry(spark):
    assert one(spark, geo.restore(F.col("x"), F.lit(0.5), F.lit(100.0)), x=60.0) == 100.0
    assert one(spark, geo.x_overlap_ratio(*[F.lit(float(v)) for v in (0, 10, 5, 25)]), x=0) == 0.5
    w, h = geo.bounded_size(F.lit(4000), F.lit(2000), 1000)
    assert (one(spark, w, x=0), one(spark, h, x=0)) == (1000, 500)


def test_union_coverage_counts_overlaps_once(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 50.0, 50.0, 60.0, 60.0), (1, 3, 5.0, 5.0, 5.0, 9.0)], "page int, id int, x1 double, y1 double, x2 double, y2 double")
    regions = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 8.0), (1, 0.0, 4.0, 5.0, 10.0), (1, 2.0, 0.0, 5.0, 10.0)], "page int, x1 double, y1 double, x2 double, y2 double")
    got = {r["id"]: r["coverage"] for r in spatial.union_coverage(boxes, regions, ["page"], "id").collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0}


def test_paragraph_fold_splits_on_gap_and_shift(spark):
    rows = [(0, False, 100.0, 900.0, 0.0, 30.0), (1, False, 100.0, 900.0, 40.0, 70.0), (2, False, 100.0, 900.0, 200.0, 230.0), (3, False, 950.0, 990.0, 240.0, 270.0), (4, True, 950.0, 990.0, 280.0, 310.0)]
    df = spark.createDataFrame(rows, "n int, hard boolean, x1 double, x2 double, y1 double, y2 double")
    g = df.agg(F.array_sort(F.collect_list(F.struct("n", "hard", "x1", "x2", "y1", "y2"))).alias("ls"))
    assert g.select(grouping.paragraph_ids(F.col("ls"), F.lit(30.0)).alias("g")).first()["g"] == [1, 1, 2, 3, 4]


def test_url_policy(spark):
    v = lambda u: one(spark, src.url_verdict(F.col("u"), "h.example"), u=u)
    assert [v("https://h.example/b/k"), v("ftp://h.example/b"), v("https://u:p@h.example/b"), v("https://h.example/b#x"), v("https://h.example:8443/b"), v("https://h.example/b/../c"), v("https://H.example:443/b?q=1")] == [
        "ok", "scheme", "credentials", "fragment", "authority", "path", "ok",
    ]
    assert one(spark, src.public_url("https://x/", F.col("k")), k="a b/c+d") == "https://x/a%20b/c%2Bd"


def test_job_stream_keeps_ends(spark, tmp_path):
    schema = "job_id long, seq long, status string"
    spark.createDataFrame([(1, 1, "processing"), (1, 2, "completed"), (1, 3, "cancelled"), (2, 1, "processing"), (2, 2, "cancelled")], schema).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("job_states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r["job_id"], r["status"]) for r in spark.table("job_states").collect()} == {(1, "completed"), (2, "failed")}


def test_listing_is_bounded(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.bin").write_bytes(b"x" * (i + 1))
    rows, more = src.list_objects(spark, str(tmp_path), 2)
    assert rows.count() == 2 and more


def test_document_text_takes_every_document(spark, sf_dir, tmp_path):
    rows = [(2, "b" * 5000, "s", 5000), (1, "é short", "s", 7), (3, "uncounted", "s", None), (4, None, "s", None), (5, "", "s", 0), (6, "z" * 400, None, 400), (7, None, "t", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["source"]: r["digest"] for r in QUERIES["document_text"](spark, str(tmp_path)).collect()}
    md5 = lambda *texts: hashlib.md5("\n\n".join(texts).encode()).hexdigest()
    assert got == {"s": md5("é short", "b" * 5000, "uncounted"), None: md5("z" * 400), "t": md5()}
    whole = f"SELECT source, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id, text)) FROM read_parquet('{sf_dir}/documents.parquet') GROUP BY source"
    assert {(r["source"], r["digest"]) for r in QUERIES["document_text"](spark, sf_dir).collect()} == set(duckdb.sql(whole).fetchall())


def test_translate_digits_reads_whole_texts(spark, sf_dir, tmp_path):
    rows = [(1, "x" * 40 + "ي٣" + "y" * 50 + "ك"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["persian"] for r in QUERIES["translate_digits"](spark, str(tmp_path)).collect()}
    assert got == {1: "۰ی" + "x" * 40 + "ی۳" + "y" * 50 + "کک۹", 2: None, 3: "۰یک۹"}
    whole = f"SELECT doc_id, translate('٠ي' || text || 'ك٩', '{tx.ARABIC}', '{tx.PERSIAN}') FROM read_parquet('{sf_dir}/documents.parquet')"
    assert sorted((r["doc_id"], r["persian"]) for r in QUERIES["translate_digits"](spark, sf_dir).collect()) == sorted(duckdb.sql(whole).fetchall())
