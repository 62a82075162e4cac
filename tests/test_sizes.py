"""What lets queries grow with their input: shuffles a plan has, batches that Python holds, results where tables have odd rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.functions import geometry, model_text, text
from quirefold.operators import native, paragraphs
from quirefold.plans.catalog import ORACLES, QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- objects on pages
@pytest.mark.parametrize("name", ["embedded_figures", "native_merge", "recovered_text", "native_layout_order"])
def test_pages_are_shuffled_once(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert plan.count("Exchange") == 1 and "InArrow" not in plan and "InPandas" not in plan


def test_covered_share_counts_pixels(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for n in range(120):
        x, y, w, h = (rng.integers(a, b, n % 12 + 1) for a, b in ((0, 20), (0, 20), (1, 15), (1, 15)))
        boxes = [[float(v) for v in b] for b in zip(x, y, x + w, y + h, strict=True)]
        ink = np.zeros((40, 40), dtype=bool)
        for x1, y1, x2, y2 in boxes[1:]:
            ink[int(y1) : int(y2), int(x1) : int(x2)] = True
        x1, y1, x2, y2 = (int(v) for v in boxes[0])
        rows.append((boxes[0], boxes[1:]))
        want.append(ink[y1:y2, x1:x2].mean())
    box = "struct<x1: double, y1: double, x2: double, y2: double>"
    df = spark.createDataFrame(rows, f"b {box}, r array<{box}>")
    assert np.allclose([r[0] for r in df.select(geometry.covered_share(F.col("b"), F.col("r"))).collect()], want)
    assert df.limit(1).select(geometry.covered_share(F.col("b"), F.lit(None).cast(f"array<{box}>"))).first()[0] == 0



BOXED = "doc_id int, page int, ordinal int, text string, x1 double, y1 double, x2 double, y2 double"


def test_rows_without_a_page_share_nothing(spark):
    rows = lambda *r: spark.createDataFrame([(d, 1, n, t, x, 0.0, x + 10, 10.0) for d, n, t, x in r], BOXED)
    own = rows((1, 1, "a", 0.0), (None, 2, "b", 0.0), (None, 3, "c", 50.0))
    late = rows((1, 4, "a", 90.0), (1, 5, "d", 90.0), (None, 6, "e", 90.0))
    assert [r["ordinal"] for r in native.recovered_text(late, own, own, ["doc_id", "page"]).collect()] == [5]
    got = native.merged_order(own.withColumn("reading_order", F.col("ordinal")), late, ["doc_id", "page"]).collect()
    assert sorted((r["doc_id"] or 0, r["reading_order"], r["ordinal"]) for r in got) == [(0, 1, 6), (0, 2, 2), (0, 3, 3), (1, 1, 1), (1, 2, 4), (1, 3, 5)]


def test_layout_order_keeps_columns_and_pages_without_text(spark):
    rows = [(1, 1, 1, "paragraph", True, 0.0, 50.0, "p"), (1, 1, 2, "table", None, 0.0, 50.0, "t"), (1, 1, 3, "figure", None, 0.0, 60.0, "f"), (1, 2, 1, "stamp", None, 9.0, 9.0, "s"), (1, 2, 2, "table", None, 8.0, 9.0, "u"), (2, 1, 1, "paragraph", False, 0.0, 5.0, "q"), (2, 1, 2, "stamp", None, 0.0, 1.0, "v")]
    df = spark.createDataFrame(rows, "doc_id int, page int, ordinal int, type string, native boolean, x1 double, y1 double, tag string").selectExpr("*", "x1 + 5 AS x2", "y1 + 5 AS y2")
    got = native.layout_order(df, ["doc_id", "page"])
    assert got.columns == [*df.columns, "reading_order"]
    assert [r["tag"] for r in got.orderBy("doc_id", "page", "reading_order").collect()] == ["t", "p", "f", "u", "s", "v", "q"]


# ---------------------------------------------------------------- texts
def test_digests_take_rows_without_an_id_last(spark, tmp_path):
    rows = [(1, "a", "x"), (3, None, "x"), (4, "b", "x"), (None, "last", "x"), (None, "only", "y"), (7, "n", None), (None, "m", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = {r["source"]: r["digest"] for r in QUERIES["document_text"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(ORACLES["document_text"]).fetchall())


def test_texts_are_read_once_and_shuffled_once(spark, sf_dir):
    plan = plan_of(QUERIES["paragraph_objects"](spark, sf_dir))
    assert plan.count("Exchange") == 1 and "Join" not in plan and "InArrow" not in plan
    for name in ("paragraph_objects", "list_markers"):
        assert plan_of(QUERIES[name](spark, sf_dir)).count("rlike") <= 2 * 12 and "Join" not in plan_of(QUERIES[name](spark, sf_dir))


def test_markers_behind_marks_and_blanks(spark):
    rows = [("\u200f A) x", "A"), ("b\u200e- y", "B"), ("\u202bالف- z", "الف"), ("\u00a0\r\n c\u00a0d", "C"), ("\ufeffD\u200f\u2003: e", "D"), ("E\u200ff", None), ("\u200cب- g", None), ("Word", None), (None, None)]
    df = spark.createDataFrame([(1, i * 5, t) for i, (t, _) in enumerate(rows)], "page int, line_no int, text string")
    got = paragraphs.accepted_markers(df, "page", "line_no", "text").orderBy("line_no").collect()
    assert [r["marker"] for r in got] == [m for _, m in rows]
    assert [r["line_no"] for r in paragraphs.marked_lines(df, "page", "line_no", "text").collect()] == [i * 5 for i, (_, m) in enumerate(rows) if m]


def test_confidence_of_paragraphs_without_any(spark):
    rows = [(1, i, t, t, None, 0.0, 12.0 * i, 10.0, 12.0 * i + 10, c) for i, (t, c) in enumerate([("a", None), ("b", 0.5), ("c", 0.25)])]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, text string, raw_text string, reading_order int, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = paragraphs.paragraph_objects(df, ["doc_id"]).collect()
    assert [(r["text"], r["line_count"], r["confidence"], r["line_confidences"]) for r in got] == [("a\nb\nc", 3, 0.25, [None, 0.5, 0.25])]


def test_guards_miss_nothing(spark):
    uri = "DATA:image/PNG;Base64,QUJD"
    given = {"ASSISTANT : x": "x", "System": "", "用户:  y": "y", "\x85\u2003z\u3000": "z", f"a {uri}\nb": "a\n\nb", "NONE none": "", "\\7": "", "\\7 seven": "\\7 seven", "[ANSWER]": "", "IMAGE": "", "imagery": "imagery",
             "<SPAN x>k</Span>": "k", "a\rb": "a\nb", "\\modifier{q}m": "m", "\\*_ n": "n", "YOU  CAN\tSEE it": "", "Fig: 3a the field trucks smoke": "", "a field of plenty": "a field of plenty", "u" * 40: "u" * 40, "-" * 33: "-" * 33, "-" * 32: ""}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", model_text.strip_artifacts(F.col("t")).alias("x")).collect()}
    assert got == given


def test_captions_count_whole_words(spark, sf_dir):
    assert "array_contains" not in plan_of(QUERIES["clean_model_text"](spark, sf_dir))
    said = " ".join(text.VISUAL_WORDS)
    rows = [(said, len(text.VISUAL_WORDS)), ("Trucks,truck;truc trucksx xtruck", 2), ("pumps1pump éfield", 3), ("", 0)]
    df = spark.createDataFrame(rows, "t string, n int")
    assert df.where(text.visual_score(F.col("t")) != F.col("n")).count() == 0


def test_passages_are_counted_in_small_batches(spark, sf_dir, tmp_path):
    plan = plan_of(QUERIES["quality_gate"](spark, sf_dir))
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    texts = ["short", None, "", "ab" * 480, "x" * 959, "漢" * 960]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["repeats"] for r in QUERIES["quality_gate"](spark, str(tmp_path)).collect()}
    assert got == {i: text.most_repeats(t) for i, t in enumerate(texts)} and got[5] == 841
