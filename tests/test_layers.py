"""Operators without SQL, or whose SQL shares their patterns: examples, brute force, edge cases."""

import json
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.functions import images, model_text, names, text
from quirefold.operators import adapters, native, paragraphs, publish
from quirefold.sources import requests
from quirefold.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- text
@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("<|im_start|>متن<|im_end|>", "متن"),
        ("assistant: سلام", "سلام"),
        ("user:", ""),
        ("0</|im_start|>|user|l3</|ref|>", ""),
        ("logo<|im_end|>", ""),
        ("company logo<|im_end|>", "company logo"),
        ("<p>یک</p><p>دو</p>", "یک\n\nدو"),
        ("data:image/png;base64,AAAA==\nمتن", "متن"),
        ("متن\n\nThe image shows a field.\n\nThere are clouds in it.\n\nTotal 12", "متن\n\nTotal 12"),
        ("There are two parts.", "There are two parts."),
        ("You can see\n\n\n\nThere is\n\nA heading\n\nIt is late", "A heading\n\nIt is late"),
        ("None None\n\\12\n[caption]\nimage", ""),
        ("｜user｜ a", "a"),
        (None, ""),
        ("", ""),
    ],
)
def test_artifacts_go_and_words_stay(spark, given, want):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(model_text.strip_artifacts(F.col("t"))).first()[0] == want


def test_plain_responses(spark):
    got = one(spark, model_text.plain_response(F.col("t")), t="*<|im_end|> # Head\n```\n* a\n+ b\n```\n**bold** x<br/>y\n\n\n\n\\*\nend</im_end>")
    assert got.startswith("Head\n") and "- a\n- b" in got and "bold x\ny" in got and got.endswith("\nend") and not {"`", "*", "#", "\\"} & set(got) and "\n\n\n" not in got


def test_grounded_spans_in_pixels(spark):
    said = "<|ref|>two<|/ref|><|det|>[[0, 500, 100, 600], [50, 900, 999, 1200]]<|/det|><|ref|>one<|/ref|><|det|>(0, 0, 999, 10)<|/det|><|ref|>bad<|/ref|><|det|>[1, 2]<|/det|>"
    got = one(spark, model_text.grounded_spans(F.col("t"), F.lit(999), F.lit(1998)), t=said)
    near = lambda v: None if v is None else round(v, 6)
    assert [(s["text"], *(near(s[c]) for c in ("x1", "y1", "x2", "y2"))) for s in got] == [("bad", None, None, None, None), ("one", 0, 0, 999, 20), ("two", 0, 1000, 999, 1998)]


def test_composition(spark):
    rows = ["e\u0301te\u0301", "plain", None, "\u064a\u0654", "Å"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", text.canonical_text(F.col("t"), compose=True).alias("x")).collect()}
    assert got == {i: unicodedata.normalize("NFC", r or "") for i, r in enumerate(rows)}


def test_passage_counts_against_a_counter():
    rng = np.random.default_rng(2)
    said = "".join(chr(int(c)) for c in rng.integers(97, 100, 3000))
    for t in (said, said[:200] * 9, "ab" * 700, "x" * 960, "é漢" * 600, "short", "", None):
        want = max(Counter(t[i : i + 120] for i in range(len(t) - 119)).values()) if t and len(t) >= 960 else 0
        assert text.most_repeats(t) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("الف- یک", ("fa", "الف", "strong", "یک")), ("ب متن", ("fa", "ب", "weak", "متن")), ("جمتن", ("fa", "ج", "glued", "متن")), ("هـ) پنج", ("fa", "ه", "strong", "پنج")), ("ك. ده", ("fa", "ک", "strong", "ده")),
        ("A) one", ("en", "A", "strong", "one")), ("b - two", ("en", "B", "strong", "two")), ("A service", ("en", "A", "weak", "service")), ("12", None), ("", None), ("ب", None), ("Word", None),
    ],
)
def test_list_markers(spark, line, want):
    got = one(spark, paragraphs.marker(F.col("t")), t=line)
    assert (tuple(got) if got else None) == want


def lines(rows):
    return [(1, i, t, None, None, 100.0, 40.0 * i, 900.0, 40.0 * i + 30, 0.5) for i, t in enumerate(rows)]


LINE = "doc_id int, line_no int, text string, raw_text string, reading_order int, x1 double, y1 double, x2 double, y2 double, confidence double"


def test_paragraphs_hold_lists_and_wrapped_prose(spark):
    rows = lines(["intro text", "goes on", "الف - اول", "ب - دوم", "ادامه", "ج سوم", "ماده 1", "- bullet", "end"])
    got = paragraphs.paragraph_objects(spark.createDataFrame(rows, LINE), ["doc_id"]).orderBy("paragraph").collect()
    assert [r["text"] for r in got] == ["intro text\ngoes on", "الف - اول", "ب - دوم\nادامه", "ج - سوم", "ماده 1", "- bullet\nend"]
    assert [r["line_count"] for r in got] == [2, 1, 2, 1, 1, 2] and got[0]["y2"] == 70 and got[0]["line_confidences"] == [0.5, 0.5]


def test_paragraphs_follow_given_order_only_if_all_lines_have_one(spark):
    rows = [(1, 0, "b", "raw b", 1, 0.0, 0.0, 10.0, 10.0, 1.0), (1, 1, "a", None, 0, 0.0, 12.0, 10.0, 22.0, 0.5)]
    got = paragraphs.paragraph_objects(spark.createDataFrame(rows, LINE), ["doc_id"]).orderBy("paragraph").collect()
    assert [r["text"] for r in got] == ["a", "b"] and [r["raw_text"] for r in got] == ["a", "raw b"]
    rows[0] = (*rows[0][:4], None, *rows[0][5:])
    got = paragraphs.paragraph_objects(spark.createDataFrame(rows, LINE), ["doc_id"]).collect()
    assert [r["text"] for r in got] == ["b\na"] and paragraphs.paragraph_objects(spark.createDataFrame([], LINE), ["doc_id"]).count() == 0


# ---------------------------------------------------------------- native text
def test_pictures_are_added_one_after_another(spark):
    rng = np.random.default_rng(1)
    boxes = []
    for doc in range(20):
        for i in range(8):
            x, y = (int(v) for v in rng.integers(0, 20, 2))
            boxes.append((doc, 1, i, float(x), float(y), float(x + rng.integers(1, 15)), float(y + rng.integers(1, 15)), i < 2))
    df = spark.createDataFrame(boxes, "doc_id int, page int, ordinal int, x1 double, y1 double, x2 double, y2 double, old boolean")
    got = {(r["doc_id"], r["ordinal"]) for r in native.embedded_figures(df.where("NOT old"), df.where("old"), ["doc_id", "page"]).collect()}
    want = set()
    for doc in range(20):
        ink = np.zeros((40, 40), dtype=bool)
        for _, _, i, x1, y1, x2, y2, old in (b for b in boxes if b[0] == doc):
            part = ink[int(y1) : int(y2), int(x1) : int(x2)]
            if old or part.mean() < 0.85:
                want |= set() if old else {(doc, i)}
                part[:] = True
    assert got == want


def test_repeated_recovered_text_is_kept_once(spark):
    box = "doc_id int, page int, ordinal int, text string, x1 double, y1 double, x2 double, y2 double, confidence double"
    own = spark.createDataFrame([(1, 1, 1, "known text", 0.0, 0.0, 100.0, 10.0, 1.0)], box)
    late = spark.createDataFrame([(1, 1, 1, "known  text", 0.0, 50.0, 90.0, 60.0, 0.9), (1, 1, 2, "new", 0.0, 50.0, 90.0, 60.0, 0.9), (1, 1, 3, " new ", 0.0, 70.0, 90.0, 80.0, 0.9), (1, 1, 4, "over", 0.0, 0.0, 50.0, 10.0, 0.9), (1, 1, 5, None, 0.0, 90.0, 9.0, 99.0, 0.9)], box)
    got = native.recovered_text(late, own, late.where("ordinal = 2"), ["doc_id", "page"]).collect()
    assert [(r["ordinal"], r["as_image"]) for r in got] == [(2, True)]


# ---------------------------------------------------------------- pictures
def test_margins_are_cut_from_sparse_pages():
    page = np.full((400, 300), 255, dtype=np.uint8)
    page[150:200, 100:180] = 0
    assert images.margin_crop(page) == (76, 126, 204, 224)
    page[5, :] = 0
    page[:, 2] = 0
    assert images.margin_crop(page) == (76, 126, 204, 224)
    assert images.margin_crop(np.full((400, 300), 255, dtype=np.uint8)) == (0, 0, 300, 400)
    dense = np.zeros((400, 300), dtype=np.uint8)
    dense[:, ::2] = 255
    assert images.margin_crop(dense) == (0, 0, 300, 400)


def test_regions_cover_a_page_once(spark):
    page = np.full((600, 200), 0, dtype=np.uint8)
    page[205:207] = page[390:392] = 255
    got = one(spark, images.region_cuts(F.col("ink"), 3), ink=[int(x) for x in images.row_ink(page)])
    assert got == [0, 205, 391, 600]
    assert one(spark, images.region_cuts(F.col("ink"), 3), ink=[0] * 100) is None


def test_orientation_size_and_png(spark, tmp_path):
    exif = b"Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + b"\xff\xc0\0\x0b\x08\0\x14\0\x28\x01\x01\x11\0"
    assert images.exif_orientation(jpeg) == 6 and images.jpeg_size(jpeg) == (40, 20) and images.exif_orientation(b"\xff\xd8") == 1
    a = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert images.upright(a, 6).tolist() == np.rot90(a, -1).tolist() and images.upright(a, 8).tolist() == np.rot90(a).tolist()
    assert images.upright(a, 3).tolist() == np.rot90(a, 2).tolist() and images.upright(a, 5).tolist() == a.T.tolist() and images.upright(a, 2).tolist() == a[:, ::-1].tolist()
    rgb = np.random.default_rng(0).integers(0, 256, (7, 9, 3)).astype(np.uint8)
    (tmp_path / "x.png").write_bytes(images.write_png(rgb))
    r = spark.read.format("image").load(str(tmp_path)).first()["image"]
    assert np.frombuffer(r["data"], dtype=np.uint8).reshape(7, 9, 3)[:, :, ::-1].tolist() == rgb.tolist()
    assert [images.image_verdict(x, 1000, 70) for x in (None, b"", b"GIF", b"x" * 1001, images.write_png(rgb), images.write_png(rgb[:, :7]))] == ["empty", "empty", "corrupted or unsupported", "too large", "ok", "ok"]
    assert images.image_verdict(images.write_png(rgb), 1000, 62) == "too many pixels"
    assert images.resized(np.full((4000, 2000, 3), 7, dtype=np.uint8), 1000).shape == (1000, 500, 3) and images.resized(rgb, 100) is rgb
    assert images.resized(np.array([[0, 10, 20, 30]], dtype=np.uint8), 2).tolist() == [[5, 25]]


def test_quads_are_rectified():
    a = np.random.default_rng(0).integers(0, 256, (50, 60)).astype(np.uint8)
    quad = np.array([[10, 5], [39, 5], [39, 24], [10, 24]], dtype=float)
    assert images.rectified(a, quad)[:-1, :-1].shape == (18, 28) and images.rectified(a, quad)[0, 0] == a[5, 10]
    tall = np.array([[10, 5], [19, 5], [19, 44], [10, 44]], dtype=float)
    assert images.rectified(a, tall).shape == (9, 39)


# ---------------------------------------------------------------- requests, artifacts, jobs
def test_stores_refuse_bad_addresses():
    for base in ("ftp://a/b", "https://u:p@a/b", "https://a/b?x=1", "not an address"):
        with pytest.raises(ValueError):
            requests.Store(base, "scans")
    assert (requests.Store("HTTP://Host/x%20y/", "b").host, requests.Store("http://h", "b").port, requests.Store("http://h/x%20y/", "b").path) == ("host", 80, "x y")


def test_fetched_objects_have_errors(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    for name, data in (("a", b"xyz"), ("b", b""), ("c", b"x" * 50)):
        (tmp_path / "documents" / name).write_bytes(data)
    want = spark.createDataFrame([(f"documents/{n}",) for n in "abcd"], "key string")
    got = {r["key"][-1]: (bytes(r["content"]) if r["content"] is not None else None, r["error"]) for r in requests.fetched_pages(want, spark, str(tmp_path), 10).collect()}
    assert got == {"a": (b"xyz", None), "b": (None, "not found or empty"), "c": (None, "too large"), "d": (None, "not found or empty")}


def test_broken_streams_are_told(spark):
    rows = [("a", 0, '{"message": {"content": "x"}}'), ("a", 1, '{"done": true, "done_reason": "stop"}'), ("b", 0, "{"), ("c", 0, '{"error": "busy"}'), ("d", 0, '{"message": {"content": "y"}}'), ("e", 0, '{"done": true, "done_reason": "length"}')]
    got = {r["r"]: (r["content"], r["verdict"]) for r in requests.streamed_answers(spark.createDataFrame(rows, "r string, i int, line string"), ["r"], "i", "line").collect()}
    assert got == {"a": ("x", "ok"), "b": ("", "invalid"), "c": ("", "error"), "d": ("y", "unfinished"), "e": ("", "length")}


def test_artifacts_are_replaced_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    row = lambda d, k: (d, f"documents/{d}/{k}", "x")
    frame = lambda rows: spark.createDataFrame(rows, "doc string, key string, content string")
    publish.write_artifacts(frame([row("a", "1"), row("a", "2"), row("b", "1")]), folder, "doc")
    publish.write_artifacts(frame([row("a", "3"), row("..", "4")]), folder, "doc")
    assert sorted(r["key"] for r in spark.read.parquet(folder).collect()) == ["documents/a/3", "documents/b/1"]
    for bad in ("", "/", "x/../y"):
        with pytest.raises(ValueError):
            publish.write_artifacts(frame([row("a", "1")]), bad, "doc")


def test_pretty_json_keeps_order_nulls_and_letters(spark):
    df = spark.createDataFrame([("متن", None, 1.5)], "b string, a string, c double")
    said = df.select(publish.pretty_json(F.struct("b", "a", "c"))).first()[0]
    assert json.loads(said) == {"b": "متن", "a": None, "c": 1.5} and "متن" in said and said.endswith("}\n") and said.index('"b"') < said.index('"a"')


def test_callbacks_are_tried_again_and_never_raise(spark):
    calls, waits = [], []

    def send(payload, headers):
        calls.append((payload["job_id"], headers.get("Authorization")))
        if payload["job_id"] == 2 or len(calls) == 1:
            raise OSError("down")

    got = jobs.deliver(spark.createDataFrame([(1, "completed"), (2, "failed")], "job_id long, status string").orderBy("job_id"), send, "key", 3, waits.append)
    assert got == [(1, True, None), (2, False, "OSError: down")] and [c[0] for c in calls] == [1, 1, 2, 2, 2] and waits == [1, 1, 2] and calls[0][1] == "Bearer key"


def test_module_selection_and_invariants(spark):
    pages = spark.createDataFrame([(1, 1)], "doc_id int, page int")
    results = spark.createDataFrame([(1, 1, "ocr", "success", ["w"], 0)], "doc_id int, page int, module string, state string, warnings array<string>, n_objects int")
    got = adapters.page_modules(pages, results, ["doc_id", "page"], ("stamp_signature", "ocr")).first()
    assert (got["state"], got["warnings"]) == ("partial_success", ["w", "no_text_detected", "stamp_signature_failed"])
    with pytest.raises(ValueError):
        adapters.page_modules(pages, results, ["doc_id", "page"], ())
    bad = [(0.0, 0.0, 1.0, 1.0, 0.5), (-1.0, 0.0, 1.0, 1.0, 0.5), (2.0, 0.0, 1.0, 1.0, 0.5), (0.0, 0.0, 1.0, 1.0, float("nan"))]
    df = spark.createDataFrame(bad, "x1 double, y1 double, x2 double, y2 double, confidence double")
    assert [r[0] for r in df.select(adapters.object_verdict({c: F.col(c) for c in df.columns})).collect()] == ["ok", "negative", "order", "confidence"]


def test_small_names(spark):
    assert one(spark, names.safe_component(F.col("t"), "page"), t="DOC/100 _") == "DOC_100" and one(spark, names.safe_component(F.col("t"), "page"), t="..") == "page"
    assert one(spark, names.label_set(F.col("t")), t=" Table, chart,,table ") == ["chart", "table"]
    assert one(spark, names.shown_html(names.shown_text(F.col("t"), F.lit("raw"))), t='a  <b> & "c"\nd') == "a &lt;b&gt; &amp; &quot;c&quot;<br>d"


