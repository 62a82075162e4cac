"""The training-data operators against brute force, and on nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from quirefold.llm import common, fm_index, jaccard_join, katz, license_scan, mixing, pii, quality, substring_dedup, tiff, toxicity

LOWER = str.maketrans({c: c.lower() for c in common.UPPER})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))


def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, one id with two texts, columns with clashing names."""
    rows = [
        (1, None, None), (2, "", "a"), (3, "   \n ", "a"), (None, "some words without an id", None), (4, LONG, "a"), (5, LONG, "b"), (6, "All Rights RESERVED, cc-by! mail a@b.co", "b"),
        (6, "All Rights RESERVED, cc-by! mail a@b.co", "b"), (7, "one", "c"), (8, "été 12 \x00 naïve " + LONG[:3000], "c"), (9, "first text of nine", "a"), (9, "second text of nine", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    extras = {c: F.lit(5) for c in ("h", "n", "words", "pos", "rk", "label", "gram", "spans", "base", "score", "size", "fold", "chunk", "kind", "rep", "path")}
    return df.withColumns(extras)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)] + [(None, 1, None), (3, None, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([("b", "Rights reserved, CC"), ("a", None), ("c", ""), ("d", " ".join(LONG.split()[100:115])), ("d2", " ".join(LONG.split()[100:115])), (None, "some words")], "item_id string, text string")


RUNS = {
    "licenses": lambda s, d: license_scan.scan_licenses(d),
    "substrings": lambda s, d: substring_dedup.dedup_substrings(d),
    "contamination": lambda s, d: fm_index.find_contamination(d, benchmark(s)),
    "mix": lambda s, d: mixing.mix_sources(d),
    "pii": lambda s, d: pii.pii_digest(d),
    "quality": lambda s, d: quality.score_quality(d, labels(s)),
    "copies": lambda s, d: jaccard_join.near_duplicates(d),
    "katz": lambda s, d: katz.katz_scores(d),
    "media": lambda s, d: tiff.text_media(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_all_come_back(spark, name):
    docs = odd(spark)
    got = collections.Counter(r["doc_id"] for r in RUNS[name](spark, docs).collect())
    assert got == collections.Counter(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, odd(spark).limit(0)).count() == 0


def docs_of(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d, d.collect()


def test_licenses_on_odd_rows(spark):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(odd(spark)).collect()}
    assert (got[6]["n_words"], got[6]["n_base"], got[6]["first_word"], got[6]["last_word"], got[6]["base_labels"]) == (9, 2, 0, 3, "cc-by,reserved")
    assert got[1]["n_words"] == 0 and got[1]["first_word"] is None and got[1]["labels"] == ""


def test_license_template_with_inserted_words(spark):
    text = "x " + license_scan.TEMPLATES[0][1].replace("any person", "any other person") + " y"
    r = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == "mit" and 0.75 <= r["score"] < 1 and r["n_base"] == 0


def test_substrings_against_brute_force(spark, sf_dir):
    d, rows = docs_of(spark, sf_dir)
    first, words = {}, {r["doc_id"]: SPACED.findall(r["text"] or "") for r in rows}
    for i in sorted(words):
        w = words[i]
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for r in substring_dedup.dedup_substrings(d).collect():
        w, gone = words[r["doc_id"]], set()
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < r["doc_id"]:
                gone.update(range(j, j + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("pairs", [100_000, 40])
def test_contamination_against_brute_force(spark, sf_dir, pairs):
    d, rows = docs_of(spark, sf_dir)
    windows = collections.defaultdict(set)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for r in bench.collect():
        w = ALNUM.findall(r["text"].translate(LOWER))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(r["item_id"]))
    sizes = {len(k) for k in windows}
    got = {r["doc_id"]: r for r in fm_index.contamination_digest(fm_index.find_contamination(d, bench, block_pairs=pairs)).collect()}
    for r in rows:
        w, hit, items = ALNUM.findall((r["text"] or "").translate(LOWER)), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if k := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    items |= k
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"]) == (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())


def test_suffix_order_and_wavelet():
    rng = np.random.default_rng(0)
    x = np.append(rng.integers(1, 4, 300), 0)
    order = fm_index.sort_suffixes(x)
    assert order.tolist() == sorted(range(301), key=lambda i: x[i:].tolist())
    w = fm_index.Wavelet(x, 4)
    c, i = rng.integers(0, 4, 50), rng.integers(0, 302, 50)
    assert w.rank(c, i)[0].tolist() == [int((x[:k] == s).sum()) for s, k in zip(c, i, strict=True)]


def test_mix_nears_targets(spark, sf_dir):
    d, _ = docs_of(spark, sf_dir)
    m = mixing.mix_sources(d).join(d.select("doc_id", "source"), "doc_id").toPandas()
    by = m.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert abs(by["target"].sum() - by["size"].sum()) < 1e-6 * by["size"].sum()
    assert ((by["taken"] - by["target"]).abs() <= by["largest"]).all() and (by["target"] <= 3 * by["size"] + 1e-9).all()
    assert (m["taken"] <= 3 * m["size"]).all()
    again = mixing.mix_sources(d.repartition(7)).toPandas()
    assert dict(zip(again["doc_id"], again["taken"], strict=True)) == dict(zip(m["doc_id"], m["taken"], strict=True))


def test_mix_reshares_what_is_above_the_cap(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1000, "a"), (10, "b"), (1000, "c")])]
    t = {r["doc_id"]: r["target"] for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert t[1] == 30 and abs(t[0] - 1980 / 4) < 1e-9 and abs(t[2] - 1980 * 3 / 4) < 1e-9


def test_reduction_tree_has_more_levels(spark):
    rows = [(i, "w " * (1 + i % 9), "a" if i % 3 else "b") for i in range(400)]
    m = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), group=16).toPandas()
    by = m.groupby("target")["taken"].sum()
    assert (abs(by - by.index) <= 10).all() and len(m) == 400


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_pii(text):
    out = []
    for k, (kind, rx) in enumerate(PII.items()):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (12 <= len(d) <= 19 and luhn)) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_against_patterns(spark, sf_dir):
    d, rows = docs_of(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] or "" for r in rows} | {-1: "a@b.c%x@d.e ..x@y..z u@v.w.", -2: "1.2.3.4.5.6.7.8 256.1.1.1", -3: "4111  1111-1111 1111 4111-1111-1111-1111 2", -4: "é+1 (437) 555-0689) +12", -5: "x" * 3000 + "1" * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in pii.pii_digest(df).collect():
        want = base_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (r["doc_id"], want, r["spans"])
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_redaction(spark):
    r = pii.redact(spark.createDataFrame([(1, "é a@b.co now +1 (437) 555-0689 x"), (2, None), (3, "clean")], "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["text"] for x in r} == {1: "é [EMAIL] now [PHONE] x", 2: None, 3: "clean"}


def test_boosting_separates_counts():
    counts = [(b, 90.0 if b & 1 and b & 4 else 2.0, 1.0 if b & 1 and b & 4 else 50.0) for b in range(8)]
    _, _, score = pii.boost(counts)
    least = pii.threshold(counts, score, 0.9)
    assert {b for b in score if score[b] >= least} == {5, 7}


def test_quality_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    q = quality.score_quality(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    assert (q["predicted"] == q["quality"]).mean() > 0.93
    t = toxicity.score_toxicity(d, lab.where("doc_id % 3 <> 0")).withColumnRenamed("toxic", "said").join(lab.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert (t["said"] == (t["toxic"] == 1)).mean() > 0.92 and t["severity"].between(0, 3).all()


def test_near_duplicates_against_brute_force(spark, sf_dir):
    d, rows = docs_of(spark, sf_dir)
    base = [(r["doc_id"], r["text"]) for r in rows]
    w = LONG.split()[:400]
    base += [(100_000 + i, " ".join(w[:-1] + [f"end{i}"])) for i in range(40)] + [(200_000, " ".join(w[:200])), (200_001, " ".join(w[:220])), (200_002, " ".join(w[:150]))]
    sets, ids = collections.defaultdict(list), {}
    for i, t in base:
        x = ALNUM.findall((t or "").translate(LOWER))
        s = frozenset(tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))) if x else i
        sets[s].append(i)
        ids[i] = s
    keys = [s for s in sets if isinstance(s, frozenset)]
    links = collections.Counter()
    parent = {s: s for s in sets}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if both and both >= 0.8 * (len(keys[a]) + len(keys[b]) - both) - 1e-9:
                links[keys[a]] += 1
                links[keys[b]] += 1
                parent[root(keys[a])] = root(keys[b])
    least = {}
    for s, members in sets.items():
        least[root(s)] = min(least.get(root(s), 1 << 60), *members)
    df = spark.createDataFrame(base, "doc_id long, text string")
    for r in jaccard_join.near_duplicates(df).collect():
        assert (r["class_id"], r["n_links"]) == (least[root(ids[r["doc_id"]])], links[ids[r["doc_id"]]])


def brute_links(texts):
    """{id: (class, links)} of texts with distinct gram sets, by all pairs."""
    sets = {}
    for i, text in texts:
        x = ALNUM.findall(text.translate(LOWER))
        sets[i] = frozenset(tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4)))
    links, root = collections.Counter(), {i: i for i in sets}
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root[i], root[j]))
                root = {x: a if r == b else r for x, r in root.items()}
    return {i: (root[i], links[i]) for i in ids}


@pytest.mark.parametrize("block", [8, 1024])
def test_large_components_keep_all_links(spark, monkeypatch, block):
    """Tight copies, copies at some distance, a chain away from the centre and texts that share only a passage."""
    rng, w = np.random.default_rng(3), LONG.split()[:300]
    texts = [(i, " ".join(w[:-1] + [f"end{i}"])) for i in range(30)]
    for i in range(30, 70):
        v = list(w)
        for at in rng.choice(300, i % 9, replace=False):
            v[at] = f"new{i}x{at}"
        texts.append((i, " ".join([*v, f"tail{i}"])))
    texts += [(100 + i, " ".join(w[8 * i :] + [f"more{j}" for j in range(8 * i)])) for i in range(12)]
    texts += [(200 + i, " ".join(w[:150] + [f"own{i}x{j}" for j in range(150)])) for i in range(40)]
    want = brute_links(texts)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join.verified_links, "__defaults__", (5, 0.8, block, 1 << 21))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == want


@pytest.mark.parametrize("parts", [1, 4])
def test_rows_of_one_id_are_judged_by_their_text(spark, parts):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (5, a + " plus"), (2, a), (2, b), (3, a), (3, a), (4, "alone"), (4, "alone"), (None, a), (6, ""), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_grams"]) for r in jaccard_join.near_duplicates(df).collect())
    assert got == collections.Counter([(1, 1, 1, 56), (1, 1, 0, 56), (5, 1, 1, 57), (2, 1, 1, 56), (2, 1, 0, 56), (3, 1, 1, 56), (3, 1, 1, 56), (4, 4, 0, 1), (4, 4, 0, 1), (None, None, 0, 0), (6, 6, 0, 0), (6, 6, 0, 0)])
    kept = collections.Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one_of_each(df).collect())
    assert kept == collections.Counter([(1, a), (1, b), (4, "alone"), (None, a), (6, ""), (6, "")])


def test_marks_miss_no_key(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(3000)] + [(None, "y")], "k long, other string")
    keys = rows.where("k % 7 = 0").select(rows["k"].alias("doc"))
    got = {r["k"]: r["marked"] for r in common.marked(rows, "k", keys).collect()}
    assert all(got[i] for i in range(0, 3000, 7)) and sum(v for v in got.values()) < 440 and not got[None]


def test_contained_copies_are_candidates_with_the_stated_recall(spark):
    rng, rows = np.random.default_rng(5), []
    low = lambda grams: [int(x) for x in np.sort(grams)[: jaccard_join.SAMPLE].view(np.int64)]
    passage = rng.integers(0, 2**64, 250, dtype=np.uint64)
    for i in range(4000):
        grams = rng.integers(0, 2**64, 500, dtype=np.uint64)
        if i % 2:
            grams[:250] = passage  # half of the set is common to many
        rows += [(2 * i, low(grams)), (2 * i + 1, low(grams[:400]))]  # one holds the other, similarity 0.8
    edges = jaccard_join.candidate_edges(spark.createDataFrame(rows, "sid long, sample array<long>"))
    of = {r["node"]: r["comp"] for r in jaccard_join.components(edges).collect()}  # whole components are verified
    lost = [i for i in range(4000) if of.get(2 * i, -1) != of.get(2 * i + 1)]
    assert len(lost) <= 2
    assert jaccard_join.missed(jaccard_join.runs_for(0.9999), jaccard_join.loose_share(0.9999)) <= 1e-4


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_is_normalised_and_adds_up(spark, sf_dir, order):
    import math

    d, rows = docs_of(spark, sf_dir)
    texts = {r["doc_id"]: [*SPACED.findall((r["text"] or "").translate(LOWER)), "</s>"] for r in rows}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    count = [collections.Counter() for _ in range(order)]
    for i in train:
        t = ["<s>", *texts[i]]
        for k in range(order):
            count[k].update(tuple(t[j - k : j + 1]) for j in range(max(k, 1), len(t)))
    total = sum(count[0].values())
    stats = [total, len(count[0]), *[sum(v == c for v in n.values()) for n in count for c in range(1, 7)]]
    m = katz.KatzModel(np.array(stats, dtype=float))
    left = lambda c, k: (m.d[k][c] * c if c < len(m.d[k]) else c - katz.TAIL)
    n_of = lambda g: count[0][("</s>",)] if g == ("<s>",) else count[len(g) - 1][g]
    after = collections.defaultdict(list)
    for n in count[1:]:
        for g in n:
            after[g[:-1]].append(g[-1])
    weights = {}

    def p(g):
        k = len(g) - 1
        if k == 0:
            return left(count[0][g], 0) / total if count[0][g] else m.unknown
        if count[k][g]:
            return left(count[k][g], k) / n_of(g[:-1])
        return alpha(g[:-1]) * p(g[1:])

    def alpha(h):
        if h not in weights:
            ws = after[h]
            weights[h] = sum(count[len(h)][(*h, w)] - left(count[len(h)][(*h, w)], len(h)) for w in ws) / n_of(h) / (1 - sum(p((*h[1:], w)) for w in ws)) if n_of(h) else 1.0
        return weights[h]

    for h in [("<s>",), *[g for g in list(after) if len(g) == order - 1][:3]] if order > 1 else [()]:
        whole = sum(p((*h, w[0])) for w in count[0]) + p((*h, "never seen"))
        assert abs(whole - 1) < 1e-9
    for r in katz.katz_scores(d, order=order).collect():
        t = ["<s>", *texts[r["doc_id"]]]
        s = sum(math.log10(p(tuple(t[max(0, j - order + 1) : j + 1] if order > 1 else t[j : j + 1]))) for j in range(1, len(t)))
        b = sum(math.log10((count[0][w,] + 1) / (total + len(count[0]) + 1)) for w in t[1:])
        assert r["n_tokens"] == len(t) - 1 and r["n_known"] == sum(count[0][w,] > 0 for w in t[1:]) and r["train_tokens"] == total
        assert abs(r["score"] - s) < 1e-6 * max(1, abs(s)) and abs(r["base_score"] - b) < 1e-6 * max(1, abs(b))


def test_katz_scores_do_not_depend_on_file_splits(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: r for r in katz.katz_scores(docs).collect()}
    monkeypatch.setattr(katz, "CHUNK_BYTES", 1 << 17)
    conf = {"parquet.block.size": "65536", "spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1024", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r for r in katz.katz_scores(docs.repartition(3)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (w["n_tokens"], w["n_known"], w["train_tokens"])
        assert abs(got[i]["score"] - w["score"]) < 1e-6 * max(1, abs(w["score"]))


def test_katz_chunks_of_one_empty_text(spark, monkeypatch):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = spark.createDataFrame([(i, None if i in held[:2] else "a b a c" if i % 2 else "b") for i in range(60)], "doc_id long, text string")
    want = sorted(map(tuple, katz.katz_scores(docs).collect()))
    monkeypatch.setattr(katz, "CHUNK_BYTES", 1)
    got = sorted(map(tuple, katz.katz_scores(docs.repartition(3)).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want] and all(abs(g[6] - w[6]) < 1e-9 for g, w in zip(got, want, strict=True))
    assert sum(r[1] for r in got) == len(held)


@pytest.mark.parametrize("how", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(how, tile, predictor):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 4, (50, 37), dtype=np.uint8), rng.integers(0, 255, (70, 90, 3), dtype=np.uint8), np.zeros((300, 200), dtype=np.uint8)]
    got = [p for p, _ in tiff.read_tiff(tiff.write_tiff(pages, how, predictor, 16, tile))]
    assert [np.squeeze(g).tolist() for g in got] == [p.tolist() for p in pages]


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_of_other_depths_and_planes(order):
    """Files written here by hand: 1-bit, 16-bit with differencing, and two planes."""
    import struct

    def file(w, h, bits, samples, strips, predictor=1, planar=1):
        out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))
        at = []
        for x in strips:
            at.append(len(out))
            out += x
        fields = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * samples), (259, 3, [1]), (273, 4, at), (277, 3, [samples]), (278, 4, [h]), (279, 4, [len(x) for x in strips]), (284, 3, [planar]), (317, 3, [predictor])]
        entries = b""
        for tag, kind, v in fields:
            raw = struct.pack(order + f"{len(v)}{ {3: 'H', 4: 'I'}[kind] }", *v)
            if len(raw) > 4:
                place, raw = struct.pack(order + "I", len(out)), out.extend(raw)
                raw = place
            entries += struct.pack(order + "HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, 4, len(out))
        return bytes(out + struct.pack(order + "H", len(fields)) + entries + bytes(4))

    rng = np.random.default_rng(4)
    one = rng.integers(0, 2, (5, 11), dtype=np.uint8)
    (got, how), = tiff.read_tiff(file(11, 5, 1, 1, [np.packbits(one, axis=1).tobytes()]))
    assert how["bits"] == 1 and got[:, :, 0].tolist() == one.tolist()
    deep = rng.integers(0, 65536, (4, 6, 2)).astype(np.uint16)
    change = np.concatenate([deep[:, :1], deep[:, 1:] - deep[:, :-1]], axis=1).astype(order + "u2")
    (got, how), = tiff.read_tiff(file(6, 4, 16, 2, [change.tobytes()], predictor=2))
    assert how["bits"] == 16 and got.tolist() == deep.tolist()
    flat = rng.integers(0, 256, (3, 7, 2), dtype=np.uint8)
    (got, _), = tiff.read_tiff(file(7, 3, 8, 2, [flat[:, :, i].tobytes() for i in (0, 1)], planar=2))
    assert got.tolist() == flat.tolist()


def test_media_of_documents_against_plain_code(spark):
    """Contract columns of every document of sf0.01; all three ways of storing occur."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ways = set()
    for r in tiff.text_media(docs).collect():
        raw = texts[r["doc_id"]].encode()
        want = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        media = tiff.payload_tiff(want)
        ways.add(next(tiff.read_tiff(media))[1]["compression"])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert ways == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE}


def test_targets_of_documents_against_plain_code(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["source"], len(SPACED.findall(r["text"] or ""))) for r in docs.collect()]
    size = collections.Counter()
    for _, s, n in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, open_ = {s: 1 + i % 3 for i, s in enumerate(names)}, {}, set(names)
    while open_:
        left, heavy = sum(size.values()) - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / heavy > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in full} or {s: left * weight[s] / heavy for s in open_}
        open_ = open_ - full if full else set()
    want = {i: (n, size[s], target[s]) for i, s, n in rows}
    for r in mixing.mix_sources(docs).collect():
        n, total, goal = want[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, total) and abs(r["target"] - goal) < 1e-6 * max(1, goal)


def test_license_between_repeated_words(spark):
    texts = {1: "under the " * 6 + "licensed under the mit license", 2: "any kind " * 5 + license_scan.TEMPLATES[-1][1] + " or implied" * 5, 3: "under the " * 9}
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    import duckdb
    import pandas as pd

    con, documents = duckdb.connect(), pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())})  # noqa: F841
    con.register("documents", documents)
    assert {r[0]: r[1:] for r in con.execute(license_scan.oracle()).fetchall()} == {i: tuple(r)[1:] for i, r in got.items()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0 and got[2]["labels"] == "warranty" and got[2]["score"] == 1.0 and got[3]["labels"] == ""


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", "b", "s", "t")], "doc_id long, text string, base string, spans string, _t string")
    assert pii.redact(df).collect()[0].asDict() == {"doc_id": 1, "text": "mail [EMAIL]", "base": "b", "spans": "s", "_t": "t"}
    assert pii.find_pii(df).columns == ["doc_id", "text", "_t", "base", "spans"]


def test_damaged_files_give_errors(spark):
    good = tiff.write_tiff([np.zeros((4, 4), dtype=np.uint8)])
    tag = lambda n, v: n.to_bytes(2, "little") + b"\x04\0\x01\0\0\0" + v.to_bytes(4, "little")
    no_rows, vast = good.replace(tag(278, 64), tag(278, 0)), good.replace(tag(256, 4), tag(256, 1 << 31)).replace(tag(257, 4), tag(257, 1 << 31))
    assert good not in (no_rows, vast)
    df = spark.createDataFrame([(1, good), (2, good[:20]), (3, None), (4, b"GIF89a"), (5, no_rows), (6, vast)], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in tiff.tiff_pages(df).collect()}
    assert got[1]["pixels"] == bytes(16) and all(got[i]["error"] for i in (2, 3, 4, 5, 6))


def test_media_read_back(spark):
    for r in tiff.text_media(odd(spark)).collect():
        assert r["payload_bytes"] % 576 == 0 and r["payload_bytes"] > 0
    r = tiff.text_media(spark.createDataFrame([(1, "é")], "doc_id long, text string")).first()
    want = "é".encode() + b"\xff" * 574
    assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (2, hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))


def test_pipeline_stages_act(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    classes = {r["doc_id"]: r["class_id"] for r in jaccard_join.near_duplicates(docs).collect()}
    kept = {r["doc_id"] for r in cp.near_duplicate_stage(spark, docs, sf).collect()}
    assert kept == set(classes.values())
    clean = common.stage(cp.decontamination_stage(spark, docs, sf), "clean")
    again = fm_index.find_contamination(clean, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert clean.columns == docs.columns and clean.count() == docs.count() and again.where("size(spans) > 0").count() == 0
    assert pii.pii_digest(common.stage(cp.pii_stage(spark, docs, sf), "redacted")).where("n_email + n_ip + n_card + n_phone > 0").count() == 0


def test_repeated_license_lines_keep_their_label(spark):
    line = "creative commons attribution sharealike"
    docs = spark.createDataFrame([(n, "\n".join([line] * n)) for n in (1, 3, 4, 50)] + [(90, "creative commons " * 40)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(docs).collect()}
    assert all("cc-by-sa" in got[n][0].split(",") and got[n][1] == 1.0 for n in (1, 3, 4, 50)) and "cc-by-sa" not in got[90][0].split(",")


def test_items_without_an_id_hit(spark):
    passage = " ".join(f"secret{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (5, "five " + " ".join(f"other{i}" for i in range(20)))], "item_id long, text string")
    got = {r["doc_id"]: r for r in fm_index.find_contamination(docs, bench, with_text=True).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(1, 21)] and got[1]["items"] == [] and got[1]["text"].split() == ["before", "after"]
    assert not got[2]["spans"]


def test_rows_of_one_id_are_spread_over_groups(spark, monkeypatch):
    rows = [(None, f"word {i} " + "x " * (i % 9), "a") for i in range(600)] + [(7, "the same row", "a")] * 600
    docs, most, level = spark.createDataFrame(rows, "doc_id long, text string, source string"), [], mixing._round_level
    spy = lambda r, last, seed: (most.append(r.groupBy("source_rank", "grp").count().agg({"count": "max"}).first()[0]), level(r, last, seed))[1]
    monkeypatch.setattr(mixing, "_round_level", spy)
    got = mixing.mix_sources(docs, group=100).collect()
    assert most[0] <= 200 and collections.Counter(r["doc_id"] for r in got) == {None: 600, 7: 600}
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= max(r["size"] for r in got)
