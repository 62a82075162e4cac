"""N-gram Jaccard join by chosen paths.

Texts become sets of five-word grams; rows with equal sets are one set from the start. Each set keeps its 64 least gram
hashes as a sample. In every run a set walks down the paths of the few sampled grams that the run chooses; sets on one path
share those grams. Small buckets are compared all against all, but for pairs whose sizes alone rule the threshold out. A large bucket is compared with its leader; sets much like
the leader leave it, and the rest is split on grams it does not share with the leader, so that a passage common to the
bucket does not hold it together. Buckets within one component of the links found so far have nothing to add and end. Runs
repeat until the target recall is met.

Candidate links, checked on the samples, give loose components, which are verified on whole sets. In a large component
every set's distance to the component's centre (the grams that most of its sets hold) is measured first. Jaccard distance is
a metric: two sets near the centre are linked without a comparison, two at very different distances are not linked, and only
blocks between which that leaves doubt are compared. So a group of near copies costs its size, not the square of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, by_size, gram_hashes, marked, mix64, row_key, stage, text_buffers, unstage

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
SAMPLE = 64
SMALL = 24
DEPTH = 8
SPREAD = 3
BLOCK = 1024
BLOCK_GRAMS = 2 << 20
HEAT = 2048
ABSORB = 0.9
UNITS = 100
_U = np.uint64


def _overlaps(threshold: float, sample: int) -> list[float]:
    """Probabilities of 0, 1, ... shared sample hashes for a set at the threshold and one it is held in, the hardest case."""
    return [math.comb(sample, n) * threshold**n * (1 - threshold) ** (sample - n) for n in range(sample + 1)]


def loose_share(recall: float, threshold: float = THRESHOLD, sample: int = SAMPLE) -> float:
    """Bound of the check on samples: it drops at most a tenth of the pairs at the threshold that may be missed."""
    p = _overlaps(threshold, sample)
    return max(n for n in range(sample + 1) if sum(p[:n]) <= (1 - recall) / 10) / sample


def missed(runs: int, loose: float, threshold: float = THRESHOLD, sample: int = SAMPLE) -> float:
    """Probability that a pair at the threshold is dropped by the check on samples, or never meets on a first path.

    A run chooses each gram with probability 1 / (threshold * sample), so a pair meets about once a run.
    """
    chosen = 1 / (threshold * sample)
    return sum(p * (1.0 if n < loose * sample else (1 - chosen) ** (n * runs)) for n, p in enumerate(_overlaps(threshold, sample)))


def steps(share: Column, paths: Column, runs: int, loose: float, threshold: float = THRESHOLD) -> Column:
    """How many grams a set goes on along that shares `share` of its sample with the leader of a large bucket.

    About that share of the set's first paths leads to this leader, so that part of the recall rests on it: of `runs` meetings
    a pair at the threshold has in all, share * runs must be made up for by grams outside the leader, of which the pair shares
    (threshold - share) / (1 - share) at least. Two sets linked to the leader are one component and need no path; a linked
    set goes on as one just not linked would, to meet such a one. Further down, where few of the set's paths still lead to a
    leader, SPREAD grams for each do.
    """
    part = F.least(share, F.lit(loose))
    return F.least(part * runs * (1 - part) / (threshold - part), paths * SPREAD)


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold has met on a first path with the wanted probability, the check counted."""
    loose = loose_share(recall, threshold)
    return next(r for r in range(1, 1000) if missed(r, loose, threshold) <= 1 - recall)


def gram_sets(w: Words, k: int = GRAM) -> Iterator[np.ndarray]:
    """Sorted distinct gram hashes of each document; fewer than k words make one gram, none makes none."""
    grams, ok = gram_hashes(w.hashes, k), w.window_ok(k)
    for d in range(len(w.first) - 1):
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        if hi - lo >= k:
            yield np.unique(mix64(grams[lo : hi - k + 1]))
        elif hi > lo:
            yield mix64(gram_hashes(w.hashes[lo:hi], hi - lo, salt=hi - lo))
        else:
            yield np.empty(0, dtype=_U)


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    with np.errstate(over="ignore"):
        return int(np.sum(s * _U(0x9E3779B97F4A7C15), dtype=_U).view(np.int64)), int(np.sum(mix64(s ^ _U(7)), dtype=_U).view(np.int64))


def sketches(docs: DataFrame, k: int = GRAM, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, rk, n, f1, f2, sample): row key, size of the set, two 64-bit sums that tell sets apart, and its least grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            n, f1, f2, low = [], [], [], []
            for s in gram_sets(Words(*text_buffers(b.column(1)), "alnum"), k):
                x, y = _sums(s)
                n.append(len(s))
                f1.append(x)
                f2.append(y)
                low.append(s[:sample].view(np.int64))
            cut = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
            flat = pa.array(np.concatenate(low) if low else np.empty(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(cut), flat)], ["doc_id", "rk", "n", "f1", "f2", "sample"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    return rows.mapInArrow(run, "doc_id long, rk long, n long, f1 long, f2 long, sample array<long>")


def set_id() -> Column:
    return F.xxhash64("f1", "f2", "n")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, comp), comp the least node. Least labels spread and are followed through."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        heard = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        new = label.join(heard, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("mid"))
        ends = label.select(F.col("node").alias("mid"), F.col("comp").alias("end"))
        new = stage(new.join(ends, "mid").select("node", "old", F.least("mid", "end").alias("comp")), "labels")
        moved = new.where("old <> comp").limit(1).count()
        unstage(label)
        label = new
        if not moved:
            unstage(both)
            return label.select("node", "comp")


def candidate_edges(sets: DataFrame, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """Loosely checked links (a, b) between sets (sid, sample, n if known); holds every pair at the threshold with about probability `recall`.

    Sets of a small bucket are paired in order of size, each with those whose size is at most its own / THRESHOLD: beyond
    that even a set that holds the other is less alike, so no link is lost. Where n is not given, the sample's size bounds it.
    """
    runs, loose = runs_for(recall), loose_share(recall)
    within = lambda h, of: F.pmod(h, F.lit(1 << 20)) * of < F.lit(1 << 20)
    first = F.flatten(
        F.array(*[F.transform(F.filter("sample", lambda t: within(F.xxhash64(t, F.lit(r)), F.size("sample") * THRESHOLD)), lambda t: F.xxhash64(t, F.lit(r), F.lit(0))) for r in range(runs)])
    )
    size = (F.col("n").cast("int") if "n" in sets.columns else F.size("sample")).alias("size")
    rows = stage(sets.select("sid", size, F.explode(first).alias("path")), "paths")
    halved = lambda xs: F.transform(xs, lambda t: F.shiftright(t, 32).cast("int"))
    whole = sets.select("sid", size, halved("sample").alias("s"))
    used, pairs, edges = [], None, None
    for level in range(depth):
        label = "label" if level else "sid"
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.min("sid").alias("leader"), F.min(label).alias("lo"), F.max(label).alias("hi"))
        sizes = sizes.where("lo < hi").drop("lo", "hi")
        full = stage(rows.join(sizes, "path"), "full")
        unstage(rows)
        used.append(full)
        lists = full.where(F.col("m") <= small).groupBy("path").agg(F.array_sort(F.collect_set(F.struct("size", "sid"))).alias("r"))
        partners = F.filter(F.slice("r", F.col("i") + 2, F.size("r")), lambda x: x["size"] * F.lit(THRESHOLD) <= F.col("x.size") + 1e-6)
        halves = lists.select("r", F.posexplode("r").alias("i", "x")).select(F.col("x.sid").alias("a"), F.explode(partners).alias("y")).select("a", F.col("y.sid").alias("b"))
        pairs = halves if pairs is None else pairs.unionByName(halves)
        large = full.where((F.col("m") > small) & (F.col("sid") != F.col("leader")))
        if not large.limit(1).count():
            break
        # one comparison for a set and leader, whatever the number of paths they share; samples are joined once per set, and
        # a leader of many sets is copied per HEAT sets
        heat = F.ceil(F.col("m") / HEAT).cast("int")
        led = large.groupBy("leader").agg(F.max(heat).alias("copies")).join(whole.select(F.col("sid").alias("leader"), F.col("s").alias("ls")), "leader")
        led = led.select("leader", "ls", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
        asked = large.groupBy("sid", "leader").agg(F.max(heat).alias("copies"), F.count(F.lit(1)).alias("paths")).join(whole, "sid")
        asked = asked.select("leader", "sid", "size", "s", "paths", F.pmod(F.xxhash64("sid"), F.col("copies")).cast("int").alias("salt"))
        met = asked.join(led, ["leader", "salt"]).select("leader", "sid", "size", "paths", F.array_except("s", "ls").alias("own"), F.size("s").alias("n"), F.size("ls").alias("ln"))
        share = (F.col("n") - F.size("own")) / F.least("n", "ln")
        # sets that stay in the bucket go on along grams that the leader does not hold
        chosen = F.filter("own", lambda t: within(F.xxhash64(t, F.col("leader")), F.size("own") / steps(share, F.col("paths"), runs, loose)))
        on = F.when(share < ABSORB, F.transform(chosen, lambda t: F.xxhash64(t, F.col("leader"))))
        met = stage(met.select("leader", "sid", "size", share.alias("share"), on.alias("next")), "met")
        used.append(met)
        last = level == depth - 1  # all that is left is linked with its leader; no paths follow
        close = met.where(F.col("share") >= (0.0 if last else loose)).select(F.col("leader").alias("a"), F.col("sid").alias("b"))
        edges = close if edges is None else edges.unionByName(close)
        if last:
            break
        labels = components(edges)
        rows = met.select("sid", "size", F.explode("next").alias("path")).join(labels, F.col("sid") == F.col("node"), "left")
        rows = stage(rows.select("sid", "size", "path", F.coalesce("comp", "sid").alias("label")), "paths")
    pairs = pairs.distinct()
    with_a = pairs.join(whole.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a")
    with_b = with_a.join(whole.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
    close = with_b.where(F.size(F.array_intersect("sa", "sb")) >= F.least(F.size("sa"), F.size("sb")) * loose).select("a", "b")
    out = stage(close if edges is None else close.unionByName(edges), "candidates")
    unstage(*used)
    return out


def _similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of a and b have Jaccard similarity of the threshold or more, by products of 0/1 matrices."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    token = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
    order = np.argsort(token)
    token, row = token[order], row[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    shared = ~(new & np.append(new[1:], True))
    col = np.cumsum(new)[shared]
    row = row[shared]
    col = np.cumsum(np.concatenate([[False], col[1:] != col[:-1]])) if len(col) else col
    both = np.zeros((len(a), len(b)), dtype=np.float32)
    width, at = 4096, 0
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        end = int(np.searchsorted(col, c + width))
        x = np.zeros((len(a) + len(b), width), dtype=np.float32)
        x[row[at:end], col[at:end] - c] = 1
        both += x[: len(a)] @ x[len(a) :].T
        at = end
    return both >= threshold * (na[:, None] + nb[None, :] - both) - 1e-6


def _links(ids: np.ndarray, sets: list[np.ndarray], near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least index reachable over links, and number of links, of each set."""
    root = np.arange(len(ids))
    while True:  # least index reached, row by row
        new = np.minimum(root, np.where(near, root[None, :], len(ids)).min(axis=1, initial=len(ids)))
        new = new[new]
        if (new == root).all():
            return root, near.sum(axis=1)
        root = new


def _all_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    if len(sets) > 6:
        near = _similar(sets, sets, threshold)
        np.fill_diagonal(near, False)
        return near
    near = np.zeros((len(sets), len(sets)), dtype=bool)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            near[i, j] = near[j, i] = both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-6
    return near


LINK_SCHEMA = "sid long, root long, links long"


def _small_components(rows: DataFrame, threshold: float) -> DataFrame:
    """Links inside components that one task compares whole; several of them, sorted, pass through a task."""

    def links(ids: list, sets: list) -> pa.RecordBatch:
        order = np.argsort(ids)
        ids, sets = np.array(ids, dtype=np.int64)[order], [sets[i] for i in order]
        root, n = _links(ids, sets, _all_links(sets, threshold))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root]), pa.array(n.astype(np.int64))], ["sid", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for b in batches:
            for comp, sid, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if comp != now:
                    if ids:
                        yield links(ids, sets)
                    now, ids, sets = comp, [], []
                ids.append(sid)
                sets.append(np.frombuffer(g.as_py(), dtype=_U))
        if ids:
            yield links(ids, sets)

    return rows.repartition("comp").sortWithinPartitions("comp").select("comp", "sid", "grams").mapInArrow(run, LINK_SCHEMA)


def _distances(rows: DataFrame) -> DataFrame:
    """(comp, sid, q): distance of each set of a large component to its centre, in whole UNITS, rounded down.

    The centre holds the grams that more than half of the sets hold; it is copied per part of the component.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            comps = b.column(0).to_numpy()
            for comp in np.unique(comps):
                held = [np.frombuffer(b.column(1)[int(i)].as_py(), dtype=_U) for i in np.flatnonzero(comps == comp)]
                gram, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), comp)), pa.array(gram.view(np.int64)), pa.array(n)], ["comp", "gram", "n"])

    counts = rows.select("comp", "grams").mapInArrow(tally, "comp long, gram long, n long").groupBy("comp", "gram").agg(F.sum("n").alias("held"))
    total = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.first("parts").alias("parts"))
    common = counts.join(total, "comp").where("2 * held > m")
    centres = total.join(common.groupBy(F.col("comp").alias("c")).agg(F.collect_list("gram").alias("centre")), F.col("comp") == F.col("c"), "left")
    centres = centres.select("comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.coalesce("centre", F.expr("CAST(array() AS array<long>)")).alias("centre"))
    centres = stage(centres, "centres")

    def far(sets: pa.Table, centre: pa.Table) -> pa.Table:
        c = np.sort(np.asarray(centre.column("centre")[0].as_py() if centre.num_rows else [], dtype=np.int64).view(_U))
        out = []
        for g in sets.column("grams"):
            s = np.frombuffer(g.as_py(), dtype=_U)
            at = np.minimum(np.searchsorted(c, s), max(len(c) - 1, 0))
            both = int((c[at] == s).sum()) if len(c) else 0
            out.append(min(UNITS - 1, int(UNITS * (1 - both / (len(s) + len(c) - both)))))
        return pa.table({"comp": sets.column("comp"), "sid": sets.column("sid"), "q": pa.array(out, pa.int32())})

    return rows.groupBy("comp", "part").cogroup(centres.groupBy("comp", "part")).applyInArrow(far, "comp long, sid long, q int")


def _large_components(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links inside components of many sets, block against block where distances to the centre leave doubt."""
    limit = round(UNITS * (1 - threshold))
    placed = stage(_distances(rows), "distances")
    rings = placed.groupBy("comp", "q").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
    blocked = stage(placed.join(rings, ["comp", "q"]).withColumn("cut", F.pmod(F.xxhash64("sid"), F.col("cuts")).cast("int")).drop("cuts"), "blocked")
    blocks = stage(blocked.groupBy("comp", "q", "cut").agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("least")), "blocks")
    other = blocks.select("comp", F.col("q").alias("oq"), F.col("cut").alias("ocut"), F.col("size").alias("osize"), F.col("least").alias("oleast"))
    met = blocks.join(other, "comp")  # a row per pair of blocks, not of sets
    sure, never = F.col("q") + F.col("oq") + 2 <= limit, F.abs(F.col("q") - F.col("oq")) - 1 >= limit
    known = met.where(sure).groupBy("comp", "q", "cut").agg(F.sum("osize").alias("links"), F.min_by("oleast", F.struct("oq", "ocut")).alias("root"))
    known = known.withColumn("links", F.col("links") - F.when(2 * F.col("q") + 2 <= limit, 1).otherwise(0))
    told = blocked.join(known, ["comp", "q", "cut"]).select("sid", "root", "links")
    # the sets nearest the centre are linked with one of each ring, so that what is sure hangs together
    inner = met.where(sure & (F.struct("oq", "ocut") > F.struct("q", "cut"))).select(F.col("least").alias("sid"), F.col("oleast").alias("root"), F.lit(0).cast("long").alias("links"))
    doubt = met.where(~sure & ~never).select("comp", "q", "cut", F.least(F.struct("q", "cut"), F.struct(F.col("oq").alias("q"), F.col("ocut").alias("cut"))).alias("x"), F.greatest(F.struct("q", "cut"), F.struct(F.col("oq").alias("q"), F.col("ocut").alias("cut"))).alias("y"))
    grams = rows.select(F.col("sid").alias("s2"), "grams")
    doubtful = blocked.join(doubt.select("comp", "q", "cut").distinct(), ["comp", "q", "cut"], "left_semi").join(grams, F.col("sid") == F.col("s2")).drop("s2")
    tasks = doubtful.join(doubt, ["comp", "q", "cut"]).select("comp", "x", "y", (F.struct("q", "cut") == F.col("x")).alias("left"), "sid", "grams")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid")
        ids, sets = pdf["sid"].to_numpy(), [np.frombuffer(g, dtype=_U) for g in pdf["grams"]]
        left = pdf["left"].to_numpy()
        if left.all():
            near = _all_links(sets, threshold)
        else:
            ia, ib = np.flatnonzero(left), np.flatnonzero(~left)
            near = np.zeros((len(ids), len(ids)), dtype=bool)
            near[np.ix_(ia, ib)] = _similar([sets[i] for i in ia], [sets[i] for i in ib], threshold)
            near |= near.T
        root, n = _links(ids, sets, near)
        return pd.DataFrame({"sid": ids, "root": ids[root], "links": n})

    return told.unionByName(inner).unionByName(tasks.groupBy("comp", "x", "y").applyInPandas(compare, LINK_SCHEMA))


def verified_links(docs: DataFrame, members: DataFrame, k: int = GRAM, threshold: float = THRESHOLD, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """All links inside loose components: (sid, root, links), rows of one sid to be added up.

    members: (sid, comp, n, doc_id), doc_id one that has the set. Only texts of members leave their task, found by a bitmap of
    fixed size. A component within `block` sets and `block_grams` grams is compared in one task, larger ones block by block.
    """
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    sizes = sizes.select("comp", F.ceil(F.greatest(F.col("m") / block, F.col("total") / block_grams)).cast("int").alias("parts"))
    placed = stage(members.join(sizes, "comp").select("sid", "comp", "parts"), "placed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            sets = list(gram_sets(Words(*text_buffers(b.column(1)), "alnum"), k))
            sums = [_sums(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sums], pa.int64()), pa.array([y for _, y in sums], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["f1", "f2", "n", "grams"])

    asked = marked(docs.select("doc_id", "text"), "doc_id", members.select("doc_id")).where("marked").select("doc_id", "text").dropDuplicates(["doc_id", "text"])
    found = asked.mapInArrow(run, "f1 long, f2 long, n long, grams binary").select(set_id().alias("sid"), "grams")
    rows = stage(found.join(placed, "sid").dropDuplicates(["sid"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")), "grams")
    links = _small_components(rows.where("parts = 1"), threshold)
    if rows.where("parts > 1").limit(1).count():
        links = links.unionByName(_large_components(rows.where("parts > 1"), threshold, block))
    return links


def near_duplicate_rows(docs: DataFrame, k: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """near_duplicates() of the rows with a doc_id, with rk (row_key of doc_id and text) and stays: whether a row with this
    key is the one of its class that stays, the least (doc_id, rk)."""
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows = stage(sketches(named, k).withColumn("sid", set_id()), "sketches")
    sets = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sample").alias("sample"), F.min(F.struct("doc_id", "rk")).alias("lead"))
    sets = stage(sets, "sets")
    edges = candidate_edges(sets.select("sid", "n", "sample"), recall)
    members = components(edges).withColumnRenamed("node", "sid").join(sets.select("sid", "n", "doc_id"), "sid")
    links = stage(verified_links(named, stage(members, "members"), k, threshold), "links")
    counts = links.groupBy("sid").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    comps = components(links.where("root <> sid").select(F.col("sid").alias("a"), F.col("root").alias("b")))
    classes = counts.join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "links", F.coalesce("comp", "sid").alias("class"))
    led = sets.select("sid", "lead").join(classes, "sid", "left").select("sid", "lead", F.coalesce("class", "sid").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    heads = led.groupBy("class").agg(F.min("lead").alias("head"))
    told = stage(led.join(heads, "class").select("sid", "links", "head"), "classes")
    out = rows.select("doc_id", "rk", "sid", "n").join(told, "sid", "left")
    stays = F.coalesce((F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.rk") == F.col("rk")), F.lit(True))
    return out.select("doc_id", F.coalesce("head.doc_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_grams"), "rk", stays.alias("stays"))


def near_duplicates(docs: DataFrame, k: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: (doc_id, class_id, n_links, n_grams).

    class_id: the least doc_id reachable over links of the threshold or more (equal sets included); n_links: how many other
    gram sets the row's set is linked to. Null and empty texts are alone in their class, without links; so are rows
    without a doc_id (class null). Texts of fewer than k words have one gram, all their words. Repeated rows get equal
    values; rows that share a doc_id but not the text are judged each by its text. Results depend on the rows alone, not on
    how they are split.
    """
    out = near_duplicate_rows(docs, k, threshold, recall).select("doc_id", "class_id", "n_links", "n_grams")
    nameless = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_grams"))
    return out.unionByName(nameless)


def keep_one_of_each(docs: DataFrame, k: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class of near duplicates: the least (doc_id, row key), once.

    Null and empty texts and rows without a doc_id all stay. Only rows with a key of which some row goes are shuffled; a bitmap
    of fixed size tells them.
    """
    judged = stage(near_duplicate_rows(docs, k, threshold, recall).where("n_grams > 0").groupBy("doc_id", "rk").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1"), "judged")
    row = row_key(F.col("doc_id"), F.col("text"))
    rows = marked(docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), row.alias("key")), "key", judged.select("rk"))
    asked = rows.where("marked").join(judged, (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("rk")), "left")
    held = asked.where("stays").dropDuplicates(["id", "key"])
    out = rows.where("NOT marked").select("row").unionByName(asked.where("rk IS NULL").select("row")).unionByName(held.select("row"))
    return out.select("row.*")
