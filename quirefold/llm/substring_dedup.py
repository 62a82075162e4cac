"""Substring dedup over a log-structured fingerprint index.

Every run of 50 words holds at least one of its document's fingerprints: hashes of 25 words that are least among 26
neighbours. The index keeps fingerprints of past batches in immutable runs, each a table bucketed and sorted by
fingerprint with the first and last document that has it. A new batch becomes a run, is merge-joined with the older ones,
and runs of one level are merged into the next level. Only windows whose least fingerprint is shared with an earlier
(later) document are then hashed whole and asked for (offered); a window goes where the asked and the offered agree on
both of two independent hashes of all 50 words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_size, combine, gram_hashes, scratch_root, split_words, stage, text_buffers

WINDOW = 50
SEED = 25
BATCHES = 3
_U = np.uint64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _sliding(op: np.ufunc, x: np.ndarray, k: int) -> np.ndarray:
    """op over each k neighbours, by doubling."""
    n, acc, done, level, span = len(x) - k + 1, None, 0, x, 1
    if n <= 0:
        return x[:0]
    while span <= k:
        if k & span:
            part = level[done : done + n]
            acc, done = (part if acc is None else op(acc, part)), done + span
        span *= 2
        if span <= k:
            level = op(level[: len(level) - span // 2], level[span // 2 :])
    return acc


class Fingerprints:
    """Whole windows of a batch, and which 25-word hashes are their fingerprints."""

    def __init__(self, w: Words, window: int = WINDOW, seed: int = SEED):
        self.words, self.near = w, window - seed + 1
        self.seeds = gram_hashes(w.hashes, seed)
        self.ok = w.window_ok(window)
        self.least = least = np.where(self.ok, _sliding(np.minimum, self.seeds, self.near), _U(0)) if len(self.ok) else self.seeds[:0]
        pad = np.zeros(self.near - 1, dtype=_U)
        best = _sliding(np.maximum, np.concatenate([pad, least, pad]), self.near) if len(least) else np.zeros(len(self.seeds), dtype=_U)
        self.at = np.flatnonzero((best == self.seeds) & (best > 0))
        self.doc = w.doc_of()


def fingerprints(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Distinct (h, doc_id) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            f = Fingerprints(Words(*text_buffers(b.column(1)), "space"), window, seed)
            doc, h = f.doc[f.at], f.seeds[f.at]
            _, keep = np.unique(combine(doc.astype(_U), h), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), b.column(0).cast(pa.int64()).take(pa.array(doc[keep]))], ["h", "doc_id"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "h long, doc_id long")


class FingerprintIndex:
    """Sorted immutable runs (h, first, last) in levels; two runs of a level are merged into one of the next."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"quirefold_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{scratch_root(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(self.spark)}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def ingest(self, prints: DataFrame) -> DataFrame:
        """Adds a batch (h, doc_id); returns the fingerprints (h, first, last) it shares within itself or with the past."""
        summed = prints.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        run = self._write(summed.repartition(self.buckets, "h"))
        new = self.spark.table(run)
        shared = new.where("first < last")
        for old in self.levels.values():
            past = self.spark.table(old).select("h", F.col("first").alias("f0"), F.col("last").alias("l0"))
            met = new.join(past, "h").select("h", F.least("first", "f0").alias("first"), F.greatest("last", "l0").alias("last"))
            shared = shared.unionByName(met.where("first < last"))
        shared = stage(shared, "shared")
        level = 0
        while level in self.levels:  # compaction
            old = self.levels.pop(level)
            a, b = self.spark.table(old), self.spark.table(run)
            merged = a.join(b, "h", "full_outer").select("h", F.least(a["first"], b["first"]).alias("first"), F.greatest(a["last"], b["last"]).alias("last"))
            both = self._write(merged)
            self._drop(old)
            self._drop(run)
            run, level = both, level + 1
        self.levels[level] = run
        return shared

    def drop(self) -> None:
        for name in self.levels.values():
            self._drop(name)
        self.levels = {}


SPLIT_SCHEMA = "kind int, doc_id long, g1 long, g2 int, n_words long, n_removed long, sha string, text string"


def _windows(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """kind 0: a finished document; 1: one that waits for answers, with text; 2: a window asked for; 3: one offered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            col = b.column(1)
            w = Words(*text_buffers(col), "space")
            f = Fingerprints(w, window, seed)
            ids = b.column(0).cast(pa.int64())
            id_of = ids.fill_null(0).to_numpy()
            copy = b.column(3).fill_null(False).to_numpy(zero_copy_only=False)
            shared = b.column(2).combine_chunks() if isinstance(b.column(2), pa.ChunkedArray) else b.column(2)
            flat = shared.flatten()
            of = np.repeat(np.arange(b.num_rows), shared.value_lengths().fill_null(0).to_numpy())
            key = combine(of.astype(_U), flat.field(0).to_numpy().view(_U)) if len(of) else np.empty(0, dtype=_U)
            order = np.argsort(key)
            key = key[order]
            first, last = (flat.field(i).to_numpy()[order] for i in (1, 2)) if len(of) else (key.view(np.int64),) * 2
            j = np.flatnonzero(f.ok & ~copy[f.doc[: len(f.ok)]]) if len(key) else np.empty(0, dtype=np.int64)
            want = combine(f.doc[j].astype(_U), f.least[j])
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            j, at = (j[hit], at[hit]) if len(key) and (hit := key[at] == want) is not None else (j, at)
            mine = id_of[f.doc[j]]
            parts = []
            asks, offers = j[first[at] < mine], j[last[at] > mine]
            waits = np.zeros(b.num_rows, dtype=bool)
            if len(asks) or len(offers):
                g1, g2 = gram_hashes(w.hashes, window), gram_hashes(w.hashes, window, salt=2)
                for kind, j in ((2, asks), (3, offers)):
                    _, keep = np.unique(combine(f.doc[j].astype(_U), g1[j]), return_index=True)
                    j = j[keep]
                    null = pa.nulls(len(j))
                    parts.append([pa.array(np.full(len(j), kind, dtype=np.int32)), pa.array(id_of[f.doc[j]]), pa.array(g1[j].view(np.int64)), pa.array((g2[j] >> _U(32)).astype(np.uint32).view(np.int32)), null.cast(pa.int64()), null.cast(pa.int64()), null.cast(pa.string()), null.cast(pa.string())])
                waits[f.doc[asks]] = True
            waits &= ids.is_valid().to_numpy(zero_copy_only=False)
            counts, texts, raw = w.counts, [], w.data.tobytes()
            shas, removed = [], []
            for d in range(b.num_rows):
                gone = bool(copy[d]) and counts[d] >= window
                removed.append(int(counts[d]) if gone else 0)
                if waits[d]:
                    shas.append(None)
                else:
                    lo, hi = int(w.first[d]), int(w.first[d + 1])
                    shas.append(EMPTY_SHA if gone else hashlib.sha256(b" ".join(raw[w.starts[lo] : w.ends[hi - 1]].split()) if hi > lo else b"").hexdigest())
            texts = pa.array([t.as_py() if x else None for t, x in zip(col, waits, strict=True)], pa.string())
            n = b.num_rows
            parts.append([pa.array(waits.astype(np.int32)), ids, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), texts])
            for p in parts:
                yield pa.RecordBatch.from_arrays(p, ["kind", "doc_id", "g1", "g2", "n_words", "n_removed", "sha", "text"])

    return rows.select("doc_id", "text", "shared", "copy").mapInArrow(run, SPLIT_SCHEMA)


def _finish(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            w = Words(*text_buffers(b.column(1)), "space")
            g1, g2 = gram_hashes(w.hashes, window), (gram_hashes(w.hashes, window, salt=2) >> _U(32)).astype(np.uint32)
            ok, doc = w.window_ok(window), w.doc_of()
            flat = b.column(2).flatten()
            of = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().fill_null(0).to_numpy())
            known = np.unique(combine(combine(of.astype(_U), flat.field(0).to_numpy().view(_U)), flat.field(1).to_numpy().view(np.uint32).astype(_U))) if len(of) else np.empty(0, dtype=_U)
            gone = np.zeros(len(w.hashes) + 1, dtype=np.int64)
            if len(ok) and len(known):
                j = np.flatnonzero(ok)
                j = j[np.isin(combine(combine(doc[j].astype(_U), g1[j]), g2[j].astype(_U)), known)]
                np.add.at(gone, j, 1)
                np.add.at(gone, j + window, -1)
            cut = np.cumsum(gone[:-1]) > 0
            raw = w.data.tobytes()
            removed, shas, texts = [], [], []
            for d in range(b.num_rows):
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                words = b" ".join(raw[w.starts[i] : w.ends[i]] for i in range(lo, hi) if not cut[i])
                removed.append(int(cut[lo:hi].sum()))
                shas.append(hashlib.sha256(words).hexdigest())
                texts.append(words.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """One row per input row: (doc_id, n_words, n_removed, kept_sha256[, kept: the words left, where any were removed]).

    A word goes if a window over it also starts in a document with a smaller doc_id. Texts of fewer than `window` words
    keep all words; null and empty texts have none. Rows that repeat a doc_id don't remove each other's words; a row
    without a doc_id neither gives nor loses words. Batches are ranges of doc_id, ingested in order.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    cuts = [None, *sorted(set(docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02))), None]
    index = FingerprintIndex(spark)
    shared = None
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = docs.where((F.lit(True) if lo is None else F.col("doc_id") >= int(lo)) & (F.lit(True) if hi is None else F.col("doc_id") < int(hi)))
        met = index.ingest(fingerprints(part, window, seed))
        shared = met if shared is None else shared.unionByName(met)
    index.drop()
    shared = shared.groupBy("h").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    lists = fingerprints(docs, window, seed).join(shared, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "first", "last")).alias("shared"))
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    hashed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", sha.alias("sha"))
    firsts = hashed.groupBy("sha").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("l")).where("f < l")
    copies = hashed.join(firsts, "sha").where("doc_id > f").select(F.col("doc_id").alias("c"), "sha").distinct()
    known = lists.join(copies.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.first("sha").alias("csha")), lists["doc_id"] == F.col("c"), "left").select(F.col("doc_id").alias("k"), "shared", "n", "csha")
    rows = docs.join(known, docs["doc_id"] == known["k"], "left").select("doc_id", "text", "shared", ((F.col("n") == 1) & (F.col("csha") == sha)).alias("copy"))
    path = f"{scratch_root(spark)}/windows-{uuid.uuid4().hex}"
    _windows(rows, window, seed).write.partitionBy("kind").parquet(path)
    split = spark.read.schema(SPLIT_SCHEMA).parquet(path)
    offered = split.where("kind = 3").groupBy("g1", "g2").agg(F.min("doc_id").alias("first"))
    asked = split.where("kind = 2").select("doc_id", "g1", "g2")
    gone = asked.join(offered, ["g1", "g2"]).where("first < doc_id").groupBy(F.col("doc_id").alias("k")).agg(F.collect_list(F.struct("g1", "g2")).alias("gone"))
    waiting = split.where("kind = 1").select("doc_id", "text")
    done = _finish(waiting.join(gone, waiting["doc_id"] == gone["k"], "left"), window, with_text)
    still = split.where("kind = 0").select("doc_id", "n_words", "n_removed", F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    out = still.unionByName(done)
    return out if with_text else out.drop("kept")


def oracle(window: int = WINDOW) -> str:
    """The same in DuckDB SQL, window by window."""
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + {window - 1}], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM g JOIN f USING (k) WHERE first < doc_id),
r AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
