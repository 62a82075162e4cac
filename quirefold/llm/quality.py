"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of all documents are computed once, at Arrow speed. The ridge's normal equations are summed in each partition,
then over groups of partitions, so the driver gets one matrix. The isotonic curve is fitted on counts in fine bins of
another part of the labelled rows, and read by linear interpolation, so equal scores stay rare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_size, combine, crc_mod, stage, text_buffers

FEATURES = (
    "log_bytes", "log_words", "mean_word", "letters", "upper", "digits", "marks", "high_bytes", "gaps", "distinct_words", "top_word", "distinct_pairs",
    "marked_words", "upper_words", "bare_marks", "distinct_lines", "words_a_line", "stops", "long_words", "distinct_bytes",
)
DIMENSIONS = 256
RIDGE = 1e-3
BINS = 400
GROUPS = 64


def _classes() -> np.ndarray:
    """Per byte value: 0 letter, 1 capital, 2 digit, 3 mark, 4 gap, 5 high byte."""
    out = np.full(256, 3, dtype=np.int8)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 5
    out[[32, 9, 10, 11, 12, 13]] = 4
    return out


_CLASS = _classes()
_BYTES = 1 << 18
BATCH_BYTES = 1 << 20


def _byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each document has each byte value; counted in blocks, so indexes are never as long as the data."""
    out = np.zeros((len(offsets) - 1, 256), dtype=np.int64)
    for lo in range(0, len(data), _BYTES):
        hi = min(lo + _BYTES, len(data))
        a, b = int(np.searchsorted(offsets, lo, side="right")) - 1, int(np.searchsorted(offsets, hi, side="left"))
        inside = np.diff(np.clip(offsets[a : b + 1], lo, hi))
        at = np.repeat(np.arange(b - a, dtype=np.int64) * 256, inside)
        out[a:b] += np.bincount(at + data[lo:hi], minlength=256 * (b - a)).reshape(-1, 256)
    return out


def document_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document; documents without words have zeros where a ratio is undefined."""
    n = len(offsets) - 1
    w = Words(data, offsets, "space")
    size = np.diff(offsets)
    byte_counts = _byte_counts(data, offsets)
    per = byte_counts @ (_CLASS[:, None] == np.arange(6)).astype(np.int64)
    counts, doc = w.counts, w.doc_of()
    length = w.ends - w.starts
    share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
    by_doc = lambda flags: np.bincount(doc, weights=flags, minlength=n)

    def distinct(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values in each document, and how often the commonest stands."""
        key = np.sort((d.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))  # 2^20 documents in a batch at most
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
        run, of = np.diff(np.append(new, len(key))), (key[new] >> np.uint64(44)).astype(np.int64)
        top = np.zeros(n)
        np.maximum.at(top, of, run)
        return np.bincount(of, minlength=n).astype(float), top

    many, top = distinct(doc, w.hashes)
    pair_doc = doc[:-1][doc[:-1] == doc[1:]] if len(doc) else doc
    pairs = combine(w.hashes[:-1], w.hashes[1:])[doc[:-1] == doc[1:]] if len(doc) else w.hashes
    pairs_many, _ = distinct(pair_doc, pairs)
    last, first = data[w.ends - 1] if len(doc) else data[:0], data[w.starts] if len(doc) else data[:0]
    prev = data[np.maximum(w.ends - 2, w.starts)] if len(doc) else data[:0]
    marked = (_CLASS[last] == 3) & (_CLASS[prev] == 3)
    upper = (_CLASS[first] == 1) & (_CLASS[prev] != 0) & (length > 1)
    bare = (length <= 2) & (_CLASS[first] == 3)
    lines_at = np.unique(np.concatenate([offsets[:-1][size > 0], np.flatnonzero(data == 10) + 1]))
    lines_at = lines_at[lines_at < len(data)]
    first_word = np.searchsorted(w.starts, lines_at)
    ok = first_word < np.append(first_word[1:], len(w.starts))
    line_hash = np.add.reduceat(combine(w.hashes, np.arange(len(w.hashes), dtype=np.uint64) - first_word[np.searchsorted(lines_at, w.starts, side="right") - 1].astype(np.uint64)), first_word[ok]) if len(w.hashes) else w.hashes
    line_doc = np.searchsorted(offsets, lines_at[ok], side="right") - 1
    lines = np.bincount(line_doc, minlength=n).astype(float)
    lines_many, _ = distinct(line_doc, line_hash)
    bytes_used = np.count_nonzero(byte_counts, axis=1)
    total = size.astype(float)
    return np.stack(
        [
            np.log1p(total), np.log1p(counts), share(by_doc(length.astype(float)), counts), share(per[:, 0], total), share(per[:, 1], total), share(per[:, 2], total), share(per[:, 3], total),
            share(per[:, 5], total), share(per[:, 4], total), share(many, counts), share(top, counts), share(pairs_many, np.maximum(counts - 1, 0)), share(by_doc(marked.astype(float)), counts),
            share(by_doc(upper.astype(float)), counts), share(by_doc(bare.astype(float)), counts), share(lines_many, lines), np.log1p(share(counts, lines)),
            share(by_doc(((_CLASS[last] == 3) & ~marked).astype(float)), counts), share(by_doc((length > 12).astype(float)), counts), np.log1p(bytes_used),
        ],
        axis=1,
    )


STAT_SCHEMA = "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, FEATURES..., keep...) of whole texts; null reads as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, most=BATCH_BYTES):
            x = document_statistics(*text_buffers(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c) for c in x.T), *b.columns[2:]], ["doc_id", *FEATURES, *(f"_k{i}" for i in range(len(keep)))])

    more = "".join(f", _k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = docs.select("doc_id", "text", *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep))).mapInArrow(run, STAT_SCHEMA + more)
    return out.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing means."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean, strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.repeat([b[1] for b in blocks], [b[2] for b in blocks])


class QualityModel:
    """Standardised statistics -> Fourier features -> ridge score -> calibrated score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.omega = rng.normal(size=(len(mean), dimensions)) / np.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, dimensions)
        self.beta = np.zeros(dimensions + 1)
        self.knots, self.values = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _sum_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over all rows: by partition, then by group of partitions, then one sum."""
    d = len(model.beta)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((d, d + 1))
        for pdf in batches:
            x = model.features(pdf[list(FEATURES)].to_numpy(dtype=float))
            a += x.T @ np.concatenate([x, pdf[["y"]].to_numpy(dtype=float)], axis=1)
        yield pd.DataFrame({"m": [a.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [np.sum([np.frombuffer(m) for m in pdf["m"]], axis=0).tobytes()]})

    parts = rows.mapInPandas(part, "m binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    sums = parts.groupBy("g").applyInPandas(lambda pdf: add(pdf), "m binary").collect()  # GROUPS matrices at most
    a = np.sum([np.frombuffer(r["m"]) for r in sums], axis=0).reshape(d, d + 1) if sums else np.zeros((d, d + 1))
    return a[:, :d], a[:, d]


def fit_quality(stats: DataFrame, labels: DataFrame, dimensions: int = DIMENSIONS, ridge: float = RIDGE) -> QualityModel:
    """Fits on labelled rows that are not held out: crc32 remainder 0 for the ridge, 2 for the calibration.

    labels: (doc_id, quality). A document labelled twice counts once, by its mean label. Without labels every score is 0.5.
    """
    moments = stats.agg(*[F.mean(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).first()
    mean = np.array([moments[f"m_{c}"] or 0.0 for c in FEATURES])
    scale = np.array([moments[f"s_{c}"] or 1.0 for c in FEATURES])
    model = QualityModel(mean, np.where(scale < 1e-9, 1.0, scale), dimensions)
    labelled = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    rows = stage(stats.join(labelled, "doc_id").withColumn("fold", crc_mod(F.col("doc_id"), 3)).where("fold <> 1"), "labelled")
    a, b = _sum_equations(rows.where("fold = 0"), model)
    n = a[-1, -1]
    if n == 0:
        return model
    model.beta = np.linalg.solve(a + ridge * n * np.eye(len(b)) * np.append(np.ones(len(b) - 1), 1e-6) / dimensions, b)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = model.raw(pdf[list(FEATURES)].to_numpy(dtype=float))
            yield pd.DataFrame({"b": np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(int), "raw": raw, "y": pdf["y"]})

    bins = rows.where("fold = 2").mapInPandas(scored, "b int, raw double, y double").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")).orderBy("b").toPandas()  # BINS rows at most
    if len(bins):
        weight = bins["n"].to_numpy(dtype=float)
        level = (weight @ bins["y"]) / weight.sum()
        value = isotonic(weight, (bins["y"].to_numpy() * weight + level) / (weight + 1))
        raw = bins["raw"].to_numpy()
        tilt = 1e-4 * (raw - raw.mean())  # keeps the order of raw scores inside a pooled block
        model.knots = np.concatenate([[raw[0] - 2], raw, [raw[-1] + 2]])
        model.values = np.clip(np.concatenate([[value[0] + tilt[0] - 2e-4], value + tilt, [value[-1] + tilt[-1] + 2e-4]]), 0, 1)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted, keep...).

    Null and empty texts are scored by their (zero) statistics; repeated rows each get their row and the same score; a null
    doc_id is scored, not learned from; an empty table gives an empty result; columns not named in keep are not read.
    """
    stats = stage(statistics(docs, keep), "statistics")
    model = fit_quality(stats.select("doc_id", *FEATURES), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], axis=1)
            rest = b.columns[1 + len(FEATURES) :]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x)), *rest], ["doc_id", "score", *(f"_k{i}" for i in range(len(rest)))])

    more = "".join(f", _k{i} {stats.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = stats.mapInArrow(run, "doc_id long, score double" + more).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *keep)
