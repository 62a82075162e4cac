"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k): one weight vector, ordered thresholds. Labels say toxic or not; the severity of a
toxic training row is graded by how many words of the text are typical of toxic rows (counted over the training rows),
which gives the ordered grades 0 (clean), 1 (mild), 2 (medium), 3 (severe). The model outputs the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_size, mix64, stage, text_buffers, word_hashes

#: The model is fitted on at most about this many labelled rows, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
SLOTS = 1 << 20
LEAST_DOCS = 3
GRADES = 3
EPOCHS = 30
#: Bytes of a word's beginning that are features too.
PREFIXES = (5, 6, 7, 8, 9)
_U = np.uint64


def sparse_features(data: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, slot) pairs with counts, sorted; a slot is the hash of a lower-cased word or of a word's beginning."""
    w = Words(data, offsets, "alnum")
    doc, low = w.doc_of().astype(np.int64), np.where((data >= 65) & (data < 91), data + 32, data)
    keys = [doc * slots + (w.hashes % _U(slots)).astype(np.int64)]
    for k in PREFIXES:
        at = np.flatnonzero(w.ends - w.starts > k)
        keys.append(doc[at] * slots + (mix64(word_hashes(low, w.starts[at], w.starts[at] + k) + _U(k)) % _U(slots)).astype(np.int64))
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // slots, key % slots, n


def word_slots(words: list[str], slots: int = SLOTS) -> np.ndarray:
    raw = [x.encode() for x in words]
    data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
    return (Words(data, np.array([0, len(data)]), "alnum").hashes % _U(slots)).astype(np.int64)


class OrdinalModel:
    def __init__(self, slots: int = SLOTS, grades: int = GRADES):
        self.weight, self.theta = np.zeros(slots), np.linspace(6.0, 8.0, grades)

    def at_least(self, doc: np.ndarray, slot: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a row per document."""
        z = np.bincount(doc, weights=self.weight[slot] * (1 + np.log(count)), minlength=n)
        return 1 / (1 + np.exp(np.clip(self.theta[None, :] - z[:, None], -30, 30)))


def telling(a: np.ndarray, b: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """Whether features in a toxic and b clean rows have another share of toxic rows than all rows have (log-likelihood ratio,
    allowing for the many features tried)."""
    share = toxic / max(toxic + clean, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(a > 0, a * np.log(a / ((a + b) * share)), 0) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0))
    tried = (a + b) >= LEAST_DOCS
    return tried & (g2 >= 2 * np.log(max(2, np.count_nonzero(tried))) + 4)


def fit_ordinal(doc: np.ndarray, slot: np.ndarray, count: np.ndarray, toxic: np.ndarray, typical: np.ndarray, slots: int = SLOTS, epochs: int = EPOCHS, l2: float = 2e-4) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link log loss over the telling slots given; typical: flags of slots."""
    n, model = len(toxic), OrdinalModel(slots)
    if not n or not toxic.any() or toxic.all():
        model.theta += (0 if not n or not toxic.any() else -20)
        return model
    n_hits = np.bincount(doc, weights=count * typical[slot], minlength=n)
    grade = np.where(toxic, 1 + (n_hits >= 3) + (n_hits >= 6), 0)
    y = (grade[:, None] > np.arange(GRADES)[None, :]).astype(float)
    d, s, v = doc, slot, 1 + np.log(count)
    model.theta = np.array([2.0, 4.0, 6.0])
    m1, m2, t1, t2 = np.zeros(slots), np.zeros(slots), np.zeros(GRADES), np.zeros(GRADES)
    for step in range(1, epochs * 10 + 1):
        z = np.bincount(d, weights=model.weight[s] * v, minlength=n)
        p = 1 / (1 + np.exp(np.clip(model.theta[None, :] - z[:, None], -30, 30)))
        r = (p - y) / n
        g = np.bincount(s, weights=r.sum(axis=1)[d] * v, minlength=slots) + l2 * model.weight
        gt = -r.sum(axis=0)
        m1, m2, t1, t2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * t1 + 0.1 * gt, 0.99 * t2 + 0.01 * gt * gt
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        model.weight -= 0.1 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        model.theta = np.maximum.accumulate(model.theta - 0.1 * (t1 / c1) / (np.sqrt(t2 / c2) + 1e-8))
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> OrdinalModel:
    """Fits on at most about `most` labelled documents, chosen by hash; a document labelled twice is toxic if either says so."""
    labelled = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = stage(labelled, "toxlabels")
    share = min(1.0, most / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            doc, slot, n = sparse_features(*text_buffers(b.column(1)))
            cut = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            packed = pa.ListArray.from_arrays(cut, pa.array((slot << 20 | np.minimum(n, (1 << 20) - 1)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), packed], ["doc_id", "toxic", "f"])

    sample = docs.join(chosen, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    sample = stage(sample.mapInArrow(rows, "doc_id long, toxic int, f array<long>"), "toxsample")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64)
        for pdf in batches:
            for f, y in zip(pdf["f"], pdf["toxic"], strict=True):
                (a if y > 0 else b)[np.asarray(f, dtype=np.int64) >> 20] += 1
        used = np.flatnonzero(a + b)
        yield pd.DataFrame({"slot": used, "a": a[used], "b": b[used]})

    size = sample.agg(F.expr("count_if(toxic > 0) AS a"), F.expr("count_if(toxic <= 0) AS b")).first()
    found = sample.mapInPandas(counted, "slot long, a long, b long").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(f"a + b >= {LEAST_DOCS}").toPandas()  # SLOTS rows at most
    a, b = found["a"].to_numpy(dtype=float), found["b"].to_numpy(dtype=float)
    tells = telling(a, b, size["a"], size["b"])
    known, typical = np.zeros(SLOTS, dtype=bool), np.zeros(SLOTS, dtype=bool)
    known[found["slot"][tells]] = True
    typical[found["slot"][tells & (a * size["b"] > b * size["a"])]] = True
    kept = np.flatnonzero(known)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(f=[x[np.isin(x >> 20, kept)] for x in (np.asarray(f, dtype=np.int64) for f in pdf["f"])])

    rows_ = sample.mapInPandas(told, sample.schema).toPandas().sort_values("doc_id")
    sizes = rows_["f"].map(len).to_numpy(dtype=int)
    packed = np.concatenate(rows_["f"].tolist()).astype(np.int64) if len(rows_) else np.empty(0, dtype=np.int64)
    return fit_ordinal(np.repeat(np.arange(len(rows_)), sizes), packed >> 20, packed & ((1 << 20) - 1), rows_["toxic"].to_numpy() > 0, typical)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: (doc_id, severity, p_mild, p_medium, p_severe, grade, toxic).

    severity: the expected grade, 0 to 3; grade: the number of thresholds passed with probability 0.5; toxic: grade >= 1.
    Null and empty texts have no features and get the thresholds' own (low) severity. Repeated rows each get their row; a
    null doc_id is scored, not learned from; an empty table gives an empty result; other columns are not read.
    """
    model = train_toxicity(docs.select("doc_id", "text"), labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            p = model.at_least(*sparse_features(*text_buffers(b.column(1))), b.num_rows)
            grade = (p >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(p.sum(axis=1)), *(pa.array(c) for c in p.T), pa.array(grade.astype(np.int32)), pa.array(grade >= 1)],
                ["doc_id", "severity", "p_mild", "p_medium", "p_severe", "grade", "toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, p_mild double, p_medium double, p_severe double, grade int, toxic boolean")
