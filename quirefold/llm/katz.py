"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised backoff weights, any order.

Texts are staged in chunks of about three megabytes, a row each, so that no file split cuts one. A chunk asks for its distinct
n-grams of each length, once each, as packed and sorted hashes; the tables of counts are partitioned by the leading bits of
the hash, so a hot word is one key of each chunk like any other. A partition sums the training counts and answers every
chunk in the order it asked, with whether texts not learned from hold the n-gram too. Chunks then score their documents,
from single words up; of each n-gram one chunk, its owner, adds to the sums from which the backoff weight of its context
follows, if a text not learned from holds that context (all others are never backed off from). Tokens whose n-gram was
never seen wait for that weight, once per length they step down, and are joined with it by context.

P(w|uv) = d c(uvw)/c(uv) if c(uvw) > 0, else alpha(uv) P(w|v), with alpha = 1 where uv was never seen; so down to
P(w) = d c(w)/N, and what is left over for words never seen. A text's first token has the start as its only context, the
second the start and the first, and so on. d: Good-Turing with Katz's correction for counts to 5, and (c - 1/2)/c above, so
that every context keeps some mass.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_size, combine, crc_mod, mix64, scratch_root, text_buffers

KATZ_K = 5
ORDER = 3
TAIL = 0.5
KEY_BYTES = 7
CHUNK_BYTES = 3 << 20
RANGE_BYTES = 32 << 20
_U = np.uint64
_END, _START = (_U(mix64(np.array([x]))[0]) for x in (101, 102))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and where each element is among them; any place will do, so no stable sort."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    inverse = np.empty(len(x), dtype=np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], order[new], inverse


class Grams:
    """Distinct n-grams of a chunk by length (sorted 56-bit keys), how often they are learned, and where each token's are among them.

    Lists go by length less one. keys, n (times learned), held (in a text not learned from); index: each token's, -1 where
    its text has too few tokens before it. For lengths from two on: context, the place
    among the keys one shorter of all but the last token; lower, of all but the first; hash, the context's 64-bit hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, train: np.ndarray, order: int = ORDER):
        w = Words(data, offsets, "space_lower")
        n = len(offsets) - 1
        self.n_docs, counts = n, w.counts
        first = w.first[:-1] + np.arange(n)
        token = np.full(len(w.hashes) + n, _END, dtype=_U)
        is_word = np.ones(len(token), dtype=bool)
        is_word[first + counts] = False
        token[is_word] = w.hashes
        self.doc = np.repeat(np.arange(n, dtype=np.int32), counts + 1)
        del w
        place = np.arange(len(token), dtype=np.int32) - first.astype(np.int32)[self.doc]
        on = train[self.doc]
        shift = _U(64 - 8 * KEY_BYTES)
        self.keys, self.n, self.held, self.index, self.context, self.lower, self.hash = ([] for _ in range(7))
        gram = token
        for k in range(order):
            rows = np.arange(len(token)) if k < 2 else np.flatnonzero(place >= k - 1)
            history = None
            if k:
                history = np.empty_like(token)
                history[1:] = gram[:-1]
                if k == 1:
                    history[first] = _START
                gram = combine(history, token)
            keys, at, inverse = _distinct(gram[rows] >> shift)
            at = rows[at]
            index = np.full(len(token), -1, dtype=np.int32)
            index[rows] = inverse
            weight = np.bincount(inverse, weights=on[rows], minlength=len(keys)).astype(np.int64)
            held = np.bincount(inverse, weights=~on[rows], minlength=len(keys)) > 0
            if k == 1:
                end = np.searchsorted(keys_below := self.keys[0], _END >> shift)  # the start stands as often as the end
                context = np.where(place[at] == 0, min(int(end), max(len(keys_below) - 1, 0)), self.index[0][at - 1])
            else:
                context = self.index[k - 1][at - 1] if k else None
            lists = (self.keys, self.n, self.held, self.index, self.context, self.lower, self.hash)
            for to, x in zip(lists, (keys, weight, held, index, context, self.index[k - 1][at] if k else None, history[at] if k else None), strict=True):
                to.append(x)


def _pack(x: np.ndarray, width: int) -> bytes:
    """Little-endian integers by byte planes: planes of zeros cost nothing once compressed."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(b: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(b, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _parts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of each partition in sorted keys."""
    return np.searchsorted(keys >> _U(8 * KEY_BYTES - bits), np.arange((1 << bits) + 1, dtype=_U))


def _steps(keys: np.ndarray, bits: int) -> np.ndarray:
    """Sorted keys of one partition as steps, which have fewer bytes."""
    return np.diff(keys, prepend=keys[:1] >> _U(8 * KEY_BYTES - bits) << _U(8 * KEY_BYTES - bits))


def discounts(n: np.ndarray, k: int = KATZ_K) -> np.ndarray:
    """d for counts 0..k from counts of counts n[1..k+1]; absolute discount where Good-Turing gives none between 0 and 1."""
    d = np.array([0.0] + [(c - TAIL) / c for c in range(1, k + 1)])
    if n[1] > 0:
        a = (k + 1) * n[k + 1] / n[1]
        for c in range(1, k + 1):
            if n[c] > 0 and a < 1:
                x = ((c + 1) * n[c + 1] / (c * n[c]) - a) / (1 - a)
                if 0 < x < 1:
                    d[c] = x
    return d


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c < len(d), d[np.minimum(c, len(d) - 1)] * c, c - TAIL)


class KatzModel:
    """The corpus-wide numbers: N, V, discounts by length, and the mass of words never seen."""

    def __init__(self, stats: np.ndarray):
        """stats: N, V, then counts of counts 1..6 of words, of bigrams, and so on."""
        self.n, self.v = float(stats[0]), float(stats[1])
        of = [np.concatenate([[0.0], x]) for x in np.asarray(stats[2:], dtype=float).reshape(-1, KATZ_K + 1)]
        self.d = [discounts(x) for x in of]
        low = np.arange(1, KATZ_K + 1)
        few = of[0][1 : KATZ_K + 1]
        taken = float((self.d[0][1:] * low * few).sum() + (self.n - (low * few).sum()) - TAIL * (self.v - few.sum()))
        self.unknown = (self.n - taken) / self.n if self.n else 1.0

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, _discounted(c, self.d[0]) / max(self.n, 1.0), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))


def _squeezed(batch: pa.RecordBatch) -> bytes:
    """A batch as a compressed Arrow stream, so that every exchange carries it so."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(blob: pa.BinaryScalar, order: int) -> tuple[pa.Array, Grams]:
    """The ids and the n-grams of a chunk."""
    ids, text, train = pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks().to_batches()[0].columns
    return ids, Grams(*text_buffers(text), train.to_numpy(zero_copy_only=False), order)


CHUNK_SCHEMA = "chunk long, docs binary, size long"
DOC_SCHEMA = "kind int, rid long, doc_id long, n_tokens long, n_known long, base_score double, score double, h long, times long, a double, b double"


def katz_scores(docs: DataFrame, train_mod: tuple[int, int] = (7, 2), order: int = ORDER) -> DataFrame:
    """One row per input row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), logarithms to base 10.

    order is the longest n-gram's length, 1 or more. Learns from rows whose crc32(doc_id) modulo train_mod[0] is not train_mod[1]; a row without a doc_id is not learned
    from. Null and empty texts are the end token alone. Repeated rows each count and each get their row. Without training
    rows all words are unknown, with probability 1.
    """
    spark = docs.sparkSession
    held = F.coalesce(crc_mod(F.col("doc_id"), train_mod[0]) == train_mod[1], F.lit(False))
    train = F.col("doc_id").isNotNull() & ~held

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 24, 0
        for b in by_size(batches, most=CHUNK_BYTES):
            docs = pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).fill_null("").cast(pa.large_string()), b.column(2)], ["doc_id", "text", "train"])
            size = int(text_buffers(b.column(1))[1][-1])
            yield pa.RecordBatch.from_arrays([pa.array([base | k]), pa.array([_squeezed(docs)], pa.binary()), pa.array([size])], ["chunk", "docs", "size"])
            k += 1

    path = f"{scratch_root(spark)}/chunks-{uuid.uuid4().hex}"
    docs.select("doc_id", "text", train.alias("train")).mapInArrow(cut, CHUNK_SCHEMA).write.option("compression", "none").parquet(path)
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    size = chunks.agg(F.sum("size")).first()[0] or 0
    bits = max(4, min(24, math.ceil(math.log2(max(1, size / RANGE_BYTES)))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, g = _rows(b.column(1)[i], order)
                out = []
                for kind, (keys, n, other) in enumerate(zip(g.keys, g.n, g.held, strict=True)):
                    at = _parts(keys, bits)
                    said = n << 1 | other
                    out += [(p, kind, b.column(0)[i].as_py(), _pack(_steps(keys[at[p] : at[p + 1]], bits), KEY_BYTES), pa.compress(_pack(said[at[p] : at[p + 1]], 5), "zstd", asbytes=True)) for p in np.flatnonzero(at[1:] > at[:-1]).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "kind", "chunk", "keys", "n"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, part = int(pdf["kind"].iloc[0]), int(pdf["part"].iloc[0])
        pdf = pdf.sort_values("chunk").reset_index(drop=True)
        keys = [np.cumsum(_unpack(k, KEY_BYTES)) for k in pdf["keys"]]
        n = np.concatenate([_unpack(pa.decompress(x, 5 * len(k), "zstd", asbytes=True), 5) for x, k in zip(pdf["n"], keys, strict=True)]).astype(np.int64)
        n, other = n >> 1, (n & 1) == 1
        ends = np.cumsum([len(k) for k in keys])
        _, _, inverse = _distinct(np.concatenate(keys))
        total = np.zeros(int(inverse.max()) + 1, dtype=np.int64)
        np.add.at(total, inverse, n)
        held = np.zeros(len(total), dtype=bool)
        held[inverse[other]] = True
        owner = np.zeros(len(inverse), dtype=bool)
        trained = np.flatnonzero(n > 0)
        owner[trained[np.unique(inverse[trained], return_index=True)[1]]] = True
        told = total[inverse] << 2 | held[inverse].astype(np.int64) << 1 | owner
        blobs = [_pack(x, 6) for x in np.split(told, ends[:-1])]
        of = np.bincount(np.minimum(total, KATZ_K + 2), minlength=KATZ_K + 3)[1 : KATZ_K + 2].astype(float)
        stats = np.zeros((order, KATZ_K + 1))
        stats[kind] = of
        stats = [float(total.sum()) if kind == 0 else 0.0, float((total > 0).sum()) if kind == 0 else 0.0, *stats.ravel().tolist()]
        return pd.DataFrame({"chunk": [*pdf["chunk"], -1], "part": part, "kind": kind, "said": [*blobs, None], "stats": [*[None] * len(blobs), stats]})

    asked = chunks.select("chunk", "docs").mapInArrow(ask, "part int, kind int, chunk long, keys binary, n binary")
    path, schema = f"{scratch_root(spark)}/answers-{uuid.uuid4().hex}", "chunk long, part int, kind int, said binary, stats array<double>"
    asked.groupBy("part", "kind").applyInPandas(answer, schema).write.option("compression", "zstd").parquet(path)
    answers = spark.read.schema(schema).parquet(path)
    sums = answers.where("stats IS NOT NULL").select(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(2 + order * (KATZ_K + 1))]).first()
    model = KatzModel(np.array([x or 0.0 for x in sums]))

    def score(texts: pa.Table, said: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what the last chunk's answer took
        ids, g = _rows(texts.column("docs")[0], order)  # a chunk is one row
        del g.keys, g.n, g.held
        said = said.sort_by([("kind", "ascending"), ("part", "ascending")])
        kind = said.column("kind").to_numpy()
        got = [np.concatenate([_unpack(b.as_py(), 6) for b, k in zip(said.column("said"), kind, strict=True) if k == want] or [np.empty(0, dtype=_U)]).astype(np.int64) for want in range(order)]
        count = [x >> 2 for x in got]
        n = g.n_docs
        rid = (texts.column("chunk")[0].as_py() << 20) + np.arange(n)
        p = model.word(count[0])  # of distinct n-grams, as if no weight were due
        value = np.log10(p)[g.index[0]]  # of tokens
        sums, waits = [], []
        for k in range(1, order):
            around, seen = count[k - 1][g.context[k]], count[k] > 0
            p = np.where(seen, _discounted(count[k], model.d[k]) / np.maximum(around, 1), p[g.lower[k]])
            own = np.flatnonzero(((got[k] & 1) == 1) & ((got[k - 1][g.context[k]] & 2) == 2))
            h, back = np.unique(g.hash[k][own].view(np.int64), return_inverse=True)
            spare = np.bincount(back, weights=count[k][own] - _discounted(count[k][own], model.d[k]), minlength=len(h))
            sums.append((h, spare, np.bincount(back, weights=_discounted(count[k - 1][g.lower[k][own]], model.d[k - 1]), minlength=len(h))))
            tokens = np.flatnonzero(g.index[k] >= 0)
            j = g.index[k][tokens]
            value[tokens] = np.log10(p)[j]
            waits = [x[~np.append(seen, False)[g.index[k][x]]] for x in waits]  # a longer n-gram that was seen stands alone
            waits.append(tokens[(~seen & (around > 0))[j]])
        due = [np.zeros((4, 0), dtype=np.int64)]  # document, context, its count, the count of the context without its first token
        for k, x in enumerate(waits, 1):
            j = g.index[k][x]
            less = count[k - 2][g.context[k - 1][g.lower[k][j]]] if k > 1 else np.full(len(x), int(model.n))
            due.append(np.stack([g.doc[x], g.hash[k][j].view(np.int64), count[k - 1][g.context[k][j]], less]))
        due = np.concatenate(due, axis=1)
        due = due[:, np.lexsort((due[1], due[0]))]
        new = np.flatnonzero(np.append(True, (due[:2, 1:] != due[:2, :-1]).any(axis=0))[: due.shape[1]])
        due, times = due[:, new], np.diff(np.append(new, due.shape[1]))
        h, spare, below = (np.concatenate([np.empty(0, dtype=t), *(x[i] for x in sums)]) for i, t in enumerate((np.int64, float, float)))
        sum_by = lambda x: np.bincount(g.doc, weights=x, minlength=n)
        c = count[0][g.index[0]]
        tables = [
            {"kind": np.zeros(n, dtype=np.int32), "rid": rid, "doc_id": ids, "n_tokens": sum_by(np.ones(len(g.doc))).astype(np.int64), "n_known": sum_by(c > 0).astype(np.int64), "base_score": sum_by(model.base(c)), "score": sum_by(value)},
            {"kind": np.ones(len(h), dtype=np.int32), "h": h, "a": spare, "b": below},
            {"kind": np.full(len(times), 2, dtype=np.int32), "rid": rid[due[0]], "h": due[1], "times": times, "a": due[2].astype(float), "b": due[3].astype(float)},
        ]
        types = {"kind": pa.int32(), "rid": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "h": pa.int64(), "times": pa.int64(), "a": pa.float64(), "b": pa.float64()}
        made = []
        for t in tables:
            m = len(t["kind"])
            made.append(pa.table([t[c] if isinstance(t.get(c), (pa.Array, pa.ChunkedArray)) else pa.array(t[c], k) if c in t else pa.nulls(m, k) for c, k in types.items()], names=list(types)))
        return pa.concat_tables(made)

    told = answers.where("said IS NOT NULL").select("chunk", "part", "kind", "said")
    scored = chunks.select("chunk", "docs").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, DOC_SCHEMA)
    path = f"{scratch_root(spark)}/scored-{uuid.uuid4().hex}"
    scored.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    scored = spark.read.schema(DOC_SCHEMA).parquet(path)
    # alpha = (what discounts of the seen leave, over the context's count) / (1 - the seen ones' share in the shorter context)
    weights = scored.where("kind = 1").groupBy("h").agg(F.sum("a").alias("spare"), F.sum("b").alias("below"))
    waiting = scored.where("kind = 2").select("rid", "h", "times", F.col("a").alias("n"), F.col("b").alias("less"))
    alpha = (F.col("spare") / F.col("n")) / (1 - F.col("below") / F.col("less"))
    more = waiting.join(weights, "h").groupBy(F.col("rid").alias("r")).agg(F.sum(F.col("times") * F.log10(alpha)).alias("more"))
    rows = scored.where("kind = 0")
    return rows.join(more, rows["rid"] == more["r"], "left").select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
