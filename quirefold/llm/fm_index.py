"""Benchmark decontamination with one FM-index per shard of training text.

A shard is about four megabytes of whole documents. Its words are numbered, its suffixes sorted by prefix doubling, and
the Burrows-Wheeler column kept as a wavelet matrix of packed bits. Test phrases are found by backward search, all at
once; occurrences are located by walking back to the nearest sampled suffix; spans to remove are merged by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Words, by_size, text_buffers

WINDOW = 10
#: (item, window) pairs that are broadcast at once; a longer benchmark is searched in more blocks.
BLOCK_PAIRS = 100_000
SAMPLE = 8
_U = np.uint64


def sort_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order. Two suffixes must differ before either ends."""
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0) + 1).bit_length())
    span = max(1, min(63 // bits, n))
    key = np.zeros(n, dtype=np.int64)
    for i in range(span):
        key <<= bits
        key[: n - i] |= symbols[i:] + 1
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots):
        at = order[slots]
        behind = np.where(at + span < n, rank[np.minimum(at + span, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + behind
        o = np.argsort(key)
        key, at = key[o], at[o]
        order[slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        slots = slots[~(new & np.append(new[1:], True))]
        span *= 2
    return order


class Bits:
    """A bit vector with rank in constant time: packed words and counts before each."""

    __slots__ = ("before", "words")

    def __init__(self, flags: np.ndarray):
        padded = np.zeros((len(flags) // 64 + 1) * 64, dtype=bool)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(_U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((_U(1) << (i & 63).astype(_U)) - _U(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(_U)) & _U(1) == 1


class Wavelet:
    """A wavelet matrix over small integers: rank of a symbol, and access with rank, over whole arrays of queries."""

    def __init__(self, x: np.ndarray, size: int):
        self.depth = max(1, (size - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            b = (x >> level) & 1 == 1
            self.levels.append(Bits(b))
            self.zeros.append(int(len(x) - np.count_nonzero(b)))
            x = np.concatenate([x[~b], x[b]])

    def rank(self, c: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often symbol c stands before each place."""
        at = [np.zeros_like(places[0]), *places]
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (c >> (self.depth - 1 - level)) & 1 == 1
            for k, i in enumerate(at):
                r = bits.rank(i)
                at[k] = np.where(one, zeros + r, i - r)
        return [i - at[0] for i in at[1:]]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(i)
            r, s = bits.rank(i), bits.rank(start)
            i, start = np.where(one, zeros + r, i - r), np.where(one, zeros + s, start - s)
            c = c * 2 + one
        return c, i - start


class FMIndex:
    """Index of the words of several documents; phrases never reach over the end of a document."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, sample: int = SAMPLE):
        """hashes: a hash for each word; first: where each document's words begin, and the end."""
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        n_docs = len(first) - 1
        self.doc_start = first[:-1] + np.arange(n_docs)  # with one separator behind each document
        n = len(hashes) + n_docs
        word_at = np.ones(n, dtype=bool)
        word_at[first[1:] + np.arange(n_docs)] = False
        symbols = np.zeros(n, dtype=np.int64)
        symbols[word_at] = ids + 1
        unique = symbols + n_docs - 1
        unique[~word_at] = np.arange(n_docs)
        order = sort_suffixes(unique)
        column = symbols[order - 1]
        column[order == 0] = 0
        self.wavelet = Wavelet(column, len(self.vocabulary) + 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.vocabulary) + 1))])
        kept = order % sample == 0
        begins = np.zeros(n, dtype=bool)
        begins[self.doc_start] = True
        kept |= begins[order]
        self.kept, self.samples = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the phrases, given as word hashes aligned to the right of a matrix."""
        ids = np.searchsorted(self.vocabulary, phrases)
        ids = np.minimum(ids, len(self.vocabulary) - 1)
        used = np.arange(phrases.shape[1]) >= phrases.shape[1] - lengths[:, None]
        known = self.vocabulary[ids] == phrases
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.zeros(len(phrases), dtype=np.int64)
        live = np.flatnonzero((known | ~used).all(axis=1) & (lengths > 0))
        c = ids[live, -1] + 1
        lo[live], hi[live] = self.less[c], self.less[c + 1]
        for col in range(phrases.shape[1] - 2, -1, -1):
            live = live[hi[live] > lo[live]]
            go = live[used[live, col]]
            if not len(go):
                break
            c = ids[go, col] + 1
            a, b = self.wavelet.rank(c, lo[go], hi[go])
            lo[go], hi[go] = self.less[c] + a, self.less[c] + b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions (separators counted) of suffix rows."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            done = self.kept.get(r)
            out[open_[done]] = self.samples[self.kept.rank(r[done])] + steps[open_[done]]
            open_ = open_[~done]
            c, k = self.wavelet.access(rows[open_])
            rows[open_] = self.less[c] + k
            steps[open_] += 1
        return out


# ---------------------------------------------------------------- Spark side
def benchmark_pairs(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id string, phrase binary) of all windows; a shorter item is one window, one without words none.

    Items without an id keep their windows, with a null item_id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            w = Words(*text_buffers(b.column(1)), "alnum")
            items, phrases = [], []
            for d, item in enumerate(b.column(0).to_pylist()):
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                for s in range(lo, max(hi - window, lo) + 1) if hi > lo else ():
                    items.append(item)
                    phrases.append(w.hashes[s : min(s + window, hi)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(phrases, pa.binary())], ["item_id", "phrase"])

    rows = benchmark.select(F.col("item_id").cast("string"), "text")
    return rows.mapInArrow(cut, "item_id string, phrase binary").distinct()


def phrase_blocks(pairs: DataFrame, block_pairs: int = BLOCK_PAIRS) -> list:
    """The pairs as broadcasts of about block_pairs each, brought over the driver one block at a time."""
    spark = pairs.sparkSession
    n = pairs.count()
    blocks = math.ceil(n / block_pairs)
    out = []
    for k in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("item_id", "phrase"), F.lit(blocks)) == k).toPandas() if blocks > 1 else pairs.toPandas()
        part = part.sort_values(["phrase", "item_id"])
        codes, uniques = part["phrase"].factorize()
        lengths = np.array([len(p) // 8 for p in uniques], dtype=np.int64)
        matrix = np.zeros((len(uniques), max(lengths, default=1)), dtype=_U)
        for i, p in enumerate(uniques):
            matrix[i, matrix.shape[1] - lengths[i] :] = np.frombuffer(bytes(p), dtype=_U)
        named = part["item_id"].notna().to_numpy()
        first = np.searchsorted(codes[named], np.arange(len(uniques) + 1))
        out.append(spark.sparkContext.broadcast((matrix, lengths, first, part["item_id"][named].to_numpy(dtype=str))))
    return out


HIT_SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, text string"


def _search_shard(batch: pa.RecordBatch, blocks: list, with_text: bool) -> pa.RecordBatch:
    w = Words(*text_buffers(batch.column(1)), "alnum")
    counts, n_docs = w.counts, batch.num_rows
    change = np.zeros(len(w.hashes) + n_docs + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    if blocks and len(w.hashes):
        index = FMIndex(w.hashes, w.first)
        for b in blocks:
            phrases, lengths, first, names = b.value
            if len(blocks) > 1:
                b.__dict__.pop("_value", None)  # one block in memory at a time
            lo, hi = index.search(phrases, lengths)
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            n = (hi - lo)[found]
            which = np.repeat(found, n)
            at = index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[found], n))
            np.add.at(change, at, 1)
            np.add.at(change, at + lengths[which], -1)
            doc = np.searchsorted(index.doc_start, at, side="right") - 1
            for d, p in np.unique(np.stack([doc, which]), axis=1).T:
                items.setdefault(int(d), set()).update(names[first[p] : first[p + 1]].tolist())
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    starts, ends = edges[::2], edges[1::2]
    doc_start = w.first[:-1] + np.arange(n_docs)
    doc = np.searchsorted(doc_start, starts, side="right") - 1
    offsets = pa.array(np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32))
    spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(starts - doc_start[doc]), pa.array(ends - doc_start[doc])], ["start", "end"]))
    texts = pa.array([None] * n_docs, pa.string())
    if with_text:
        texts = _cut_texts(batch.column(1), w, doc, starts - doc, ends - doc)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).cast(pa.int64()), pa.array(counts), spans, pa.array([sorted(items.get(d, ())) for d in range(n_docs)], pa.list_(pa.string())), texts], ["doc_id", "n_words", "spans", "items", "text"]
    )


def _cut_texts(col: pa.Array, w: Words, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Texts without the words of the spans; starts and ends count the words of the shard."""
    data, offsets = text_buffers(col)
    out = col.to_pylist()
    for d in np.unique(doc):
        raw, base, pieces, at = data[offsets[d] : offsets[d + 1]].tobytes(), int(offsets[d]), [], 0
        for s, e in zip(starts[doc == d], ends[doc == d], strict=True):
            pieces.append(raw[at : int(w.starts[s]) - base])
            at = int(w.ends[e - 1]) - base
        out[d] = b"".join([*pieces, raw[at:]]).decode("utf-8", "replace")
    return pa.array(out, pa.string())


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_text: bool = False, keep: tuple[str, ...] = (), block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per document: n_words, merged spans of hit words (end exclusive), and the items found, sorted as strings.

    with_text adds the text without the hit words; keep names further columns of docs to carry along. Null and empty
    texts have no words and no spans; an empty benchmark hits nothing; items without an id hit, but aren't in
    the list of items; repeated documents and repeated items change nothing else; a document longer than a shard is a shard of its own.
    """
    pairs = benchmark_pairs(benchmark.select("item_id", "text"), window)
    blocks = phrase_blocks(pairs, block_pairs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches):
            hit = _search_shard(b, blocks, with_text)
            yield pa.RecordBatch.from_arrays([*hit.columns, *b.columns[2:]], [*hit.schema.names, *(f"_k{i}" for i in range(len(keep)))])

    more = "".join(f", _k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = docs.select("doc_id", "text", *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep))).mapInArrow(search, HIT_SCHEMA + more)
    return out.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


def contamination_digest(hits: DataFrame) -> DataFrame:
    """The contract's columns of find_contamination()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def oracle(window: int = WINDOW) -> str:
    """The contract's columns in DuckDB SQL, every window compared as text."""
    words = lambda t: f"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents),
b AS (SELECT item_id::varchar AS item, {words("text")} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least({window}, len(w)) AS n, array_to_string(w[i : i + least({window}, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {window - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT doc_id, n, i, item FROM g JOIN p USING (n, phrase)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(len(items), 0)::bigint AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
