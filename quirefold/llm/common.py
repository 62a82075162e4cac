"""Shared pieces of the training-data operators: staging folders, word rules, vectorised hashing of Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word rules, as Java regular expressions of what stands between words.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_U = np.uint64


# ---------------------------------------------------------------- staging
def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or "file:///tmp/checkpoints/quirefold").rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, computed once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Deletes tables written by stage() that no later plan reads."""
    for df in frames:
        path = df._staged_path
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- native columns
def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null reads as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def split_words(text: Column, gap: str) -> Column:
    """Words of a text as array<string>; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """With doc_id, tells apart rows that repeat an id with another text."""
    return F.xxhash64(doc_id, text)


#: Bits of the bitmap that marked() broadcasts: 8 MB, however many keys there are.
MARK_BITS = 26


def marked(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows with `marked`: true for all whose column is among the keys, and for few others while keys are well below 2^26.

    The keys' hashes are set in a bitmap of 2^26 bits, which is broadcast in pieces of 4 KB. The more keys, the more other
    rows are marked too; what is marked must still be joined, so results don't depend on it. Null is never marked.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MARK_BITS))
    keys = keys.toDF("_key").where("_key IS NOT NULL").select(place("_key").alias("_p"))
    pieces = keys.groupBy(F.shiftright("_p", 15).alias("_piece")).agg(F.bitmap_construct_agg(F.col("_p").bitwiseAND(32767)).alias("_bits"))
    rows = rows.withColumn("_p", F.when(F.col(column).isNotNull(), place(column)))
    rows = rows.withColumn("_at", F.shiftright("_p", 15)).join(F.broadcast(pieces), F.col("_at") == F.col("_piece"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, CAST((_p & 32767) div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    bit = F.getbit(byte, (F.col("_p") % 8).cast("int"))
    return rows.withColumn("marked", F.coalesce(bit == 1, F.lit(False))).drop("_p", "_at", "_piece", "_bits")


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n


# ---------------------------------------------------------------- numpy hashing
def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = np.asarray(x, dtype=_U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BASE, _INV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}
_BLOCK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n, kept between calls up to one block."""
    if "p" not in _POW or len(_POW["p"]) < n:
        m = max(n, _BLOCK + 4096)
        out = []
        for b in (_BASE, _INV):
            a = np.full(m, b, dtype=_U)
            a[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(a, dtype=_U))
        if n > _BLOCK + 4096:
            return out[0], out[1]
        _POW["p"], _POW["i"] = out
    return _POW["p"], _POW["i"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end), by prefix sums, in blocks of about a megabyte."""
    out = np.empty(len(starts), dtype=_U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            p, inv = _powers(hi - lo + 1)
            s = np.zeros(hi - lo + 1, dtype=_U)
            np.cumsum((data[lo:hi].astype(_U) + _U(1)) * p[: hi - lo], out=s[1:])
            a, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix64((s[e] - s[a]) * inv[a] + (e - a).astype(_U) * _U(0xD6E8FEB86659FD93))
            i = j
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes, elementwise."""
    with np.errstate(over="ignore"):
        return mix64(a * _U(0xA0761D6478BD642F) + (b ^ _U(0xE7037ED1A0B428DB)))


def gram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive hashes; len(h)-k+1 of them, built by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    acc, done, level, span = None, 0, (mix64(h ^ _U(salt)) if salt else h), 1
    while span <= k:
        if k & span:
            part = level[done : done + n]
            acc = part if acc is None else combine(acc, part)
            done += span
        span *= 2
        if span <= k:
            level = combine(level[: len(level) - span // 2], level[span // 2 :])
    return acc


def _luts(gap: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    word, byte = np.ones(256, dtype=bool), np.arange(256, dtype=np.uint8)
    if gap == "space":
        word[[32, 9, 10, 11, 12, 13]] = False
    else:
        word[:0x30] = word[0x3A:0x61] = word[0x7B:0x80] = False
    if lower:
        byte[65:91] = np.arange(97, 123)
        word[65:91] = True
    return word, byte


_LUTS = {"space": _luts("space", False), "space_lower": _luts("space", True), "alnum": _luts("alnum", True)}


class Words:
    """Words of a run of documents: bytes, word bounds, hashes, and the first word of each document."""

    __slots__ = ("data", "ends", "first", "hashes", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: str):
        """data: UTF-8 bytes of all documents; offsets: where each begins, and the end; gap: space, space_lower or alnum."""
        self.data = data
        is_word, lowered = _LUTS[gap]
        word, x = is_word[data], lowered[data]
        before = np.zeros(len(word), dtype=bool)
        before[1:] = word[:-1]
        cuts = offsets[(offsets > 0) & (offsets < len(x))]
        before[cuts] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.zeros(len(x), dtype=bool)
        after[:-1] = word[1:]
        after[cuts - 1] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = word_hashes(x, self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def window_ok(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are of one document; len(starts)-k+1 flags."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.empty(0, dtype=bool)
        last = np.repeat(self.first[1:], self.counts)
        return np.arange(n) + k <= last[:n]


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow text column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, dat = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if off else np.zeros(len(col) + 1, dtype=np.int64)
    data = np.frombuffer(dat, dtype=np.uint8)[offsets[0] : offsets[-1]] if dat is not None and offsets[-1] > offsets[0] else np.empty(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def by_size(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about `most` bytes of text, or one longer document."""
    for b in batches:
        _, off = text_buffers(b.column(b.schema.get_field_index(text)))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
            yield b.slice(i, j - i)
            i = j
