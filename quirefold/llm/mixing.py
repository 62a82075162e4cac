"""Mixing sources to target weights by pivotal dependent rounding.

Every document's expected number of copies is its source's target over its source's size. The whole part is taken at
once; of the fractional parts, pairs of one source trade mass, in proportion to their sizes, until one of the two is
integral, so the source's words stay what they were. Groups of a few thousand documents are rounded apart and leave one
fractional document each; these meet in groups of the next level, until each source has one left, which is drawn.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, stage

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
GROUP = 4096
_U = np.uint64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: (skey, source_rank, weight, n_docs, source_size, target).

    sizes: (skey, size). Sources rank by code point, null last; weights repeat by rank. Shares go by weight; what is
    above cap times a source's size is shared again by weight among the rest, until none is above. A source without
    words gets 0. The loop asks Spark for sums only; it ends when no further source reaches its cap.
    """
    per = stage(sizes.groupBy("skey").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), "sources")
    order = Window.orderBy("skey")
    ranked = stage(per.withColumn("source_rank", F.row_number().over(order) - 1), "ranked")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("source_rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * cap if level >= 0 else F.col("source_size") <= 0
        held, free = ranked.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (total - (held or 0.0)) / free if free else level
        if higher <= level or not free:
            break
        level = higher
    level = max(level, 0.0)
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size") * cap))


def _uniform(a: np.ndarray, b: int, seed: int) -> np.ndarray:
    return (mix64(mix64(a.astype(np.int64).view(_U) ^ _U(seed)) + _U(b)) >> _U(11)).astype(float) * 2.0**-53


def round_group(size: np.ndarray, p: np.ndarray, ids: np.ndarray, last: bool, seed: int) -> np.ndarray:
    """Fractions p rounded to 0 or 1 with sum(size * p) unchanged, but for one left fractional (drawn too if last)."""
    out = p.copy()
    u = _uniform(ids, 0, seed) if len(ids) else np.empty(0)
    if len(ids) > 1:
        u = (u + _uniform(np.arange(len(ids)), 1, seed)) % 1.0  # rows of one id draw apart
    held = -1
    for i in range(len(out)):
        q, s = float(out[i]), float(size[i])
        if q <= 0.0 or q >= 1.0:
            continue
        if s <= 0.0:
            out[i] = float(u[i] < q)
            continue
        if held < 0:
            held = i
            continue
        r, t = float(out[held]), float(size[held])
        up, down = min((1.0 - r) * t, q * s), min(r * t, (1.0 - q) * s)  # mass to the held one, and from it
        if u[i] * (up + down) < down:
            move, full_held, full_i = up, (1.0 - r) * t <= q * s, q * s <= (1.0 - r) * t
            r, q = (1.0 if full_held else r + move / t), (0.0 if full_i else q - move / s)
        else:
            move, full_held, full_i = down, r * t <= (1.0 - q) * s, (1.0 - q) * s <= r * t
            r, q = (0.0 if full_held else r - move / t), (1.0 if full_i else q + move / s)
        out[held], out[i] = r, q
        open_ = [j for j in (held, i) if 0.0 < out[j] < 1.0]
        held = open_[0] if open_ else -1
    if last and held >= 0:
        left = float(out[held])
        out[held] = float(u[held] < left)
        over = (float(out[held]) - left) * float(size[held])
        for j in np.flatnonzero((p > 0) & (p < 1) & (size > 0)):  # what the draw put in or left out, smaller rows give back
            if j != held and size[j] <= abs(over) and out[j] == (1.0 if over > 0 else 0.0):
                out[j] = 1.0 - out[j]
                over -= float(size[j]) * (1 if over > 0 else -1)
    return out


def _round_level(rows: DataFrame, last: bool, seed: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "p"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)  # what is left fractional in the end is small
        pdf["p"] = round_group(pdf["size"].to_numpy(), pdf["p"].to_numpy(), pdf["doc_id"].fillna(0).to_numpy().astype(np.int64), last, seed)
        return pdf

    return rows.groupBy("source_rank", "grp").applyInPandas(one, rows.schema)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, group: int = GROUP, seed: int = 20) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken, copies).

    size counts words between blanks; null and empty texts have size 0 and take no words. A null source is one source,
    ranked last. Repeated rows are rounded one by one; reruns agree, however the rows are split, since groups and draws
    come from hashes of doc_id, text and the number among equal rows. An empty table gives an empty result.
    """
    key = F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("!"), F.col("source")))
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sizes = stage(docs.select("doc_id", key.alias("skey"), words.alias("size"), F.xxhash64("text").alias("hash")), "sizes")
    sources = stage(source_targets(sizes.select("skey", "size"), weights, cap).withColumn("groups", F.ceil(F.col("n_docs") / group)), "targets")
    most = sources.agg(F.max("groups")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # equal rows are counted and numbered, so that rows without an id or of one id spread over the groups too
    each = sizes.groupBy("doc_id", "skey", "size", "hash").agg(F.count(F.lit(1)).cast("int").alias("n"))
    each = each.select("doc_id", "skey", "size", "hash", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    rows = each.join(sources, "skey").select(
        "doc_id", "size", "source_size", "target", "source_rank",
        F.pmod(F.xxhash64("doc_id", "size", "hash", "copy", F.lit(seed)), F.col("groups")).alias("grp"),
        F.floor(rate).cast("long").alias("whole"), (rate - F.floor(rate)).alias("p"),
    )
    done = None
    while True:
        last = most <= 1
        rounded = stage(_round_level(rows, last, seed), "rounded")
        decided = rounded.where("p <= 0 OR p >= 1")
        done = decided if done is None else done.unionByName(decided)
        if last:
            break
        rows = rounded.where("p > 0 AND p < 1").withColumn("grp", F.floor(F.col("grp") / group))
        most = math.ceil(most / group)
    copies = F.col("whole") + F.col("p").cast("long")
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
