"""License scans by diagonal voting, with DataFrame operations only.

Every rolling two-word gram of every text is joined to the positions at which license templates hold that gram. A pair of
positions votes for the diagonal (text position minus template position). Votes are summed by diagonal; neighbouring
diagonals of one template (words put in or left out) are merged into one span; a span counts if enough of the template's
grams voted in it. The join compares the gram's text as well as its hash, so every vote is verified word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_GAP, UPPER, ascii_lower, row_key, split_words

# The phrases and labels of the base scan.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Opening clauses of public license texts and notices, lower-case words only.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied"),
)
MIN_COVERAGE = 0.75
SLACK = 4


def template_grams(spark: SparkSession, templates=TEMPLATES, base=BASE_PHRASES) -> DataFrame:
    """One row per gram of each template: (tmpl, base, label, n_grams, tpos, gram). Its size is fixed by the arguments."""
    rows = []
    for t, (label, words, is_base) in enumerate([(b, p, True) for p, b in base] + [(label, p, False) for label, p in templates]):
        w = words.split()
        rows += [f"({t}, {str(is_base).lower()}, '{label}', {len(w) - 1}, {i}, '{w[i]} {w[i + 1]}')" for i in range(len(w) - 1)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(tmpl, base, label, n_grams, tpos, gram)")


def _words(text: Column) -> Column:
    return split_words(ascii_lower(text), ALNUM_GAP)


def license_spans(docs: DataFrame, templates=TEMPLATES, base=BASE_PHRASES, min_coverage: float = MIN_COVERAGE, slack: int = SLACK) -> DataFrame:
    """Spans of license words: (doc_id, rk, label, base, start, end, coverage), word positions, end exclusive.

    rk = row_key(doc_id, text) tells apart rows of one doc_id. Equal rows give each span once. Null and empty texts and
    texts of one word give none. Base spans cover their whole phrase; others at least min_coverage of their grams, with at
    most `slack` words put in or left out between neighbouring diagonals. In a run of diagonals longer than one template allows
    (a repeated line), each place that covers enough within 2 * slack diagonals is a span.
    """
    spark = docs.sparkSession
    w = _words(F.col("text"))
    grams = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rk"), w.alias("w")).select(
        "doc_id", "rk", F.posexplode(F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))).alias("pos", "gram")
    )
    table = F.broadcast(template_grams(spark, templates, base).withColumn("h", F.xxhash64("gram")).withColumnRenamed("gram", "tgram"))
    votes = grams.withColumn("h", F.xxhash64("gram")).join(table, "h").where("gram = tgram")
    diagonals = votes.groupBy("doc_id", "rk", "tmpl", "base", "label", "n_grams", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.collect_set("tpos").alias("hit"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    exact = diagonals.where("base AND size(hit) = n_grams").select("doc_id", "rk", "label", "base", F.col("diag").alias("start"), (F.col("diag") + F.col("n_grams") + 1).alias("end"), F.lit(1.0).alias("coverage"))
    by_place = Window.partitionBy("doc_id", "rk", "tmpl").orderBy("diag", "lo")
    runs = diagonals.where("NOT base").withColumn("new", F.coalesce((F.col("diag") - F.lag("diag").over(by_place) > slack).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "rk", "tmpl", "base", "label", "n_grams", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("n"), F.min("lo").alias("start"), (F.max("hi") + 2).alias("end")
    )
    fuzzy = merged.where((F.col("n") >= F.col("n_grams") * min_coverage) & (F.col("end") - F.col("start") <= F.col("n_grams") + 1 + 2 * slack))
    # a longer run holds a template more than once, or with others between: each place in it is judged by itself, a place
    # being the diagonals within the words that may be put in
    whole = Window.partitionBy("doc_id", "rk", "tmpl", "run")
    place = Window.partitionBy("doc_id", "rk", "tmpl").orderBy("diag").rangeBetween(0, 2 * slack)
    long_runs = runs.withColumn("words", F.max("hi").over(whole) + 2 - F.min("lo").over(whole)).where(F.col("words") > F.col("n_grams") + 1 + 2 * slack)
    places = long_runs.select(
        "doc_id", "rk", "label", "base", "n_grams", F.size(F.array_distinct(F.flatten(F.collect_list("hit").over(place)))).alias("n"),
        F.min("lo").over(place).alias("start"), (F.max("hi").over(place) + 2).alias("end"),
    )
    fuzzy = fuzzy.select("doc_id", "rk", "label", "base", "n_grams", "n", "start", "end").unionByName(places.where(F.col("n") >= F.col("n_grams") * min_coverage))
    return exact.unionByName(fuzzy.select("doc_id", "rk", "label", "base", "start", "end", (F.col("n") / F.col("n_grams")).alias("coverage")))


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """One row per input row with word count, base places and labels; texts without any license words have zero and null.

    Ties need no rule: all places count. Repeated rows each get their row. Columns of docs other than doc_id and text are
    not read, so clashing names do no harm. An empty table gives an empty result.
    """
    spans = license_spans(docs.select("doc_id", "text"), **options)
    found = spans.groupBy(F.col("doc_id").alias("_d"), F.col("rk").alias("_rk")).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["_d"]) & (rows["rk"] == found["_rk"]), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same scan in DuckDB SQL."""
    rows = []
    for t, (label, words, is_base) in enumerate([(b, p, True) for p, b in BASE_PHRASES] + [(label, p, False) for label, p in TEMPLATES]):
        w = words.split()
        rows += [f"({t}, {str(is_base).lower()}, '{label}', {len(w) - 1}, {i}, '{w[i]} {w[i + 1]}')" for i in range(len(w) - 1)]
    return rf"""
WITH t(tmpl, base, label, n_grams, tpos, gram) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT DISTINCT doc_id, tmpl, base, label, n_grams, pos, tpos, pos - tpos AS diag FROM g JOIN t USING (gram)),
dg AS (SELECT doc_id, tmpl, base, label, n_grams, diag, list(DISTINCT tpos) AS hit, min(pos) AS lo, max(pos) AS hi FROM v GROUP BY ALL),
r0 AS (SELECT *, coalesce((diag - lag(diag) OVER (PARTITION BY doc_id, tmpl ORDER BY diag) > {SLACK})::int, 1) AS new FROM dg WHERE NOT base),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tmpl ORDER BY diag ROWS UNBOUNDED PRECEDING) AS run FROM r0),
m AS (SELECT doc_id, tmpl, label, n_grams, run, len(list_distinct(flatten(list(hit)))) AS n, min(lo) AS s, max(hi) + 2 AS e FROM r GROUP BY ALL),
q AS (SELECT *, max(hi) OVER (PARTITION BY doc_id, tmpl, run) + 2 - min(lo) OVER (PARTITION BY doc_id, tmpl, run) AS words FROM r),
pl AS (SELECT doc_id, label, n_grams, len(list_distinct(flatten(list(hit) OVER p))) AS n, min(lo) OVER p AS s FROM q WHERE words > n_grams + 1 + {2 * SLACK}
  WINDOW p AS (PARTITION BY doc_id, tmpl ORDER BY diag RANGE BETWEEN CURRENT ROW AND {2 * SLACK} FOLLOWING)),
spans AS (SELECT doc_id, label, true AS base, diag AS s, 1.0::double AS coverage FROM dg WHERE base AND len(hit) = n_grams
  UNION ALL SELECT doc_id, label, false, s, n::double / n_grams FROM m WHERE n >= n_grams * {MIN_COVERAGE} AND e - s <= n_grams + 1 + {2 * SLACK}
  UNION ALL SELECT doc_id, label, false, s, n::double / n_grams FROM pl WHERE n >= n_grams * {MIN_COVERAGE}),
f AS (SELECT doc_id, count(*) FILTER (base) AS nb, min(s) FILTER (base) AS fw, max(s) FILTER (base) AS lw,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS bl, array_to_string(list_sort(list(DISTINCT label)), ',') AS la, max(coverage) AS sc FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(nb, 0)::bigint AS n_base, fw::bigint AS first_word, lw::bigint AS last_word, coalesce(bl, '') AS base_labels,
  coalesce(la, '') AS labels, coalesce(sc, 0.0)::double AS score FROM d LEFT JOIN f USING (doc_id)
"""


