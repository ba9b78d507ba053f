"""License scan by diagonal voting, in DataFrame operations only.

Every word of a text is hashed once; a rolling hash (a cyclic polynomial: rotated word hashes,
combined by exclusive or) over the next ``GRAM`` words stands for every position.  These are
joined to the positions of the templates' word grams (a fixed, small table, broadcast); the
gram's words are compared at once, so a hash collision is no hit.  Hits vote for the diagonal ``position in the
text - position in the template``.  Diagonals that lie close together (words were inserted or
left out) are merged to spans, and a span counts when it holds at least 75 % of the template's
grams within twice the template's length.  Base phrases are templates of one gram; one shorter than
``GRAM`` has the hash of its own words, at positions of its first word only.

The explode, the hashing, the join and the first aggregation are one stage of generated code; no
row of a position is ever written.  A text's end is a gram of its own, so that texts without
hits give a row too.

Defined results: a null or empty text has 0 words and no label; rows that agree in id and text
give equal rows, one each; null ids are a key like any other; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3
NEAR = 3
COVER = 75
END = " "  # no word

#: The base phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Public notices of well-known licenses.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Distributed under the terms of the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_grams(notices=NOTICES) -> tuple[list[tuple], list[tuple]]:
    """(templates: number, label, base, words, grams, gram size; grams: number, position, words)."""
    templates, grams = [], []
    for t, (label, base, text) in enumerate([(a, True, b) for a, b in BASE] + [(a, False, b) for a, b in notices]):
        words = re.findall("[0-9a-z]+", text.lower())
        k = len(words) if base else min(GRAM, len(words))
        own = [words[i : i + k] for i in range(len(words) - k + 1)]
        templates.append((t, label, base, len(words), len(own), k))
        grams += [(t, i, g) for i, g in enumerate(own)]
    return templates, grams


def rolling(hashes: list[Column]) -> Column:
    """A cyclic polynomial of word hashes; words that are not there count as nothing."""
    turned = lambda c, n: F.shiftleft(c, n).bitwiseOR(F.shiftrightunsigned(c, 64 - n)) if n else c
    out = F.lit(0).cast("long")
    for k, h in enumerate(hashes):
        out = out.bitwiseXOR(F.coalesce(turned(h, 21 * k), F.lit(0).cast("long")))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, with_spans: bool = False) -> DataFrame:
    """A row per document: counts, labels and score; with ``with_spans`` also the verified spans
    (label, first word, word after the last, share of the template)."""
    spark = docs.sparkSession
    templates, grams = template_grams(notices)
    word_hash = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    table = spark.createDataFrame([*grams, (-1, 0, [END])], "t int, t_at int, gram array<string>")
    own = word_hash(F.col("gram"))
    table = table.withColumn("g_hash", rolling([F.get(own, F.lit(k)) for k in range(GRAM)]))
    short = sorted({g[0] for _, _, g in grams if len(g) < GRAM} | {END})
    about = spark.createDataFrame([*templates, (-1, "", False, 0, 1, 1)], "t int, label string, base boolean, t_words int, t_grams int, k int")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.lower(F.replace(text, F.lit("K"), F.lit("é")))  # the one other letter whose lower case is ASCII
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.array_append(F.regexp_extract_all(plain, F.lit(f"({WORD})"), F.lit(1)), END).alias("words"))
    at = d.withColumn("hashes", word_hash(F.col("words"))).select("doc_id", "row_hash", "words", "hashes", F.posexplode("words").alias("at", "word"))
    hashes = [F.get("hashes", F.col("at") + k) for k in range(GRAM)]
    few = F.array_distinct(F.array(*[rolling(hashes[:k]) for k in range(GRAM, 0, -1)]))
    at = at.select("doc_id", "row_hash", "words", "at", F.explode(F.when(F.col("word").isin(short), few).otherwise(F.array(rolling(hashes)))).alias("h"))
    same = (F.col("h") == F.col("g_hash")) & (F.slice("words", F.col("at") + 1, F.size("gram")) == F.col("gram"))
    hits = at.join(F.broadcast(table), same).select("doc_id", "row_hash", "t", "t_at", "at", (F.col("at") - F.col("t_at")).alias("diagonal"))

    row = ["doc_id", "row_hash"]
    votes = hits.groupBy(*row, "t", "diagonal").agg(F.count("*").alias("n"), F.collect_set("t_at").alias("seen"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    order = Window.partitionBy(*row, "t").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    spans = votes.withColumn("new", (gap.isNull() | (gap > NEAR)).cast("int")).withColumn("span", F.sum("new").over(order))
    spans = spans.groupBy(*row, "t", "span").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = spans.join(F.broadcast(about), "t")
    long_enough = F.col("seen") * 100 >= F.col("t_grams") * COVER
    holds = (F.col("t") >= 0) & (F.col("base") | (long_enough & (F.col("hi") - F.col("lo") + F.col("k") <= 2 * F.col("t_words"))))
    is_base = F.col("base") & holds
    share = F.col("seen") / F.col("t_grams")
    end = F.col("t") == -1

    def joined(cond):
        return F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")

    found = F.collect_list(F.when(holds, F.struct("label", F.col("lo").cast("long").alias("first_word"), (F.col("hi") + F.col("k")).cast("long").alias("end_word"), share.alias("share"))))
    out = spans.groupBy(*row).agg(
        F.max(F.when(end, F.col("n"))).alias("copies"),
        F.max(F.when(end, F.col("lo"))).cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(is_base, F.col("n"))), F.lit(0)).alias("base_hits"),
        F.min(F.when(is_base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("hi"))).cast("long").alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(holds).alias("labels"),
        F.round(F.coalesce(F.max(F.when(holds, F.when(F.col("base"), F.lit(1.0)).otherwise(share))), F.lit(0.0)), 6).alias("score"),
        *([F.array_sort(found).alias("spans")] if with_spans else []),
    )
    out = out.withColumn("n_base", (F.col("base_hits") / F.col("copies")).cast("long"))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", *(["spans"] if with_spans else []))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    templates, grams = template_grams()
    lit = "', '"
    g = ", ".join(f"({t}, {i}, ['{lit.join(w)}'])" for t, i, w in grams)
    a = ", ".join(f"({t}, '{label}', {str(base).lower()}, {n}, {m}, {k})" for t, label, base, n, m, k in templates)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g(t, t_at, gram) AS (VALUES {g}),
a(t, label, base, t_words, t_grams, k) AS (VALUES {a}),
p AS (SELECT r, w, unnest(range(len(w))) AS pos FROM d),
h AS (SELECT r, t, t_at, pos, pos - t_at AS diagonal FROM p JOIN g ON w[pos + 1] = gram[1] AND w[pos + 2] = gram[2]
      WHERE list_slice(w, pos + 1, pos + len(gram)) = gram),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal, pos) <= {NEAR} THEN 0 ELSE 1 END AS fresh FROM h),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY diagonal, pos) AS span FROM m),
v AS (SELECT r, t, span, count(*) AS n, count(DISTINCT t_at) AS seen, min(pos) AS lo, max(pos) AS hi FROM s GROUP BY ALL),
f AS (SELECT v.*, label, base, seen / t_grams AS share FROM v JOIN a USING (t)
      WHERE base OR (seen * 100 >= t_grams * {COVER} AND hi - lo + k <= 2 * t_words)),
o AS (SELECT r, coalesce(sum(n) FILTER (base), 0)::BIGINT AS n_base, (min(lo) FILTER (base))::BIGINT AS first_word, (max(hi) FILTER (base))::BIGINT AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        round(max(CASE WHEN base THEN 1.0 ELSE share END)::DOUBLE, 6) AS score FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN o USING (r)"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE = {"op1_license_scan": oracle()}
