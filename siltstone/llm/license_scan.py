"""License scans by diagonal voting, in DataFrame operations alone.

All rolling word trigrams of every text are joined to the trigrams of the templates; hits that agree on the offset between text and
template (a diagonal) vote together, neighbouring diagonals merge, and a merged span counts as the template's if enough of its
trigrams were seen within a span of about its length. A phrase stands at a place where all its trigrams vote on one diagonal.
The table of templates is a constant, so its broadcast doesn't grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import table

#: Label, whether it is a phrase whose places are counted, words. At most 64 words each.
TEMPLATES = [
    ("mit", True, "under the mit license"),
    ("apache-2", True, "apache license version 2"),
    ("cc-by-nc", True, "cc by nc"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", False, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", False, "licensed under the gnu general public license version 3"),
    ("gpl", False, "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", False, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", False, "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", False, "this is free and unencumbered software released into the public domain"),
]
#: Diagonals at most so far apart merge; the least share of a template's trigrams that makes a span its own.
NEIGHBOURS, COVERAGE = 3, 0.7
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z in lower case, runs of letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def template_rows() -> list[tuple]:
    """(template, label, phrase, grams, tpos, w1, w2, w3) of each trigram."""
    out = []
    for t, (label, phrase, text) in enumerate(TEMPLATES):
        words = text.split()
        grams = len(words) - 2
        out += [(t, label, phrase, grams, k, *words[k : k + 3]) for k in range(grams)]
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses that each text names or quotes.

    Returns (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans): n_base counts all places of the
    phrases, first_word and last_word are their smallest and largest starts (null without one); labels adds those of verified
    spans; score is the largest share of a template's trigrams seen in one span, from 0 to 1; spans lists (label, first_word,
    last_word, coverage) of verified spans. A null text is empty. Equal rows that repeat an id get the same result each, rows with one id and
    different texts results of their own, null ids as well. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("same"), words_of(F.col("text")).alias("words"))
    far = F.lit(1 << 30)
    grams = rows.select("doc_id", "same", F.posexplode(F.arrays_zip(F.col("words").alias("w1"), F.slice("words", F.lit(2), far).alias("w2"), F.slice("words", F.lit(3), far).alias("w3"))).alias("pos", "g"))
    grams = grams.select("doc_id", "same", "pos", "g.w1", "g.w2", "g.w3", F.xxhash64("g.w1", "g.w2", "g.w3").alias("hash"))
    templates = spark.createDataFrame(template_rows(), "template int, label string, phrase boolean, grams int, tpos int, t1 string, t2 string, t3 string")
    templates = templates.withColumn("thash", F.xxhash64("t1", "t2", "t3"))
    met = (F.col("hash") == F.col("thash")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3"))
    hits = grams.join(F.broadcast(templates), met)
    seen = F.expr("bit_or(shiftleft(1L, tpos))")
    votes = hits.groupBy("doc_id", "same", "template", "label", "phrase", "grams", (F.col("pos") - F.col("tpos")).alias("start")).agg(seen.alias("seen"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    diagonals = Window.partitionBy("doc_id", "same", "template").orderBy("start")
    votes = votes.withColumn("new", (F.col("start") - F.lag("start", 1, -(1 << 30)).over(diagonals) > NEIGHBOURS).cast("int"))
    votes = votes.withColumn("span", F.sum("new").over(diagonals))
    whole = F.col("phrase") & (F.bit_count("seen") == F.col("grams"))
    spans = votes.groupBy("doc_id", "same", "template", "label", "grams", "span").agg(
        F.expr("bit_or(seen)").alias("seen"),
        F.max(F.bit_count("seen")).alias("alone"),
        F.min("lo").alias("lo"),
        (F.max("hi") + 2).alias("hi"),
        F.count_if(whole).alias("places"),
        F.min(F.when(whole, F.col("start"))).alias("first"),
        F.max(F.when(whole, F.col("start"))).alias("last"),
    )
    fits = F.col("hi") - F.col("lo") + 1 <= 2 * (F.col("grams") + 2)
    spans = spans.withColumn("coverage", F.when(fits, F.bit_count("seen")).otherwise(F.col("alone")) / F.col("grams"))
    verified = F.col("coverage") >= COVERAGE
    base = F.when(F.col("places") > 0, F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("doc_id", "same").agg(
        F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.when((F.col("places") > 0) | verified, F.col("label"))).alias("labels"),
        F.max("coverage").alias("score"),
        F.array_sort(F.collect_list(F.when(verified, F.struct("label", F.col("lo").cast("long").alias("first_word"), F.col("hi").cast("long").alias("last_word"), "coverage")))).alias("spans"),
    )
    texts = rows.select(F.col("doc_id").alias("id"), F.col("same").alias("h"), F.size("words").cast("long").alias("n_words"))
    out = texts.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("same")), "left")
    empty = F.array().cast("array<struct<label:string,first_word:bigint,last_word:bigint,coverage:double>>")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select(F.col("id").alias("doc_id"), "n_words", none("n_base", 0), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0), F.coalesce("spans", empty).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def oracle() -> str:
    values = ", ".join(f"({t}, '{label}', {str(phrase).lower()}, {grams}, {k}, '{a}', '{b}', '{c}')" for t, label, phrase, grams, k, a, b, c in template_rows())
    return rf"""
WITH t(template, label, phrase, grams, tpos, t1, t2, t3) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2),
hit AS (SELECT doc_id, template, label, phrase, grams, tpos, p - 1 AS pos FROM g JOIN t ON w[p] = t1 AND w[p + 1] = t2 AND w[p + 2] = t3),
vote AS (SELECT doc_id, template, label, phrase, grams, pos - tpos AS start, bit_or(CAST(1 AS BIGINT) << tpos) AS seen, min(pos) AS lo, max(pos) AS hi
  FROM hit GROUP BY ALL),
run AS (SELECT *, CASE WHEN start - coalesce(lag(start) OVER x, -1073741824) > {NEIGHBOURS} THEN 1 ELSE 0 END AS new, phrase AND bit_count(seen) = grams AS whole
  FROM vote WINDOW x AS (PARTITION BY doc_id, template ORDER BY start)),
part AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY start) AS span FROM run),
span AS (SELECT doc_id, label, grams, template, span, bit_or(seen) AS seen, max(bit_count(seen)) AS alone, min(lo) AS lo, max(hi) + 2 AS hi,
  count(*) FILTER (whole) AS places, min(start) FILTER (whole) AS first, max(start) FILTER (whole) AS last FROM part GROUP BY doc_id, label, grams, template, span),
cover AS (SELECT *, CAST(CASE WHEN hi - lo + 1 <= 2 * (grams + 2) THEN bit_count(seen) ELSE alone END AS DOUBLE) / grams AS coverage FROM span),
found AS (SELECT doc_id, sum(places) AS n_base, min(first) AS first_word, max(last) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0 OR coverage >= {COVERAGE}) AS labels, max(coverage) AS score FROM cover GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (doc_id)"""
