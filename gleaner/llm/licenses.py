"""License scans by diagonal voting (operator 8), in DataFrame operations only.

Every rolling word ``K``-gram of every text is hashed and joined with the positions of the
same hash in the templates (a fixed list, far below a broadcast's bound). A match at word
``p`` of a text and word ``q`` of a template votes for the diagonal ``p - q``; votes are
aggregated by (text, template, diagonal). Neighbouring diagonals within ``DRIFT`` words,
as insertions and deletions leave them, are merged. A span is verified by the words
themselves: matches compare the gram's words besides its hash, and a span holds if its
distinct template positions cover enough of the template.

Phrases (the base) are templates too: a place counts if all of a phrase's grams stand on
one diagonal. Notices are the method's own: longer template texts, found when at least
``COVER`` of their grams match near one diagonal.

One pass reads the texts: each text also sends one row with its word count through the
join, so nothing is scanned or joined twice, and only matches are shuffled.

Defined cases: a null or empty text has 0 words and no labels (empty strings), score 0;
repeated rows are scanned each for itself; very long texts are exploded in place; an empty
table gives no rows; other input columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
DRIFT = 3
COVER = 0.6

#: Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Sentences of well-known public license notices, and labels of the method.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, _SPLIT), "")


def grams(w: Column) -> Column:
    """Structs of place, hash and words of every K-gram; none for fewer words."""
    n = F.size(w)

    def gram(i: Column) -> Column:
        part = [F.get(w, i + j) for j in range(K)]
        return F.struct(i.alias("p"), F.xxhash64(*part).alias("h"), F.concat_ws(" ", *part).alias("g"))

    return F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), gram)).otherwise(F.array().cast("array<struct<p:int,h:bigint,g:string>>"))


def templates(spark: SparkSession, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """(template, label, is_phrase, template_grams, q, h, g): each gram's places in the templates."""
    rows = []
    for number, (text, label) in enumerate((*phrases, *notices)):
        if len(text.split()) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        one = (F.lit(number).alias("template"), F.lit(label).alias("label"), F.lit(number < len(phrases)).alias("is_phrase"), F.lit(text).alias("text"))
        rows.append(F.struct(*one))
    t = spark.range(1).select(F.inline(F.array(*rows)))
    return t.select("template", "label", "is_phrase", grams(words(F.col("text"))).alias("gs")).select(
        "template", "label", "is_phrase", F.size("gs").alias("template_grams"), F.explode("gs").alias("x")
    ).select("template", "label", "is_phrase", "template_grams", F.col("x.p").alias("q"), F.col("x.h").alias("th"), F.col("x.g").alias("tg"))


def votes(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """Votes by (rid, template, diagonal), and one row per text (template null) with n_words."""
    w = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), words(F.col("text")).alias("w"))
    own = F.struct(F.lit(-1).alias("p"), F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("string").alias("g"))
    places = w.select("rid", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(F.array(own), grams(F.col("w")))).alias("x"))
    flat = places.select("rid", "doc_id", "n_words", F.col("x.p").alias("p"), F.col("x.h").alias("h"), F.col("x.g").alias("g"))
    t = F.broadcast(templates(docs.sparkSession, phrases, notices))
    hit = flat.join(t, (flat.h == t.th) & (flat.g == t.tg), "left").filter(F.col("template").isNotNull() | (F.col("p") < 0))
    return hit.groupBy("rid", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("is_phrase").alias("is_phrase"),
        F.first("template_grams").alias("template_grams"),
        F.collect_set("q").alias("qs"),
    )


def merged(voted: DataFrame) -> DataFrame:
    """Spans of neighbouring diagonals that cover enough; a text's own row (template null) stays."""
    w = Window.partitionBy("rid", "template").orderBy("diagonal")
    # a phrase stands on one diagonal; a notice's diagonals merge while they follow closely
    far = F.col("is_phrase") | F.lag("diagonal").over(w).isNull() | (F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT)
    runs = (
        voted.withColumn("new", far.cast("int"))
        .withColumn("span", F.sum("new").over(w))
        .groupBy("rid", "template", "span")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.first("label").alias("label"),
            F.first("is_phrase").alias("is_phrase"),
            F.first("template_grams").alias("template_grams"),
            F.min("diagonal").alias("first_diagonal"),
            F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"),
        )
    )
    covered = F.size("qs")
    enough = F.when(F.col("is_phrase"), covered == F.col("template_grams")).otherwise(covered >= COVER * F.col("template_grams"))
    return runs.filter(F.col("template").isNull() | enough).select(
        "rid",
        "doc_id",
        "n_words",
        "template",
        "label",
        "is_phrase",
        (F.col("first_diagonal") + F.array_min("qs")).cast("long").alias("start"),
        (F.col("first_diagonal") + F.array_max("qs") + K).cast("long").alias("end"),
        (covered / F.col("template_grams")).alias("cover"),
    )


def spans(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """Verified spans: doc_id, label, is_phrase, start and end (words), cover."""
    return merged(votes(docs, phrases, notices)).filter(F.col("template").isNotNull()).drop("rid", "template", "n_words")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: one aggregation of each text's own row and its spans."""
    base = F.col("is_phrase")
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    return (
        merged(votes(docs))
        .groupBy("rid")
        .agg(
            F.max(F.struct(F.col("doc_id"))).alias("d"),
            F.max("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.col("label")).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .select("d.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )


def _oracle() -> str:
    """DuckDB SQL: base places by comparing words, notices by the grams' covered positions.

    Diagonals merge as in ``spans``, so the SQL follows the same definition of a span."""
    texts = [(i, t, lab, i < len(PHRASES)) for i, (t, lab) in enumerate((*PHRASES, *NOTICES))]
    values = ",".join(f"({i}, {re.split(' ', t)!r}, '{lab}', {str(p).lower()})" for i, t, lab, p in texts)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(template, tw, label, is_phrase) AS (VALUES {values}),
tg AS (SELECT template, label, is_phrase, len(tw) - {K - 1} AS n, q, tw[q + 1] AS a, tw[q + 2] AS b, tw[q + 3] AS c FROM (SELECT *, unnest(range(0, len(tw) - {K - 1})) AS q FROM t)),
dg AS (SELECT rid, p, w[p + 1] AS a, w[p + 2] AS b, w[p + 3] AS c FROM (SELECT *, unnest(range(0, greatest(len(w) - {K - 1}, 0))) AS p FROM d)),
m AS (SELECT DISTINCT rid, template, label, is_phrase, n, q, p - q AS diagonal FROM dg JOIN tg USING (a, b, c)),
g AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) AS gap FROM (SELECT DISTINCT rid, template, is_phrase, diagonal FROM m)),
s AS (SELECT *, sum(CASE WHEN is_phrase OR gap IS NULL OR gap > {DRIFT} THEN 1 ELSE 0 END) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM g),
x AS (SELECT rid, template, span, any_value(label) AS label, bool_or(m.is_phrase) AS is_phrase, any_value(n) AS n, min(diagonal) + min(q) AS start, count(DISTINCT q) AS covered FROM s JOIN m USING (rid, template, diagonal) GROUP BY ALL),
ok AS (SELECT * FROM x WHERE CASE WHEN is_phrase THEN covered = n ELSE covered >= {COVER} * n END),
f AS (SELECT rid, count(*) FILTER (is_phrase) AS n_base, min(start) FILTER (is_phrase) AS first_word, max(start) FILTER (is_phrase) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_phrase), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered / n) AS score FROM ok GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN f USING (rid)
"""


ORACLE = _oracle()
