"""License scan: places of fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of as many words as a template has, wherever it stands in a text of several lines: so notices
that are wrapped over lines are found (OP3_SQL has lines only, and finds none of those). Its words and a template's words
are sets; a block meets a template if it holds at least THRESHOLD of the template's words. Words of all templates are put in
one order by how many blocks hold them, rarest first, over all texts that hold enough of them for any template. A block that meets a template of n words, of which
o are needed, must hold one of its n - o + 1 first words (prefix filter), must hold at least o words of any template (length
filter), and from the first shared word on must have o words left in the common order, as the template has (positional
filter: what stands before it in the order can't be shared any more); what passes is verified exactly. For windows the
filters are asked of the whole text first, and windows are taken where a word of the template stands, once for each text
and template. The templates are a parameter, so what is broadcast, and the count of each of their words, which the driver
gets, are as small as they are. Everything is DataFrame functions.

Null text is empty: no words, no places, no labels, score 0. Repeated rows each get a result; rows that share a doc_id share
the labels of their blocks, and so do those without one. Very long texts and lines are scanned whole; a text's words of
templates and their places are in memory at once. Equal containments don't matter: labels are a set, the score is the best.
An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Labels and words of notices.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "Proprietary and confidential: unauthorized copying of this file, via any medium, is strictly prohibited"),
)
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), common.UPPER, common.LOWER)


def _spaced(text: Column) -> Column:
    """Each word between single spaces of its own, so that places of phrases never share a character."""
    inner = F.trim(F.regexp_replace(lowered(text), common.GAP_PATTERN, "  "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _places(spaced: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often, and the first and last word at which the phrase stands; null without a place."""
    part = " " + "  ".join(phrase.split(" ")) + " "
    there = F.contains(spaced, F.lit(part))
    at = lambda before: ((_count(before, " ") - 1) / 2).cast("long")
    first = F.when(there, at(F.substring(spaced, F.lit(1), F.instr(spaced, F.lit(part)))))
    behind = F.instr(F.reverse(spaced), F.lit(part[::-1]))
    last = F.when(there, at(F.substring(spaced, F.lit(1), F.length(spaced) - behind - len(part) + 2)))
    return F.when(there, _count(spaced, part)).otherwise(F.lit(0).cast("long")), first, last


def template_sets(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[int, str, list[str], int]]:
    """Number, label, distinct words and words needed of each template; a template without words meets nothing."""
    out = []
    for k, (label, text) in enumerate(templates):
        words = sorted({w.decode() for w in common.words_of(text.encode())})
        if words:
            out.append((k, label, words, math.ceil(threshold * len(words) - 1e-9)))
    return out


def _literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def prefix_table(spark, sets, order: list[str], templates) -> DataFrame:
    """(token, template, label, template_tokens, need, width, earlier): the words of which a block must hold one, and the
    template's words before each in the common order."""
    rank, rows = {t: k for k, t in enumerate(order)}, []
    for k, label, words, need in sets:
        words = sorted(words, key=rank.__getitem__)
        width = len(common.words_of(templates[k][1].encode()))
        for i in range(len(words) - need + 1):
            rows.append(F.struct(F.lit(words[i]).alias("token"), F.lit(k).alias("template"), F.lit(label).alias("label"), _literals(words).alias("template_tokens"), F.lit(need).alias("need"), F.lit(width).alias("width"), _literals(words[:i]).alias("earlier")))
    if not rows:
        return spark.range(0).selectExpr("'' AS token", "0 AS template", "'' AS label", "array('') AS template_tokens", "0 AS need", "0 AS width", "array('') AS earlier")
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def passing(blocks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Blocks (with tokens in the common order) and the templates that prefix, length and positional filters leave to them,
    each pair once: at its first shared word."""
    probes = blocks.withColumn("token", F.explode("tokens")).join(F.broadcast(prefixes), "token")
    left = F.size("tokens") - F.array_position("tokens", F.col("token")) + 1
    return probes.filter((F.size("tokens") >= F.col("need")) & (left >= F.col("need")) & ~F.arrays_overlap("earlier", "tokens"))


def _blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """(doc_id, tokens): for each line, the distinct words that any template has; lines without one are left out."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(lowered(F.col(text_col)), "\n", -1)).alias("line"))
    words = F.split(F.regexp_replace("line", common.GAP_PATTERN, " "), " ", -1)
    held = F.array_intersect(words, _literals(vocabulary))
    # behind a generator, so that the optimiser doesn't compute the words again for the filter
    return lines.select("doc_id", F.explode(F.array(held)).alias("tokens")).filter(F.size("tokens") > 0)


def _windows(docs: DataFrame, id_col: str, text_col: str, order: list[str], prefixes: DataFrame, least: int) -> DataFrame:
    """(doc_id, template, label, containment) of the best window of each text of several lines and template that it meets."""
    words = F.split(F.regexp_replace("text", common.GAP_PATTERN, " "), " ", -1)
    several = docs.filter(F.contains(F.col(text_col).cast("string"), F.lit("\n")))
    texts = several.select(F.col(id_col).alias("doc_id"), F.explode(F.array(lowered(F.col(text_col)))).alias("text"))
    held = texts.withColumn("tokens", F.explode(F.array(F.array_intersect(_literals(order), words)))).filter(F.size("tokens") >= least)
    found = passing(held, prefixes).filter(F.size(F.array_intersect("template_tokens", "tokens")) >= F.col("need"))
    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    spots = F.filter(placed, lambda x: F.array_contains("template_tokens", x["word"]))
    # behind a generator, so that the optimiser doesn't move the computation into the lambda below
    spread = found.select("doc_id", "template", "label", "template_tokens", "need", "width", F.explode(F.array(spots)).alias("spots"))

    def inside(s, k):
        near = F.filter(F.slice("spots", k + 1, F.col("width")), lambda x: x["at"] < s["at"] + F.col("width"))
        return F.size(F.array_distinct(F.transform(near, lambda x: x["word"])))

    best = spread.withColumn("best", F.explode(F.array(F.array_max(F.transform("spots", inside)))))
    return best.filter(F.col("best") >= F.col("need")).select("doc_id", "template", "label", (F.col("best") / F.size("template_tokens")).alias("containment"))


def matched_blocks(docs: DataFrame, *, id_col="doc_id", text_col="text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, template, label, containment) for each line and template that it meets, and for the best window of a text."""
    spark = docs.sparkSession
    sets = template_sets(templates, threshold)
    vocabulary = sorted({w for _, _, words, _ in sets for w in words})
    least = min((need for *_, need in sets), default=0)
    # no block of a text holds more words of templates than the text: few texts are looked at more than once
    texts = docs.select(F.col(id_col).alias("doc_id"), lowered(F.col(text_col)).alias("text"))
    words = F.split(F.regexp_replace("text", common.GAP_PATTERN, " "), " ", -1)
    held = texts.withColumn("many", F.explode(F.array(F.size(F.array_intersect(_literals(vocabulary), words))))).filter(F.col("many") >= least)
    docs = common.checkpointed(held.select("doc_id", "text"))
    blocks = _blocks(docs, "doc_id", "text", vocabulary)
    counted = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in counted.collect()}  # a row for each word of templates, at most
    order = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    prefixes = prefix_table(spark, sets, order, templates)
    in_order = blocks.filter(F.size("tokens") >= least).withColumn("tokens", F.explode(F.array(F.array_intersect(_literals(order), "tokens"))))
    share = F.size(F.array_intersect("template_tokens", "tokens"))
    found = passing(in_order, prefixes).filter(share >= F.col("need"))
    lines = found.select("doc_id", "template", "label", (share / F.size("template_tokens")).alias("containment"))
    return lines.unionByName(_windows(docs, "doc_id", "text", order, prefixes, least))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = matched_blocks(docs).groupBy("doc_id").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best")).withColumnRenamed("doc_id", "of")
    spaced = docs.select("doc_id", _spaced(F.col("text")).alias("spaced"))
    places = [_places(F.col("spaced"), phrase) for phrase, _ in PHRASES]
    base = spaced.select(
        "doc_id",
        F.when(F.col("spaced") == "", F.lit(0).cast("long")).otherwise((_count(F.col("spaced"), " ") / 2).cast("long")).alias("n_words"),
        *[n.alias(f"n{k}") for k, (n, _, _) in enumerate(places)],
        F.least(*[f for _, f, _ in places]).alias("first_word"),
        F.greatest(*[x for _, _, x in places]).alias("last_word"),
    )
    bare = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"n{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)])))
    n_base = F.col("n0") + F.col("n1") + F.col("n2")
    joined = base.join(found, base["doc_id"].eqNullSafe(found["of"]), "left").withColumn("bare", bare)
    both = F.array_sort(F.array_union("bare", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", n_base.alias("n_base"), "first_word", "last_word",
        F.array_join("bare", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.greatest(F.when(n_base > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    place = lambda words: " AND ".join(f"words[i + {j + 1}] = '{w}'" for j, w in enumerate(words))
    starts = [f"list_filter(range(len(words) - {len(p.split()) - 1}), lambda i: {place(p.split())})" for p, _ in PHRASES]
    values = ", ".join(f"({k}, '{label}', {quoted(words)}, {need})" for k, label, words, need in template_sets())
    lower = f"translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')"
    return f"""
WITH split_words AS (SELECT doc_id, regexp_extract_all({lower}, '{common.WORD_PATTERN}') AS words FROM documents),
starts AS (SELECT doc_id, len(words) AS n_words, {", ".join(f"{s} AS s{k}" for k, s in enumerate(starts))} FROM split_words),
base AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(s0) + len(s1) + len(s2) AS BIGINT) AS n_base,
  CAST(list_min(list_concat(list_concat(s0, s1), s2)) AS BIGINT) AS first_word, CAST(list_max(list_concat(list_concat(s0, s1), s2)) AS BIGINT) AS last_word,
  list_concat(list_concat(CASE WHEN len(s0) > 0 THEN ['{PHRASES[0][1]}'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN len(s1) > 0 THEN ['{PHRASES[1][1]}'] ELSE CAST([] AS VARCHAR[]) END),
    CASE WHEN len(s2) > 0 THEN ['{PHRASES[2][1]}'] ELSE CAST([] AS VARCHAR[]) END) AS bare FROM starts),
lines AS (SELECT doc_id, unnest(string_split({lower}, chr(10))) AS line FROM documents),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{common.WORD_PATTERN}')) AS tokens FROM lines),
templates(template, label, tokens, need) AS (VALUES {values}),
met AS (SELECT b.doc_id, t.label, CAST(len(list_intersect(t.tokens, b.tokens)) AS DOUBLE) / len(t.tokens) AS share FROM blocks b, templates t WHERE len(list_intersect(t.tokens, b.tokens)) >= t.need),
found AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS best FROM met GROUP BY doc_id)
SELECT base.doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(bare), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(bare, coalesce(found, CAST([] AS VARCHAR[]))))), ',') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(best, 0.0::DOUBLE)) AS score
FROM base LEFT JOIN found ON base.doc_id = found.doc_id"""


OP3_SQL = _sql()
