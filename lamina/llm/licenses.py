"""Licence scans as an exact set-similarity join, in column expressions only.

A text block is a run of consecutive words, somewhat longer than the template it is held against
(``window``; a shorter text is one block), so line breaks inside a notice do not matter and words
scattered over a long text do not add up. A block matches a template when it holds at least
``PERCENT`` of the template's distinct words (containment), every word by which the template's
licence is told from others, and none of the words that make it another licence. Texts are cut into
chunks that overlap by a block, so each block lies whole in the chunk where it begins. Words in no
template can't count, and a template's words are put in order of global frequency, rarest first. Then

* prefix filter: with ``need`` words of a template's n to share, a chunk's rarest word of the
  template is one of the ``n - need + 1`` rarest; only chunks that hold such a word are joined;
* length filter: a chunk with fewer words than the template needs is out;
* positional filter: from that word on, in order of rarity, chunk and template must share ``need``
  words, with all telling words among those of the chunk.

What is left is verified block by block. Besides, base labels are given where a phrase's words stand
one after the other.

Templates are a parameter of bounded size (``MOST_TEMPLATE_WORDS``), so their words, the words'
counts and the index of their prefixes are small by construction, whatever the corpus.

Results: one row per document, none for an empty table. A null or empty text has no words; rows with
equal id and text have equal results; extra columns are left out. Of very long texts every block is
looked at; the words of one text are held by one task. Blocks that tie count once, as only labels and
the largest containment are kept.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENT, MOST_TEMPLATE_WORDS = 80, 5000
#: Words in which a chunk's blocks begin.
CHUNK = 256
#: The base phrases and their labels, and the word pattern.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    """A notice: its label, its words, those that tell its licence from others, and those that make it another licence."""

    label: str
    text: str
    telling: tuple[str, ...] = ()
    barred: tuple[str, ...] = ()


#: Notices by label, in their licences' own words.
TEMPLATES = [
    Template("mit", "Released under the MIT License.", ("mit",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("charge", "obtaining")),
    Template("apache", "Licensed under the Apache License, Version 2.0.", ("apache",)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", ("general", "public"), ("lesser", "affero")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("general", "public"), ("lesser", "affero")),
    Template("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1.", ("lesser", "general", "public")),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("commons", "attribution"), ("noncommercial", "sharealike", "noderivatives")),
    Template("cc-by", "Licensed under CC BY 4.0 International.", ("cc", "by"), ("nc", "sa", "nd")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc", "by", "nc")),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc", "by", "sa")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "binary", "forms")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission", "fee", "granted")),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered", "domain")),
]


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def template_words(text: str) -> list[str]:
    """A template's words, as ``words`` gives them (for text in ASCII)."""
    return re.findall("[a-z0-9]+", text.lower())


def need(size: int, percent: int = PERCENT) -> int:
    return -(-size * percent // 100)


def window(text: str) -> int:
    """Words of a block: the template's own, and a quarter more, two at least, for words put in between."""
    n = len(template_words(text))
    return n + max(2, n // 4)


def base_places(own: str, text: str) -> dict[str, Column]:
    """By phrase, the starts of all places; own: column of words, text: column of the lower-case text."""

    def starts(phrase: str) -> Column:
        want = phrase.split()

        def here(i: Column) -> Column:
            hit = F.get(own, i) == want[0]
            for j, w in enumerate(want[1:], 1):
                hit = hit & (F.get(own, i + j) == w)
            return F.coalesce(hit, F.lit(False))

        none = F.array().cast("array<int>")
        there = F.size(own) >= len(want)
        for w in want:
            there = there & F.contains(F.col(text), F.lit(w))
        return F.when(there, F.filter(F.sequence(F.lit(0), F.size(own) - 1), here)).otherwise(none)

    return {p: starts(p) for p in PHRASES}


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def chunks(docs: DataFrame, overlap: int) -> DataFrame:
    """_id, _hash, chunk (words) and is_first: the words of texts in runs of ``CHUNK``, each with ``overlap`` words of what follows."""
    own = docs.select("_id", "_hash", words(F.col("_text")).alias("_w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(CHUNK))
    # outer, as the filter that a plain explode brings along would extract all words once more
    cut = own.select("_id", "_hash", F.posexplode_outer(F.transform(starts, lambda i: F.slice("_w", i + 1, CHUNK + overlap))).alias("_n", "chunk"))
    return cut.select("_id", "_hash", "chunk", (F.col("_n") == 0).alias("is_first"))


def matches(docs: DataFrame, templates: list[Template] | None = None, percent: int = PERCENT) -> DataFrame:
    """_id, _hash, template (its number), label, containment (of a chunk's best block) of templates that match; docs: _id, _hash, _text."""
    known = [Template(*t) for t in templates or TEMPLATES]
    sets = [sorted(set(template_words(t.text))) for t in known]
    universe = sorted({w for own in sets for w in own})
    if not 0 < sum(map(len, sets)) <= MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have from 1 to {MOST_TEMPLATE_WORDS} words together")
    cut = chunks(docs, max(window(t.text) for t in known) - 1)
    # one count for each word of the templates, which are few
    counted = cut.select(F.explode_outer(F.array_intersect(_strings(universe), "chunk")).alias("_word")).groupBy("_word").count().collect()
    count = {r._word: r["count"] for r in counted}
    rank = {w: i for i, w in enumerate(sorted(universe, key=lambda w: (count.get(w, 0), w)))}
    entries, prefix = [], set()
    for number, (t, own) in enumerate(zip(known, sets)):
        own, n = sorted(own, key=rank.get), need(len(own), percent)
        fixed = [F.lit(number).alias("template"), F.lit(t.label).alias("label"), F.lit(window(t.text)).alias("width"), _strings(own).alias("set"), _strings(sorted(set(t.telling))).alias("telling"), _strings(sorted(t.barred)).alias("barred")]
        entries += [F.struct(F.lit(w).alias("_word"), F.lit(n).alias("need"), *fixed) for w in own[: len(own) - n + 1]]
        prefix |= set(own[: len(own) - n + 1])
    # at most MOST_TEMPLATE_WORDS rows
    index = docs.sparkSession.range(1).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    rare = cut.withColumn("rare", F.array_intersect(_strings(sorted(prefix, key=rank.get)), "chunk")).filter(F.size("rare") > 0)
    met = rare.select("_id", "_hash", "chunk", "is_first", F.explode("rare").alias("_word")).join(F.broadcast(index), "_word")
    met = met.filter((F.size("chunk") >= F.col("need")) & (F.col("is_first") | (F.size("chunk") >= F.col("width"))))
    both = F.array_intersect("set", "chunk")
    shared = lambda block, of: F.size(F.array_intersect(block, of))
    # a template is met by the rarest word that it shares, and only once
    met = met.filter((F.get(both, F.lit(0)) == F.col("_word")) & (F.size(both) >= F.col("need")) & (shared("chunk", "telling") == F.size("telling")))

    def held(start: Column) -> Column:
        block = F.slice("chunk", start + 1, F.col("width"))
        good = (shared(block, "telling") == F.size("telling")) & ~F.arrays_overlap(block, "barred")
        return F.when(good, shared(block, "set")).otherwise(0)

    last = F.least(F.greatest(F.size("chunk") - F.col("width"), F.lit(0)), F.lit(CHUNK - 1))
    met = met.withColumn("overlap", F.array_max(F.transform(F.sequence(F.lit(0), last), held))).filter(F.col("overlap") >= F.col("need"))
    return met.select("_id", "_hash", "template", "label", (F.col("overlap") / F.size("set")).alias("containment"))


def license_scan(docs: DataFrame, templates: list[Template] | None = None, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    score: the largest containment of a matching template; 1 for a base phrase alone; else 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), lowered(F.col(text_col)).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    found = matches(rows, templates, percent).groupBy("_id", "_hash").agg(F.max("containment").alias("best"), F.collect_set("label").alias("added"))
    found = found.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "best", "added")
    base = rows.select("_id", "_hash", "_text", words(F.col("_text")).alias("_words"))
    places = base_places("_words", "_text")
    base = base.select("_id", "_hash", F.size("_words").cast("long").alias("n_words"), *(c.alias(f"_p{i}") for i, c in enumerate(places.values())))
    every = F.concat(*(F.col(f"_p{i}") for i in range(len(places))))
    labelled = [F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]
    base = base.select("_id", "_hash", "n_words", every.alias("_places"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labelled)))).alias("_base"))
    out = base.join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    return out.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("added", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def oracle_sql() -> str:
    """The whole scan in DuckDB SQL: every block against every template whose words the text has."""
    listed = lambda xs: "CAST([" + ", ".join(f"'{x}'" for x in xs) + "] AS VARCHAR[])"
    place = {p: " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split())) for p in PHRASES}
    starts = ", ".join(f"CASE WHEN contains(t, '{p.split()[-1]}') THEN list_filter(range(len(w)), lambda i: coalesce({c}, false)) ELSE [] END AS p{k}" for k, (p, c) in enumerate(place.items()))
    every = "p0"
    for k in range(1, len(PHRASES)):
        every = f"list_concat({every}, p{k})"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values())) + "], lambda x: x IS NOT NULL)"
    rows = []
    for t in TEMPLATES:
        own = sorted(set(template_words(t.text)))
        rows.append(f"('{t.label}', {need(len(own))}, {window(t.text)}, {listed(own)}, {listed(t.telling)}, {listed(t.barred)})")
    templates = ", ".join(rows)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
ws AS (SELECT k, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM d),
pl AS (SELECT k, doc_id, len(w) AS n_words, {starts} FROM ws),
b AS (SELECT k, doc_id, n_words, {every} AS ps, {base} AS bl FROM pl),
ts AS (SELECT * FROM (VALUES {templates}) x(label, need, width, own, telling, barred)),
near AS (SELECT k, w, ts.* FROM ws, ts WHERE list_has_all(w, telling) AND len(list_intersect(list_distinct(w), own)) >= need),
win AS (SELECT * EXCLUDE (w, i), w[i + 1:i + width] AS v FROM (SELECT *, unnest(range(0, greatest(len(w) - width, 0) + 1)) AS i FROM near)),
hit AS (SELECT k, label, need, len(own) AS n, len(list_intersect(list_distinct(v), own)) AS o FROM win WHERE list_has_all(v, telling) AND NOT list_has_any(v, barred)),
f AS (SELECT k, max(o / n) AS best, list(DISTINCT label) AS added FROM hit WHERE o >= need GROUP BY k)
SELECT b.doc_id, b.n_words::BIGINT AS n_words, len(ps)::BIGINT AS n_base, list_min(ps)::BIGINT AS first_word, list_max(ps)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(added, [])))), ',') AS labels,
  greatest(coalesce(best, 0.0), CASE WHEN len(bl) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM b LEFT JOIN f USING (k)
"""
