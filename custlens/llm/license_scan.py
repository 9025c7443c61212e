"""License scan: sure phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of words, over line breaks too. Templates of similar length share windows: with ``span`` the next power of two from a
template's length, windows are ``2 * span`` words long and begin at every multiple of ``span``, so any run of ``span`` words lies
whole in one, and words that stand further apart never make a license, however long their line is. A template is found in a
block if the block holds at least ``containment`` of the template's distinct words; whole license texts can be templates as well.
The join works on the words of the templates in one global order, rarest in all blocks first:

* prefix filter: a block that reaches the threshold holds one of the first ``size - need + 1`` words of the template,
* length filter: it has ``need`` distinct words of templates at least,
* positional filter: from the first common word on, both sides have ``need`` words left,

and what passes is counted exactly. Words that no template holds cannot count and are dropped before anything is exploded.
Only DataFrame functions are used. Templates are a parameter and bounded, so their words and counts are literals.

Defined cases: a null or empty text has no words, no labels and score 0; a null row id is not needed, rows are told
apart by a number written with them, so repeated rows and ids stay apart; a label found twice is listed once; an empty
table gives an empty result; the other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from custlens.llm.common import column, documents
from custlens.session import materialize

# Phrases that name a license, with its label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wordings by which licenses are usually granted. One license may have several.
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy at apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
]
CONTAINMENT = 0.85

# Between words of lower-cased text: ASCII that is neither digit nor letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: list[tuple[str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per document: ``key, n_words, places, base, found, score``.

    ``places`` are the first words of all phrases, ``base`` the labels of phrases, ``found`` those of templates.
    """
    vocabulary = sorted({word for _, wording in templates for word in wording.split()})
    low = lower_ascii(column(docs, text))
    lines = docs.select(
        F.monotonically_increasing_id().alias("row"), column(docs, key).alias("key"), low.alias("low")
    )
    # Words that no template holds are null.
    marked = F.transform(
        F.filter(F.split("low", GAP), lambda w: w != ""), lambda w: F.when(w.isin(vocabulary), w)
    )
    blocks = F.transform(F.array(marked), lambda words: F.concat(*(_windows(words, *c) for c in _spans(templates, containment))))[0]
    rows = lines.select(
        "row",
        "key",
        F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"),
        *_phrase_columns(phrases),
        blocks.alias("blocks"),
    )
    rows = materialize(rows, "license-blocks")
    found = _join(rows.select("row", F.explode("blocks").alias("b")), vocabulary, templates, containment)
    places = F.array_sort(F.flatten(F.array(*(F.col(f"p{i}") for i in range(len(phrases))))))
    base = F.array(
        *(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))
    )
    none = F.array().cast("array<string>")
    return rows.join(found, "row", "left").select(
        F.col("key").alias(key),
        "n_words",
        places.alias("places"),
        F.array_sort(F.array_distinct(F.filter(base, lambda x: x.isNotNull()))).alias("base"),
        F.coalesce("found", none).alias("found"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def _need(wording: str, containment: float) -> int:
    """Distinct words that a block shares with a template found in it."""
    return math.ceil(containment * len(set(wording.split())) - 1e-9)


def _span(wording: str) -> int:
    return 1 << (len(wording.split()) - 1).bit_length()


def _spans(templates: list[tuple[str, str]], containment: float) -> list[tuple[int, int]]:
    """The spans of the templates, each with the fewest words that a block must share with one of them."""
    least: dict[int, int] = {}
    for _, wording in templates:
        least[_span(wording)] = min(_need(wording, containment), least.get(_span(wording), 1 << 30))
    return sorted(least.items())


def _windows(words: Column, span: int, least: int) -> Column:
    """The known words of each window of ``2 * span`` words, ``span`` words apart, where ``least`` different ones are."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - span - 1, F.lit(0)), F.lit(span))
    known = F.transform(
        starts, lambda i: F.array_distinct(F.filter(F.slice(words, i + 1, 2 * span), lambda w: w.isNotNull()))
    )
    rich = F.filter(known, lambda b: F.size(b) >= least)
    return F.transform(rich, lambda b: F.struct(F.lit(span).alias("span"), b.alias("words")))


def _phrase_columns(phrases: dict[str, str]) -> list[Column]:
    """The places of each phrase; a text is cut into words only if it holds all words of the phrase somewhere."""
    out = []
    for i, phrase in enumerate(phrases):
        parts = phrase.split()
        holds = F.lit(True)
        for part in parts:
            holds = holds & F.col("low").contains(part)
        same = " AND ".join(f"get(w, i + {k}) = '{part}'" for k, part in enumerate(parts))
        places = F.expr(
            "element_at(transform(array(filter(split(low, "
            f"r'{GAP}'), x -> x != '')), w -> filter(sequence(0, size(w)), i -> {same})), 1)"
        )
        out.append(F.when(holds, places).otherwise(F.array().cast("array<int>")).alias(f"p{i}"))
    return out


def _join(blocks: DataFrame, vocabulary: list[str], templates, containment: float) -> DataFrame:
    """``row, found, score``: labels of the templates found in any block of a row, and the best containment."""
    counts = blocks.select(F.explode("b.words").alias("word")).groupBy("word").count().collect()  # the vocabulary at most
    seen = {r["word"]: r["count"] for r in counts}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {word: i for i, word in enumerate(order)}
    # The words of a block as their places in the global order, which are then in that order themselves.
    ranks = F.array_sort(
        F.transform("b.words", lambda w: F.array_position(F.array(*map(F.lit, order)), w).cast("int") - 1)
    )
    entries, wanted = [], set()
    for label, wording in templates:
        ids = sorted({rank[w] for w in wording.split()})
        need = _need(wording, containment)
        for place, token in enumerate(ids[: len(ids) - need + 1]):
            wanted.add(token)
            entries.append(
                F.struct(
                    F.lit(token).alias("token"),
                    F.lit(_span(wording)).alias("span"),
                    F.lit(label).alias("label"),
                    F.lit(place).alias("place"),
                    F.lit(need).alias("need"),
                    F.array(*map(F.lit, ids)).alias("ids"),
                )
            )
    spark = blocks.sparkSession
    prefixes = spark.range(1).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    tokens = (
        blocks.select("row", "b.span", ranks.alias("ranks"))
        .where(F.arrays_overlap("ranks", F.array(*map(F.lit, sorted(wanted)))))
        .select("row", "span", "ranks", F.posexplode("ranks").alias("at", "token"))
    )
    left = F.least(F.size("ids") - F.col("place"), F.size("ranks") - F.col("at"))
    common = F.size(F.array_intersect("ids", "ranks"))
    return (
        tokens.join(F.broadcast(prefixes), ["span", "token"])
        .where((F.size("ranks") >= F.col("need")) & (left >= F.col("need")))
        .withColumn("common", common)
        .where("common >= need")
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_set("label")).alias("found"),
            F.max(F.col("common") / F.size("ids")).alias("score"),
        )
    )


def op4_license_scan(spark, folder):
    rows = scan(documents(spark, folder))
    listed = F.array_join(F.array_sort(F.array_distinct(F.concat("base", "found"))), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        listed.alias("labels"),
        "score",
    )


def _listed(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, {_LOW} AS low, regexp_extract_all({_LOW}, '{WORD}') AS w FROM documents),
phrases(label, p) AS (VALUES {", ".join(f"('{label}', {_listed(p)})" for p, label in PHRASES.items())}),
places AS (
  SELECT doc_id, label, i FROM (
    SELECT doc_id, w, label, p, unnest(range(len(w) - len(p) + 1)) AS i FROM d, phrases WHERE len(w) >= len(p))
  WHERE w[i + 1 : i + len(p)] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS base
  FROM places GROUP BY doc_id),
templates(label, span, t) AS (VALUES {", ".join(f"('{label}', {_span(t)}, list_distinct({_listed(t)}))" for label, t in TEMPLATES)}),
blocks AS (
  SELECT doc_id, span, list_distinct(w[i + 1 : i + 2 * span]) AS b
  FROM (SELECT doc_id, w, span, unnest(range(0, greatest(len(w) - span, 1), span)) AS i
        FROM d, (SELECT DISTINCT span FROM templates))),
matches AS (
  SELECT doc_id, label, len(list_intersect(t, b)) / CAST(len(t) AS DOUBLE) AS share FROM blocks JOIN templates USING (span)
  WHERE len(list_intersect(t, b)) >= ceil({CONTAINMENT} * len(t) - 1e-9)),
found AS (SELECT doc_id, list_distinct(list(label)) AS found, max(share) AS score FROM matches GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '')
         AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
