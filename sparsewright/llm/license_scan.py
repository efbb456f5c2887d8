"""License scan: an exact set-similarity join of text blocks with notice templates, in DataFrame operations only.

A block is a line, or, so that wrapped notices are found, a window of as many
consecutive words as the template has, across line ends; its tokens are a set. A block matches a template if it holds
at least ``THRESHOLD`` of the template's tokens. Tokens are ordered by their
document frequency over the whole table, rarest first (ties by token); then

* prefix filter: a match must hold one of the |T| - need + 1 rarest tokens of T,
  where need = ceil(THRESHOLD * |T|), so only blocks with such a token join;
* length filter: the block must have ``need`` tokens of the templates' vocabulary;
* positional filter: with the first common token at place p of T and place q of
  the block's tokens, 1 + min(tokens left in T, tokens left in the block) must
  reach ``need``;
* the survivors are verified by the exact intersection.

Windows that lie in one line find nothing that the line does not, so only texts
of several lines have them. A matching window holds a prefix token: the words
within a window's length around each one must hold ``need`` tokens of T, and then
every window in there is verified.

The base labels come from phrases whose words stand consecutively anywhere in
the text, across lines too.

Cases: null and empty texts have no words, no labels, null positions and score
0; equal tokens in a block count once; a block can match several templates;
repeated rows get a row each; rows that share an id keep their own results; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.llm.store import cut

# Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

THRESHOLD = (4, 5)

#: label: notice. The list is a parameter of ``scan``; its size does not follow the data.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
    "warranty": "The software is provided as is, without warranty of any kind, express or implied",
    "copyright": "Copyright all rights reserved worldwide, no part may be reproduced without permission",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not in a word (Java's notation).
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The two characters outside ASCII whose lower case has ASCII letters (Kelvin sign, dotted I).
_FOLDED = ("K", "İ")


def tokens(text: str) -> list[str]:
    """Words of a template or phrase."""
    return _WORD.findall(text.translate(str.maketrans(_UPPER, _LOWER)))


def lowered(text: Column) -> Column:
    """A-Z lower-cased. Letters outside ASCII may change too, but stay outside ASCII, so no word of a phrase or template appears or goes."""
    text = F.coalesce(text, F.lit(""))
    odd = F.contains(text, F.lit(_FOLDED[0])) | F.contains(text, F.lit(_FOLDED[1]))
    return F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words_of(low: Column) -> Column:
    """Words of a lower-cased text; an empty array for none."""
    return F.array_remove(F.split(low, _GAP), "")


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def need_of(size: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    return math.ceil(threshold[0] * size / threshold[1])


def vocabulary_of(sets: dict[str, list[str]]) -> list[str]:
    return sorted({t for s in sets.values() for t in s})


def token_sets(templates: dict[str, str]) -> dict[str, list[str]]:
    return {label: sorted(set(tokens(t))) for label, t in sorted(templates.items()) if tokens(t)}


def frequencies(seen: DataFrame) -> dict[str, int]:
    """Document frequency over the whole table of the templates' tokens (column ``seen`` of ``base``); as many rows as the vocabulary has reach the driver."""
    return {r.token: r["count"] for r in seen.select(F.explode("seen").alias("token")).groupBy("token").count().collect()}


def matches(docs: DataFrame, often: dict[str, int], templates: dict[str, str] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, line_no, label, containment) of every block and template that match."""
    sets = token_sets(templates)
    order = sorted(vocabulary_of(sets), key=lambda t: (often.get(t, 0), t))
    place = {t: i for i, t in enumerate(order)}
    entries, prefixes = [], set()
    for label, s in sets.items():
        ranked = sorted(s, key=place.get)
        need = need_of(len(s), threshold)
        for p, token in enumerate(ranked[: len(s) - need + 1]):
            prefixes.add(token)
            entries.append(F.struct(F.lit(token).alias("token"), F.lit(label).alias("label"), F.lit(p).alias("p"), F.lit(need).alias("need"), _strings(ranked).alias("template")))
    least = min(need_of(len(s), threshold) for s in sets.values())
    index = docs.sparkSession.range(1).select(F.inline(F.array(*entries)))
    low = docs.select("doc_id", F.xxhash64("text").alias("text_key"), lowered(F.col("text")).alias("low"))
    # a document without any prefix token has no matching block
    some = low.filter(F.arrays_overlap(words_of(F.col("low")), _strings(sorted(prefixes))))
    lines = some.select("doc_id", "text_key", F.posexplode(F.split("low", "\n")).alias("line_no", "line"))
    # array_intersect keeps the first array's order: the block's tokens come out in the global order
    blocks = lines.select("doc_id", "text_key", "line_no", F.array_intersect(_strings(order), words_of(F.col("line"))).alias("block")).filter(F.size("block") >= least)
    probes = blocks.select("*", F.explode(F.array_intersect("block", _strings(sorted(prefixes, key=place.get)))).alias("token"))
    probes = probes.withColumn("q", F.array_position("block", F.col("token")) - 1)
    joined = probes.join(F.broadcast(index), "token")  # as many rows as the templates have prefix tokens
    left = F.lit(1) + F.least(F.size("template") - F.col("p") - 1, F.size("block") - F.col("q") - 1)
    survivors = joined.filter((F.size("block") >= F.col("need")) & (left >= F.col("need"))).withColumn("common", F.array_intersect("template", "block"))
    # at the first common token alone: later ones would find the same pair again
    return survivors.filter((F.col("token") == F.element_at("common", 1)) & (F.size("common") >= F.col("need"))).select("doc_id", "text_key", "line_no", "label", (F.size("common") / F.size("template")).alias("containment"))


def wrapped(docs: DataFrame, often: dict[str, int], templates: dict[str, str] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, label, containment) of the best window across line ends around each prefix token, where it matches."""
    sets = token_sets(templates)
    place = {t: (often.get(t, 0), t) for t in vocabulary_of(sets)}
    entries, prefixes, widest = [], set(), 1
    for label, s in sets.items():
        ranked, need, width = sorted(s, key=place.get), need_of(len(s), threshold), len(tokens(templates[label]))
        widest = max(widest, width)
        for token in ranked[: len(s) - need + 1]:
            prefixes.add(token)
            entries.append(F.struct(F.lit(token).alias("token"), F.lit(label).alias("label"), F.lit(need).alias("need"), F.lit(width).alias("width"), _strings(ranked).alias("template")))
    index = docs.sparkSession.range(1).select(F.inline(F.array(*entries)))
    low = docs.filter(F.contains("text", F.lit("\n"))).select("doc_id", F.xxhash64("text").alias("text_key"), words_of(lowered(F.col("text"))).alias("words"))
    rare = _strings(sorted(prefixes))
    some = low.filter(F.arrays_overlap("words", rare))
    # the words around each prefix token, and its place among them
    first = lambda i: F.greatest(i + 2 - widest, F.lit(1))
    around = F.transform("words", lambda w, i: F.when(F.array_contains(rare, w), F.struct(w.alias("token"), (i + 2 - first(i)).alias("at"), F.slice("words", first(i), i + 1 + widest - first(i)).alias("near"))))
    probes = some.select("doc_id", "text_key", F.inline(F.array_compact(around))).join(F.broadcast(index), "token")
    begin = F.greatest(F.col("at") - F.col("width") + 1, F.lit(1))
    probes = probes.withColumn("near", F.slice("near", begin, F.col("at") - begin + F.col("width")))
    survivors = probes.filter(F.size(F.array_intersect("template", "near")) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("near") - F.col("width") + 1, F.lit(1)))
    common = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect("template", F.slice("near", i, F.col("width"))))))
    best = survivors.withColumn("common", common).filter(F.col("common") >= F.col("need"))
    return best.select("doc_id", "text_key", "label", (F.col("common") / F.size("template")).alias("containment"))


def _starts(words: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively."""
    parts = phrase.split()
    at = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: _all(F.get(words, i + k) == p for k, p in enumerate(parts)))


def _all(tests) -> Column:
    tests = list(tests)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def base(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, text_key, n_words, n_base, first_word, last_word, base_set) by the phrases alone, and ``seen``, the text's distinct words of the vocabulary."""
    none = F.array().cast("array<int>")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(lowered(F.col("text"))).alias("words"))
    rows = rows.select("doc_id", "text_key", "words", F.array_intersect("words", _strings(sorted({*vocabulary, *" ".join(PHRASES).split()}))).alias("some"))
    for k, phrase in enumerate(PHRASES):
        # most documents lack the phrase's words and skip the scan for places
        held = _all(F.array_contains("some", w) for w in phrase.split())
        rows = rows.withColumn(f"at{k}", F.when(held, _starts(F.col("words"), phrase)).otherwise(none))
    every = F.concat(*(F.col(f"at{k}") for k in range(len(PHRASES))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))))
    return rows.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base_set"), F.array_intersect("some", _strings(vocabulary)).alias("seen"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    The score is 1 for a base phrase, else the largest containment of a match, else 0.
    """
    a = cut(base(docs, vocabulary_of(token_sets(templates))), "license-base")
    often = frequencies(a)
    found = matches(docs, often, templates, threshold).drop("line_no").unionByName(wrapped(docs, often, templates, threshold))
    per_doc = found.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "m_doc", "text_key": "m_key"})
    joined = a.join(per_doc, a["doc_id"].eqNullSafe(per_doc["m_doc"]) & (a["text_key"] == per_doc["m_key"]), "left")
    labels = F.array_sort(F.array_union("base_set", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_set"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql(templates: dict[str, str] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> str:
    """The same by comparing every line with every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    rows = ", ".join(f"('{label}', {sorted(set(tokens(t)))!r}, {need_of(len(set(tokens(t))), threshold)})" for label, t in templates.items())
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE " + " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split())) for phrase, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
places AS ({phrases}),
t(label, tokens, need) AS (VALUES {rows}),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split({low}, chr(10))), '{word}')) AS b FROM documents),
found AS (SELECT doc_id, label, max(len(list_intersect(b, tokens)) / len(tokens)) AS c FROM lines, t WHERE len(list_intersect(b, tokens)) >= need GROUP BY 1, 2),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi FROM places GROUP BY 1),
names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY 1),
every AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM found) GROUP BY 1),
best AS (SELECT doc_id, max(c) AS c FROM found GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(names.s, '') AS base_labels, coalesce(every.s, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""
