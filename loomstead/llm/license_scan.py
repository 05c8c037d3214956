"""License scans: an exact containment join of text blocks and templates, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import maybe_among, staged

#: What parts words, as a Java and RE2 regular expression.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label: words that stand consecutively.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: label: template text, whose distinct words a block must hold to the threshold (fixed values: the licenses' own words).
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2.0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4.0",
    "cc-by-sa": "this work is licensed under a creative commons attribution share alike license",
    "cc0": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "apache-notice": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-rights": "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
}
#: Percent of a template's distinct words that a block must hold.
CONTAINMENT = 80
#: What parts paragraphs: line ends with no word between them.
BREAK = rf"\n{GAP[:-1]}*\n"


def needed(size: int, percent: int) -> int:
    """Words of a template of `size` distinct words that make the threshold."""
    return -(-percent * size // 100)


def _sequence(template: str) -> list[str]:
    return template.replace(".", " ").replace("-", " ").lower().split()


def width(template: str, percent: int) -> int:
    """Words of a block: the template's own length, and the share that may be missing."""
    return -(-100 * len(_sequence(template)) // percent)


def _lowered(column: Column) -> Column:
    """A-Z lower-cased; no other letter becomes an ASCII one (of those, lower() does this to the Kelvin sign alone)."""
    return F.lower(F.replace(column, F.lit("\u212a"), F.lit("\u0138")))


def _spaced(column: Column) -> Column:
    """The words of a text, lower-cased, each with one blank before and after it."""
    return F.regexp_replace(F.concat(F.lit(" "), _lowered(column), F.lit(" ")), GAP, " ")


def _count(spaced: Column) -> Column:
    """Words of a spaced text."""
    n = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.greatest(F.lit(0), n - 1).cast("long")


def _words(items: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in items]).cast("array<string>")


def _held(spaced: Column, vocabulary: list[str]) -> Column:
    """The words of the templates that a text holds."""
    return F.array_intersect(F.split(spaced, " "), _words(vocabulary))


def vocabulary_of(templates: dict[str, str]) -> list[str]:
    return sorted({w for t in templates.values() for w in _sequence(t)})


def template_prefixes(told: DataFrame, templates: dict[str, str], percent: int) -> DataFrame:
    """A row for each word of each template's prefix, the first (size - needed + 1) in the order of frequency over all texts.

    (word, label, place, size, least, wide, members, following): place is the
    word's in its template's order; following are the words of all templates
    that are as frequent or more. The table grows with the templates only.
    """
    counts = {r["word"]: r["count"] for r in told.select(F.explode("held").alias("word")).groupBy("word").count().collect()}
    vocabulary = sorted(vocabulary_of(templates), key=lambda w: (counts.get(w, 0), w))
    rank, rows = {w: i for i, w in enumerate(vocabulary)}, []
    for label, text in templates.items():
        members = sorted(set(_sequence(text)), key=rank.__getitem__)
        least = needed(len(members), percent)
        for place, word in enumerate(members[: len(members) - least + 1]):
            rows.append((word, label, place, len(members), least, width(text, percent), members, vocabulary[rank[word] :]))
    schema = "word string, label string, place int, size int, least int, wide int, members array<string>, following array<string>"
    return told.sparkSession.createDataFrame(rows, schema)


def candidates(texts: DataFrame, prefixes: DataFrame, widest: int, first_words: list[str]) -> DataFrame:
    """(key, label, size, least, wide, members, around, long_enough, enough_follow) of every place in texts (key, text) where a template's prefix word stands.

    around is the paragraph's words within the template's width of the place:
    every block that holds the place. long_enough is the length filter: as
    many words as are needed. enough_follow is the positional filter: a block
    whose first common word in the order of frequency this is has the rest
    among its own words from there on in that order, and among the template's.
    """
    part = F.explode(F.filter(F.split(_lowered(F.col("text")), BREAK), lambda x: F.arrays_overlap(F.split(F.regexp_replace(x, GAP, " "), " "), _words(first_words)))).alias("part")
    parts = texts.select("key", part).select("key", F.split(F.trim(F.regexp_replace("part", GAP, " ")), " ").alias("s"))
    s = F.col("s")

    def place(w: Column, i: Column) -> Column:
        start = F.greatest(F.lit(0), i - (widest - 1))
        return F.when(w.isin(*first_words), F.struct(w.alias("word"), (i - start).alias("at"), F.slice(s, start + 1, i - start + widest).alias("near")))

    places = parts.select("key", F.explode(F.array_compact(F.transform(s, place))).alias("p"))
    found = places.select("key", "p.*").join(F.broadcast(prefixes), "word")
    start = F.greatest(F.lit(0), F.col("at") - F.col("wide") + 1)
    found = found.withColumn("around", F.slice("near", start + 1, F.col("at") - start + F.col("wide")))
    follow = F.least(F.size(F.array_intersect("around", "following")), F.col("size") - F.col("place"))
    return found.select(
        "key", "label", "size", "least", "wide", "members", "around", (F.size("around") >= F.col("least")).alias("long_enough"), (follow >= F.col("least")).alias("enough_follow")
    )


def _most_held() -> Column:
    """The most of a template's words that a block of its width holds among the words around a place."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("around") - F.col("wide") + 1))
    return F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("around", i, F.col("wide")), "members"))))


def matches(rows: DataFrame, told: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = CONTAINMENT) -> DataFrame:
    """(key, label, containment): every template of which a block of rows (key, text) meets the threshold, and the best block's containment.

    A block is a run of as many consecutive words of one paragraph as the
    template has, and the share that may be missing; paragraphs are parted by
    lines without words. told has the templates' words of each key (held).

    A block meets a template only if it holds a word of the template's prefix
    (see template_prefixes), so an equi-join on these words finds all
    candidates: first on whole texts, of which those that hold too few of a
    template's words are left out; then on the places in what stays. Length
    and positional filters come next (see candidates); what passes is counted
    exactly, block by block. No block that meets the threshold is lost.
    """
    if not templates:
        return rows.select("key", F.lit("").alias("label"), F.lit(0.0).alias("containment")).limit(0)
    prefixes = template_prefixes(told, templates, percent)
    first_words = sorted({r["word"] for r in prefixes.select("word").collect()})
    keys = told.select("key", "held", F.explode("held").alias("word")).join(F.broadcast(prefixes), "word")
    keys = staged(keys.where(F.size(F.array_intersect("held", "members")) >= F.col("least")).select("key").distinct(), "keys")
    texts = maybe_among(rows.select("key", "text"), keys, "key").join(keys, "key", "left_semi")
    found = candidates(texts, prefixes, max(width(t, percent) for t in templates.values()), first_words)
    found = found.where("long_enough and enough_follow").where(F.size(F.array_intersect("around", "members")) >= F.col("least"))
    best = found.withColumn("best", _most_held()).where("best >= least")
    return best.groupBy("key", "label").agg(F.max(F.col("best") / F.col("size").cast("double")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, percent: int = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Words are runs of digits, ASCII letters and all beyond ASCII, with A-Z in
    lower case. Base labels are those of phrases whose words stand
    consecutively; n_base counts their places, first_word and last_word are
    the smallest and largest word numbers at which one starts. labels adds
    those of templates (see matches). score is 1 with a base label, else the
    best containment, 0 without any.

    Null texts are empty. Null ids stay; rows with equal id and text are
    scanned as one and given back as often as they occur; rows that share an
    id only are scanned apart. Very long texts are scanned whole; what is
    joined of them are the words near a template's rare words. Other columns
    are ignored, whatever their names; an empty table gives none. Matched rows
    only are grouped, by row key, so a hot source or label is no hot task.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", key)
    spaced = rows.select("doc_id", "key", _spaced(F.col("text")).alias("spaced"))
    count = F.lit(0)
    first, last, labels = [], [], []
    n_words = _count(F.col("spaced"))
    for label, phrase in phrases.items():
        held, words = F.contains("spaced", F.lit(f" {phrase} ")), phrase.split()
        head, tail = " " + words[0], " " + " ".join(words[1:]) + " " if words[1:] else " "
        count = count + F.when(held, F.regexp_count("spaced", F.lit(f"{head}(?={tail})"))).otherwise(0)
        before = F.substring_index("spaced", f" {phrase} ", 1)
        after = F.substring_index("spaced", f" {phrase} ", -1)
        first.append(F.when(held, F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))))
        last.append(F.when(held, n_words - len(words) - (F.length(after) - F.length(F.replace(after, F.lit(" "), F.lit(""))))))
        labels.append(F.when(held, F.lit(label)))
    base = F.array_sort(F.array_compact(F.array(*labels))).cast("array<string>")
    none = F.lit(None).cast("long")
    told = spaced.select(
        "doc_id", "key", n_words.alias("n_words"), count.cast("long").alias("n_base"), F.least(*first, none, none).cast("long").alias("first_word"),
        F.greatest(*last, none, none).cast("long").alias("last_word"), base.alias("base"), _held(F.col("spaced"), vocabulary_of(templates)).alias("held"),
    )
    told = staged(told, "licenses")
    found = matches(rows, told, templates, percent)
    found = found.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")).withColumnRenamed("key", "of")
    joined = told.join(found, told.key == F.col("of"), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", both).alias("labels"), score.alias("score"))


def oracle(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, percent: int = CONTAINMENT) -> str:
    """The same in DuckDB SQL: every block that starts with a template's word against that template."""
    gap, upper, lower = GAP, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = ", ".join(f"('{k}', {p.split()!r})" for k, p in phrases.items())
    ts = ", ".join(f"('{k}', {len(set(_sequence(v)))}, {width(v, percent)}, {sorted(set(_sequence(v)))!r})" for k, v in templates.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(text, '{gap}'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT * FROM (VALUES {base}) t(label, phrase)),
h AS (SELECT r, label, unnest(list_filter(range(len(ws)::BIGINT), lambda i: ws[i + 1 : i + len(phrase)] = phrase)) AS pos FROM w, p),
b AS (SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM h GROUP BY r),
t AS (SELECT label, size, wide, unnest(words) AS word FROM (VALUES {ts}) t(label, size, wide, words)),
s AS (SELECT r, n, list_filter(regexp_split_to_array(part, '{gap}'), lambda x: x <> '') AS ws FROM (SELECT r, unnest(parts) AS part, unnest(range(len(parts))) AS n FROM (SELECT r, regexp_split_to_array(text, '{BREAK}') AS parts FROM d))),
o AS (SELECT r, n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM s),
v AS (SELECT r, n, pos, label, size, wide, word FROM o JOIN t USING (word)),
f AS (SELECT r, n, label FROM v GROUP BY r, n, label HAVING 100 * count(DISTINCT word) >= {percent} * min(size)),
k AS (SELECT v.* FROM v JOIN f USING (r, n, label)),
c AS (SELECT x.r, x.label, count(DISTINCT y.word) / min(x.size)::DOUBLE AS c FROM k x JOIN k y ON x.r = y.r AND x.n = y.n AND x.label = y.label AND y.pos >= x.pos AND y.pos < x.pos + x.wide
      GROUP BY x.r, x.n, x.label, x.pos HAVING 100 * count(DISTINCT y.word) >= {percent} * min(x.size)),
m AS (SELECT r, label, max(c) AS c FROM c GROUP BY r, label),
g AS (SELECT r, max(c) AS best, list(label) AS labels FROM m GROUP BY r)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(g.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(g.best, 0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN g USING (r)
"""
