"""License scans by a positional index of rare words.

Templates are short or long notices; the index lists, for each of their words, the template and the place
of the word in it. A template needs a key phrase (base phrases: all of their words), so it can only start where
every word of that phrase stands at its place. It is entered through the one with the highest inverse document
frequency over all texts: a text place of this word less its template place is a start. The other
words' postings are intersected with the text's words at their places relative to that start.

A start is accepted if all words of the key phrase stand at their places and enough of the template's words do.
As the entry word is part of the phrase, no notice is lost, however many a text holds. Everything is column
expressions. Equal texts are looked up once, for a key made of their content.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import whole_text
from reportlake.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


@dataclass(frozen=True)
class Template:
    """``key``: a phrase of the text that must be there; without one, the whole text must. Of any length."""

    label: str
    text: str
    key: str | None = None

    @property
    def words(self) -> list[str]:
        return words_of(self.text)

    @property
    def must(self) -> range:
        """Places that must be filled."""
        words = self.words
        key = words if self.key is None else words_of(self.key)
        at = next((i for i in range(len(words)) if words[i : i + len(key)] == key), None)
        if not key or at is None:
            raise ValueError(f"template {self.label!r}: its text holds no key phrase {self.key!r}")
        return range(at, at + len(key))


# fixed values: phrases and labels of the base rule
BASE = (Template("cc-by", "cc by"), Template("gpl", "general public license"), Template("reserved", "all rights reserved"))
# fixed values: openings of public licence notices
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "use in source and binary forms"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "CC BY-NC"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("mit", "Released under the MIT License", "MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
    Template("public-domain", "This is free and unencumbered software released into the public domain", "released into the public domain"),
)
SHARE = 0.6  # of a template's words that must be at their places


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def _strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def scanned(docs: DataFrame, templates: Sequence[Template], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content, n_words, present, hits): index words of each text, and their places where a template is possible.

    It is possible if all words of some key phrase are in the text, wherever they are.
    """
    lowered = F.translate(whole_text(text), UPPER, LOWER)
    index = vocabulary(templates)
    rows = docs.select(F.col(key), F.sha2(lowered, 256).alias("content"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.withColumn("present", F.array_intersect(_strings(index), F.col("words")))
    keys = sorted({tuple(sorted({t.words[i] for i in t.must})) for t in templates})
    possible = F.lit(False)
    for needed in keys:
        possible = possible | (F.size(F.array_except(_strings(needed), F.col("present"))) == 0)
    placed = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    hits = F.when(possible, F.filter(placed, lambda x: x["word"].isin(index)))
    return rows.select(key, "content", F.size("words").cast("long").alias("n_words"), "present", hits.alias("hits"))


def entries(rows: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(template, word, place): the word of each key phrase with the highest IDF; of equal ones the first in order.

    Document frequencies are counted over all rows; the table has a row for each template.
    """
    spark = rows.sparkSession
    keys = spark.createDataFrame(
        [(n, t.words[i], i) for n, t in enumerate(templates) for i in t.must], "template int, word string, place int"
    )
    seen = rows.select(F.explode("present").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "word", "place"))
    return keys.join(seen, "word", "left").groupBy("template").agg(rarest.alias("e")).select("template", "e.word", "e.place")


def licensed(docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null and empty texts have no words and no labels. Repeated rows each get their result. Very long texts and texts
    with many notices are looked up whole. The score is the largest share of a found template's words, 0 where none is found.
    """
    spark = docs.sparkSession
    templates = [*base, *notices]
    rows = stage(scanned(docs, templates, key, text), "licences")
    # equal texts once; a group of copies is reduced before it meets
    texts = rows.filter("hits IS NOT NULL").groupBy("content").agg(F.first("hits").alias("hits"))
    hits = stage(texts.select("content", F.inline_outer("hits")), "hits")
    # as large as the given templates, whatever the documents are, so they are sent along
    postings = spark.createDataFrame(
        [(n, t.label, n < len(base), len(t.words), len(t.must), place, word, place in t.must) for n, t in enumerate(templates) for place, word in enumerate(t.words)],
        "template int, label string, is_base boolean, size int, needed int, place int, word string, must boolean",
    )
    starts = hits.join(F.broadcast(entries(rows, templates)), "word").select("content", "template", (F.col("pos") - F.col("place")).alias("start"))
    wanted = starts.join(F.broadcast(postings), "template").withColumn("pos", F.col("start") + F.col("place"))
    aligned = wanted.join(hits, ["content", "pos", "word"]).groupBy("content", "template", "start", "label", "is_base", "size", "needed")
    aligned = aligned.agg(F.count(F.lit(1)).alias("filled"), F.count_if("must").alias("held"))
    share = F.col("filled") / F.col("size")
    found = aligned.filter((F.col("held") == F.col("needed")) & (F.col("is_base") | (share >= SHARE)))
    place = F.when(F.col("is_base"), F.col("start").cast("long"))
    labels = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    per_text = found.groupBy("content").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        labels(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"),
        labels("label").alias("labels"),
        F.max(share).alias("score"),
    )
    out = rows.select(key, "content", "n_words").join(per_text, "content", "left")
    return out.select(
        key,
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle(base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES) -> str:
    """DuckDB SQL of the same rule, with every alignment of every index word."""
    templates = [*base, *notices]
    postings = ", ".join(f"('{w}', {i}, {p}, {p in t.must})" for i, t in enumerate(templates) for p, w in enumerate(t.words))
    facts = ", ".join(f"({i}, '{t.label}', {i < len(base)}, {len(t.words)}, {len(t.must)})" for i, t in enumerate(templates))
    return (
        f"WITH p(word, template, place, must) AS (VALUES {postings}), f(template, label, is_base, size, needed) AS (VALUES {facts}),"
        f" d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),"
        " t AS (SELECT k, unnest(words) AS word, unnest(range(0, len(words))) AS pos FROM d),"
        " a AS (SELECT k, template, pos - place AS start, count(*) AS filled, count(*) FILTER (must) AS held FROM t JOIN p USING (word) GROUP BY ALL),"
        " x AS (SELECT k, label, is_base, filled / size AS share, CASE WHEN is_base THEN start END AS start FROM a JOIN f USING (template)"
        f" WHERE held = needed AND (is_base OR filled / size >= {SHARE})),"
        " g AS (SELECT k, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word,"
        " string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM x GROUP BY k)"
        " SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,"
        " coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN g USING (k)"
    )
