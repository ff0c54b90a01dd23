"""License scans by an exact set-similarity join of text blocks with templates.

A template is a label and a notice; its set are its distinct words. A block is a window of a text's
words; windows of a template overlap by half and are at least twice as long as it, so what fits a
template's length lies whole in one. A block meets a template when it holds at least `threshold` of
the template's words. Blocks are cut only in texts that hold as much as a whole. Words are ordered by the number of rows of the whole table that hold them,
rarest first, ties by the word. Then

* prefix: of a template of n words that must share o, one of the first n - o + 1 is in the block, and
  the first word shared is among the block's first m - o + 1; blocks and templates meet by an equi-join
  on these words;
* length: a block of fewer than o template words is left out before the join;
* position: a pair stays only if what follows the word shared in both can still give o;
* the pairs left are verified by the intersection of their sets.

Only words of templates are kept in blocks; others can match nothing. Equal sets of blocks are joined
once. What is collected or broadcast is bounded by the templates: their words and their order.

Besides, the plain phrases of PHRASES are found wherever their words stand consecutively (base).

Everything is DataFrame functions. Edge cases: a null text is empty; empty texts have no words, no
labels (''), null positions and score 0; texts of any length are read whole; repeated rows and null
ids stay, each decided by its own text; an empty table gives an empty result; other columns, of
whatever names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Phrases and labels of the base.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that public licenses ask to be given, or that are customary.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Signs that part words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def _array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def words_of(text: Column, plain: bool) -> Column:
    """The words of a text, A-Z in lower case. plain: letters other than A-Z may change case too, as no
    word that is sought has one; two signs whose small letters are ASCII are kept from that."""
    text = F.coalesce(text, F.lit(""))
    low = F.translate(text, _UPPER, _LOWER)
    if plain:
        low = F.when(text.contains("\u212a") | text.contains("\u0130"), low).otherwise(F.lower(text))
    return F.array_remove(F.split(low, _BETWEEN), "")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _phrase_places(norm: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places, first and last word of a phrase in words with a space before and after each
    (0 and nulls without one)."""
    held = " " + " ".join(template_words(phrase)) + " "
    there = norm.contains(held)
    n = F.when(there, F.regexp_count(norm, F.lit(" (?=" + re.escape(held[1:]).replace("\\ ", " ") + ")")).cast("long")).otherwise(0)
    first = F.locate(held, norm)
    last = F.length(norm) - F.locate(held[::-1], F.reverse(norm)) - len(held) + 2
    word = lambda at: F.when(there, _spaces(F.substring(norm, F.lit(1), at)) - 1)
    return n, word(first), word(last)


class Templates:
    """Templates as sets: bounded by the templates given. Words in no order until ordered()."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float):
        self.rows = []  # label, width of its blocks, words, words that must be shared
        for label, text in templates:
            words = template_words(text)
            if not words:
                raise ValueError(f"template of {label!r} has no word")
            own = sorted(set(words))
            self.rows.append((label, 2 << max(0, math.ceil(math.log2(len(words)))), own, max(1, math.ceil(threshold * len(own) - 1e-9))))
        self.widths = sorted({r[1] for r in self.rows})
        self.words = sorted({w for r in self.rows for w in r[2]})

    def ordered(self, held: dict[str, int]) -> Templates:
        """With words in the global order: those of the fewest rows first, ties by the word."""
        rank = lambda w: (held.get(w, 0), w.encode())
        self.words = sorted(self.words, key=rank)
        self.rows = [(label, width, sorted(own, key=rank), need) for label, width, own, need in self.rows]
        return self

    def of(self, width: int) -> tuple[list[str], int]:
        """Words of the templates of a width, in order, and the least that one must share."""
        mine = [r for r in self.rows if r[1] == width]
        words = {w for r in mine for w in r[2]}
        return [w for w in self.words if w in words], min(r[3] for r in mine)

    def near(self, held: Column, width: int | None = None) -> Column:
        """Whether a set of words holds enough of some template (of a width)."""
        out = F.lit(False)
        for _, w, own, need in self.rows:
            if width in (None, w):
                out = out | (F.size(F.array_intersect(held, _array(own))) >= need)
        return out

    def index(self, spark) -> DataFrame:
        """(width, word, at, template, label, words, need): the prefix words of each template."""
        rows = [
            F.struct(F.lit(width).alias("width"), F.lit(w).alias("word"), F.lit(at).alias("at"), F.lit(t).alias("template"), F.lit(label).alias("label"), _array(own).alias("words"), F.lit(need).alias("need"))
            for t, (label, width, own, need) in enumerate(self.rows) for at, w in enumerate(own[: len(own) - need + 1])
        ]
        return spark.range(1).select(F.inline(F.array(*rows)))


def _windows(words: Column, held: Column, templates: Templates) -> Column:
    """Distinct (width, s) of the blocks of a text that could meet a template: s, its template words.
    held: the template words of the whole text, which leave out widths of which none can be met."""
    out = []
    for width in templates.widths:
        own, least = templates.of(width)
        step = width // 2
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step))
        blocks = F.transform(starts, lambda i: F.array_intersect(_array(own), F.slice(words, i + 1, width)))
        found = F.transform(F.array_distinct(F.filter(blocks, lambda s: F.size(s) >= least)), lambda s: F.struct(F.lit(width).alias("width"), s.alias("s")))
        out.append(F.when(templates.near(held, width), found).otherwise(F.array().cast("array<struct<width:int,s:array<string>>>")))
    return F.concat(*out)


def set_join(blocks: DataFrame, ordered: Templates) -> DataFrame:
    """(width, s, label, share): every block set that meets a template, by the greatest share of one."""
    sets = blocks.select("width", "s").distinct().withColumnRenamed("s", "given").withColumn("s", F.array_intersect(_array(ordered.words), "given"))
    least = F.coalesce(*[F.when(F.col("width") == w, ordered.of(w)[1]) for w in ordered.widths])
    probe = sets.select("width", "given", "s", F.posexplode(F.slice("s", F.lit(1), F.size("s") - least + 1)).alias("place", "word"))
    met = probe.join(F.broadcast(ordered.index(blocks.sparkSession)), ["width", "word"])
    follow = 1 + F.least(F.size("s") - F.col("place") - 1, F.size("words") - F.col("at") - 1)
    pairs = met.where((F.size("s") >= F.col("need")) & (follow >= F.col("need"))).select("width", "given", "s", "template", "label", "words", "need").distinct()
    both = F.size(F.array_intersect("words", "s"))
    return pairs.where(both >= F.col("need")).groupBy("width", F.col("given").alias("s"), "label").agg(F.max(both / F.size("words")).alias("share"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row; score is
    1 with a base phrase, else the greatest share of a template that was met, else 0."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    told = Templates(templates, threshold)
    said = {w for p, _ in phrases for w in template_words(p)}
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col), all(w.isascii() for w in {*said, *told.words})).alias("words"))
    rows = rows.select("doc_id", "words", F.array_intersect(_array(sorted({*said, *told.words})), "words").alias("held"))
    phrased = F.lit(False)
    for p, _ in phrases:
        phrased = phrased | (F.size(F.array_intersect("held", _array(sorted(set(template_words(p)))))) == len(set(template_words(p))))
    rows = rows.select("doc_id", "words", "held", F.when(phrased, F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).otherwise(" ").alias("norm"))
    places = [_phrase_places(F.col("norm"), p) for p, _ in phrases]
    hits = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(n > 0, F.lit(label)) for (n, _, _), (_, label) in zip(places, phrases, strict=True)]), lambda x: x.isNotNull())))
    ends = lambda f, k: f(*[p[k] for p in places], *[F.lit(None).cast("long")] * 2)
    rows = materialize(rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), sum((p[0] for p in places), F.lit(0)).cast("long").alias("n_base"), ends(F.least, 1).alias("first_word"), ends(F.greatest, 2).alias("last_word"), hits.alias("hits"), "held",
        F.when(told.near(F.col("held")), F.struct(F.sha2(F.array_join("words", " "), 256).alias("digest"), _windows(F.col("words"), F.col("held"), told).alias("blocks"))).alias("b"),
    ), "license-blocks")
    counted = rows.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    ordered = told.ordered({r["w"]: r["n"] for r in counted.collect()})
    rows = rows.withColumn("b", F.when(F.size("b.blocks") > 0, F.col("b")))
    some, none = rows.where("b is not null").select("*", "b.digest"), rows.where("b is null")
    blocks = some.select("digest", F.inline("b.blocks")).distinct()
    found = blocks.join(set_join(blocks, ordered), ["width", "s"]).groupBy("digest").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    every = some.join(found, "digest", "left").unionByName(none, allowMissingColumns=True)
    labels = F.array_sort(F.array_union("hits", F.coalesce("found", F.array().cast("array<string>"))))
    return every.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("hits", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("hits") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.9) -> str:
    """The same by brute force: every window of every text against every template."""
    text = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    told = ", ".join(f"('{label}', {width}, {text(own)}, {need})" for label, width, own, need in Templates(templates, threshold).rows)
    said = ", ".join(f"({text(template_words(p))}, '{label}')" for p, label in phrases)
    return rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT * FROM (VALUES {told}) v(label, width, own, need)), p AS (SELECT * FROM (VALUES {said}) v(said, label)),
b AS (SELECT id, label, i - 1 AS place FROM (SELECT id, w, said, label, unnest(range(1, len(w) - len(said) + 2)) AS i FROM w, p) WHERE w[i:i + len(said) - 1] = said),
s AS (SELECT id, width, list_distinct(w[i + 1:i + width]) AS s FROM (SELECT id, w, width, unnest(range(0, len(w), width // 2)) AS i FROM w, (SELECT DISTINCT width FROM t))),
m AS (SELECT id, label, len(list_intersect(s, own)) / len(own) AS share FROM s JOIN t ON t.width = s.width AND len(list_intersect(s, own)) >= need),
x AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM b GROUP BY 1),
y AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM b UNION SELECT id, label FROM m) GROUP BY 1), z AS (SELECT id, max(share) AS share FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END AS score
FROM w LEFT JOIN x USING (id) LEFT JOIN y USING (id) LEFT JOIN z USING (id)"""


SQL = _sql()
