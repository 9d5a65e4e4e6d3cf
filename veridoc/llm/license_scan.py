"""Licence scan: an exact set-similarity join of text blocks with notice templates.

A template with n distinct words is looked for in blocks of 2 * L words, one from every L-th word on, where
L is the least power of two that is at least 5/4 n: a notice of up to L words lies whole in a block, however
its lines are broken, and words that are far apart are no notice. It is found in a block that holds at
least `threshold` of its distinct words (containment), in any order. The join is exact:

* the words that templates use are ordered by the number of documents of the whole corpus holding them,
  rarest first;
* prefix filter: a block that meets a template's need of o shared words has one of the template's
  first |t| - o + 1 words, and that word is among the first |b| - o + 1 of the block's; texts without any
  such word aren't cut into blocks;
* length filter: a block with fewer than o words of the vocabulary can't meet the need;
* positional filter: from the places of the first common word, at most
  1 + min(|t| - i, |b| - j) words can be shared;
* what is left is verified by intersecting the two ordered sets.

Only the templates, whose number is a parameter, and counts of their words are sent to the executors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import ascii_lower, cut, once, whole

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Common notices, in the wording their licences ask for, with labels.
TEMPLATES = (
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("Licensed under the Apache License Version 2.0", "apache-2.0"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY SA 4.0", "cc-by-sa"),
    ("This work is licensed under the GNU General Public License version 3", "gpl"),
    ("This library is licensed under the GNU Lesser General Public License", "lgpl"),
    ("Redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("This work has been dedicated to the public domain", "public-domain"),
    ("All rights reserved", "reserved"),
)

THRESHOLD = 0.9


def words(text: Column) -> Column:
    """The words of a text in order; A-Z are lowered, separators are the other ASCII characters."""
    return F.filter(F.split(ascii_lower(whole(text)), SEPARATORS), lambda w: w != "")


def _template_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(SEPARATORS, text.lower()) if w))


def _block_key(doc: Column, text: Column) -> list[Column]:
    """Rows with the same id and text have the same findings, so this pair names a document, null ids included."""
    return [F.coalesce(doc.cast("string"), F.lit("null")).alias("_k1"), F.xxhash64(whole(text)).alias("_k2")]


def block_step(n: int) -> int:
    """L for a template of n distinct words."""
    return 1 << max(2, (-(-5 * n // 4) - 1).bit_length())


def _prefixes(docs: DataFrame, text_col: str, templates: Sequence[tuple[str, str]], threshold: float) -> tuple[DataFrame, dict[str, int], list[str]]:
    """(a row for each template and word of its prefix, the order of words, the words of all prefixes)."""
    sets = [(n, label, _template_words(text)) for n, (text, label) in enumerate(templates)]
    vocabulary = sorted({w for *_, ws in sets for w in ws})
    # array_intersect drops repeats; at most one row for each word of the templates comes back
    held = docs.select(F.explode(F.array_intersect(F.split(ascii_lower(whole(F.col(text_col))), SEPARATORS), F.array(*map(F.lit, vocabulary)))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rows = []
    for n, label, ws in sets:
        ranks = sorted(order[w] for w in ws)
        need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
        rows += [(n, label, block_step(len(ranks)), ranks, need, i + 1, r) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    words_of = {i: w for w, i in order.items()}
    return docs.sparkSession.createDataFrame(rows, "template int, label string, step int, _t array<int>, _need int, _i int, _r int"), order, sorted({words_of[r[-1]] for r in rows})


def license_matches(candidates: DataFrame, prefixes: DataFrame, order: dict[str, int]) -> DataFrame:
    """(_k1, _k2, step, block, template, label, containment): every block of `candidates(_k1, _k2, _words)` that meets a template's threshold.

    `block` is its first word, `template` the template's place.
    """
    steps = {r["step"]: r["least"] for r in prefixes.groupBy("step").agg(F.min("_need").alias("least")).collect()}  # a few
    rank, known = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))]), F.array(*map(F.lit, order))
    parts = []
    for step, least in steps.items():
        # blocks are cut inside the array: a row for each with the whole text beside it would be the text's square
        made = F.transform(F.sequence(F.lit(0), F.size("_words") - 1, F.lit(step)), _block(step, known))
        b = candidates.select("_k1", "_k2", F.explode(F.filter(made, _has(least))).alias("_x")).select("_k1", "_k2", "_x.*")
        b = b.select("_k1", "_k2", F.lit(step).alias("step"), "block", F.array_sort(F.transform("_b", lambda w: rank[w])).alias("_b"))
        # The block's own prefix for the smallest need; a template with a larger need takes a shorter one below.
        parts.append(b.select("*", F.posexplode(F.slice("_b", F.lit(1), F.size("_b") - least + 1)).alias("_j0", "_r")))
    b = reduce(DataFrame.union, parts)
    size_b, size_t, j = F.size("_b"), F.size("_t"), F.col("_j0") + 1
    met = (
        b.join(F.broadcast(prefixes), ["_r", "step"])  # a row for each prefix word of the templates given
        .filter((size_b >= F.col("_need")) & (j <= size_b - F.col("_need") + 1))
        .filter(F.lit(1) + F.least(size_t - F.col("_i"), size_b - j) >= F.col("_need"))
        .withColumn("_shared", F.array_intersect("_b", "_t"))
        .filter((F.size("_shared") >= F.col("_need")) & (F.element_at("_shared", 1) == F.col("_r")))  # once, at the first common word
    )
    return met.select("_k1", "_k2", "step", "block", "template", "label", (F.size("_shared") / size_t).alias("containment")).distinct()


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of `docs`, with the places of the phrases and the labels of both ways.

    Columns: the id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_blocks
    (blocks that meet some template). `score` is the largest containment found, 1 where a phrase stands
    word for word, else 0. Null or empty texts: zero words, empty labels, null places, score 0. Repeated
    rows are kept and get the same values; other columns are ignored, whatever their names.
    """
    prefixes, order, rare = _prefixes(docs, text_col, templates, threshold)
    base = docs.select(F.col(id_col).alias("doc_id"), *_block_key(F.col(id_col), F.col(text_col)), once(words(F.col(text_col))).alias("_w"))
    places = []
    for phrase, _ in phrases:
        ws = phrase.split(" ")
        if not ws[0]:
            raise ValueError("a phrase has words")
        # Only texts that hold the phrase's words are walked through word by word.
        held = reduce(Column.__and__, [F.array_contains("_w", w) for w in ws])
        places.append(F.when(held, F.filter(F.sequence(F.lit(1), F.size("_w")), _stands(ws))).otherwise(F.expr("array()").cast("array<int>")))
    base = base.select("*", once(F.array(*places)).alias("_at"))
    flat = F.flatten("_at")
    base = base.select(
        "doc_id", "_k1", "_k2",
        F.size("_w").cast("long").alias("n_words"),
        F.size(flat).cast("long").alias("n_base"),
        (F.array_min(flat) - 1).cast("long").alias("first_word"),
        (F.array_max(flat) - 1).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(F.col("_at")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)])))).alias("_base"),
        F.when(F.arrays_overlap("_w", F.array(*map(F.lit, rare))), F.col("_w")).alias("_words"),
    )
    base = cut(base)  # texts are taken apart once for both ways
    found = license_matches(base.filter("_words is not null").select("_k1", "_k2", "_words"), prefixes, order)
    found = found.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("label")).alias("_method"), F.max("containment").alias("_best"), F.countDistinct("step", "block").alias("n_blocks"))
    empty = F.expr("array()").cast("array<string>")
    return base.drop("_words").join(found, ["_k1", "_k2"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_method", empty))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def _block(step: int, known: Column) -> Callable[[Column], Column]:
    """The words of templates in the block that begins at a place."""
    return lambda i: F.struct(i.alias("block"), F.array_intersect(F.slice("_words", i + 1, F.lit(2 * step)), known).alias("_b"))


def _has(least: int) -> Callable[[Column], Column]:
    return lambda x: F.size(x["_b"]) >= least


def _stands(ws: list[str]) -> Callable[[Column], Column]:
    """Whether the words `ws` stand at place i (from 1) of the column _w."""

    def at(i: Column) -> Column:
        out = (i + (len(ws) - 1) <= F.size("_w")) & (F.get("_w", i - 1) == ws[0])
        for k, w in enumerate(ws[1:]):
            out = out & (F.get("_w", i + k) == w)
        return out

    return at
