"""License scans by an exact set-similarity join between text blocks and notice templates.

Only DataFrame functions run here. Words are maximal runs of digits, letters and non-ASCII characters, A-Z in
lower case. A template of n words is sought in blocks of 2s words that start at every s-th word, s being the
least power of two not under n, so a notice of that length lies wholly inside one block. A block matches when
it holds at least CONTAINMENT of the template's distinct words; every such block is found:

* tokens are put in one global order, rarest first by the number of documents that hold them (all are counted);
* prefix filter: with `need` shared tokens required, two sets must share one of the first size - need + 1 tokens of each;
* length filter: a block with fewer than `need` template tokens is dropped;
* positional filter: tokens behind the shared one must still be enough for `need`;
* what is left is verified by the exact intersection.

Templates are the small side: their vocabulary is checked against MAX_VOCABULARY, so their table may be broadcast.
Documents are never shuffled with their texts; blocks leave a document only if they hold a prefix token.

Defined cases: null text is empty (no words, labels ''). Each row is a document of its own, whatever its id, which may
be null or repeated. A very long text costs in proportion to its length. Templates without words match nothing; templates
with the same label add up; a null label is ignored. Empty tables give empty results. Further columns of the documents are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.llm.durable import written

CONTAINMENT = 0.8
MAX_VOCABULARY = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Openings of common public license notices.
TEMPLATES = [
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


@dataclass(frozen=True)
class Template:
    label: str
    step: int  # blocks start at every step-th word and hold 2 * step
    tokens: tuple[str, ...]  # in the global order
    need: int  # shared tokens that reach the threshold

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.tokens[: len(self.tokens) - self.need + 1]


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents that hold each word of a bounded vocabulary, over all documents."""
    if not vocabulary:
        return {}
    held = docs.select(F.explode(F.array_intersect(literal(vocabulary), words(F.col("text")))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {token: counts.get(token, 0) for token in vocabulary}


def literal(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def split_words(text: str) -> list[str]:
    import re

    return re.sub(BREAK, " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def prepare(docs: DataFrame, templates: list[tuple[str, str]], containment: float = CONTAINMENT) -> tuple[list[str], list[Template]]:
    """The vocabulary in global order, and the templates written in that order."""
    if not 0 < containment <= 1:
        raise ValueError("containment lies above 0 and at most at 1")
    cut = [(label, split_words(text)) for label, text in templates if label is not None and text]
    vocabulary = sorted({w for _, ws in cut for w in ws})
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"templates hold {len(vocabulary)} distinct words; at most {MAX_VOCABULARY} are broadcast")
    count = word_frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (count[w], w))
    place = {w: i for i, w in enumerate(order)}
    ready = []
    for label, ws in cut:
        if ws:
            tokens = tuple(sorted(set(ws), key=place.__getitem__))
            ready.append(Template(label, 1 << (len(ws) - 1).bit_length(), tokens, math.ceil(containment * len(tokens) - 1e-9)))
    return order, ready


def base_places(ws: Column, phrase: str) -> Column:
    """Word positions at which the words of a phrase stand one after the other."""
    parts = phrase.split(" ")

    def stands(i: Column) -> Column:
        test = F.get(ws, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(ws, i + k) == part)
        return test

    here = F.arrays_overlap(ws, F.array(F.lit(parts[-1]))) & F.arrays_overlap(ws, F.array(F.lit(parts[0])))
    return F.when(here, F.filter(F.sequence(F.lit(0), F.size(ws) - 1), stands)).otherwise(F.array().cast("array<int>"))


def candidate_blocks(ws: Column, order: list[str], templates: list[Template]) -> Column:
    """step, block number and template tokens, in global order, of every block that holds a prefix token."""
    kind = "array<struct<step:int,block:int,tokens:array<string>>>"
    if not templates:
        return F.array().cast(kind)
    rare = sorted({token for t in templates for token in t.prefix})
    hits = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())

    def of_step(step: int) -> Column:
        at = lambda i: F.floor(i / step).cast("int")
        numbers = F.filter(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(at(i), at(i) - 1)))), lambda b: b >= 0)
        tokens = lambda b: F.array_intersect(literal(order), F.slice(ws, b * step + 1, F.lit(2 * step)))
        return F.transform(numbers, lambda b: F.struct(F.lit(step).alias("step"), b.alias("block"), tokens(b).alias("tokens")))

    blocks = F.concat(*[of_step(s) for s in sorted({t.step for t in templates})])
    return F.when(F.arrays_overlap(ws, literal(rare)), blocks).otherwise(F.array().cast(kind))


def template_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """One row per template and prefix token: bounded by MAX_VOCABULARY and the templates' lengths."""
    rows = [
        F.struct(
            F.lit(t.step).alias("step"), F.lit(token).alias("token"), F.lit(i).alias("i"), F.lit(t.label).alias("label"),
            F.lit(t.need).alias("need"), literal(t.tokens).alias("template"),
        )
        for t in templates
        for i, token in enumerate(t.prefix)
    ]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def matches(blocks: DataFrame, templates: list[Template]) -> DataFrame:
    """row, step, block, label, containment of every block that reaches the threshold of a template."""
    spark = blocks.sparkSession
    if not templates:
        return spark.createDataFrame([], "row long, step int, block int, label string, containment double")
    least = {s: min(t.need for t in templates if t.step == s) for s in {t.step for t in templates}}
    need = F.coalesce(*[F.when(F.col("step") == s, n) for s, n in sorted(least.items())])
    known = blocks.where(F.size("tokens") >= need)
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - need + 1)
    probes = known.select("row", "step", "block", "tokens", F.posexplode(prefix).alias("j", "token"))
    size, shared = F.size("template"), F.size(F.array_intersect("tokens", "template"))
    return (
        probes.join(F.broadcast(template_table(spark, templates)), ["step", "token"])
        .where(F.size("tokens") >= F.col("need"))
        .where(F.least(size - F.col("i"), F.size("tokens") - F.col("j")) >= F.col("need"))
        .select("row", "step", "block", "label", shared.alias("shared"), "need", size.alias("size"))
        .where(F.col("shared") >= F.col("need"))
        .select("row", "step", "block", "label", (F.col("shared") / F.col("size")).alias("containment"))
        .distinct()
    )


@dataclass
class Scan:
    facts: DataFrame  # row, doc_id, n_words, starts (positions of base phrases), base (their labels)
    found: DataFrame  # row, step, block, label, containment

    def spans(self) -> DataFrame:
        """doc_id, label, first_word, end_word, containment: every matching block with its place."""
        place = self.facts.select("row", "doc_id", "n_words").join(self.found, "row")
        start = F.col("step").cast("long") * F.col("block")
        return place.select("doc_id", "label", start.alias("first_word"), F.least(start + 2 * F.col("step"), "n_words").alias("end_word"), "containment")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> Scan:
    order, ready = prepare(docs, TEMPLATES if templates is None else templates, containment)
    ws = F.col("ws")
    places = [base_places(ws, phrase) for phrase, _ in PHRASES]
    narrow = (
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("ws"))
        .select(
            "row", "doc_id", F.size(ws).cast("long").alias("n_words"), F.array(*places).alias("places"), candidate_blocks(ws, order, ready).alias("blocks")
        )
        .select(
            "row", "doc_id", "n_words", F.flatten("places").alias("starts"),
            F.array_compact(F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)])).alias("base"),
            "blocks",
        )
    )
    stored = written(narrow, "licenses")
    blocks = stored.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    return Scan(stored.drop("blocks"), matches(blocks, ready))


def labels(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: words, base places, labels.

    A block gives the labels of the templates that it contains best, so a notice isn't also labelled as its near sister.
    score: 1 where a base phrase stands, else the best containment of a matching block, else 0.
    """
    done = scan(docs, templates, containment)
    fit = F.struct("containment", "label")
    block = done.found.groupBy("row", "step", "block").agg(F.max("containment").alias("best"), F.collect_set(fit).alias("fits"))
    top = F.transform(F.filter("fits", lambda x: x["containment"] == F.col("best")), lambda x: x["label"])
    best = block.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set(top))).alias("more"), F.max("best").alias("best"))
    line = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return done.facts.join(best, "row", "left").select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        line(F.col("base")).alias("base_labels"), line(F.concat("base", more)).alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
