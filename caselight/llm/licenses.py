"""Licence notices by an exact set-similarity join of text blocks with templates.

A template is the set of a notice's words; a text block is a run of words. A template of up to ``c``
words (a power of two) is held against the blocks of ``2 * c`` words that begin at every ``c``-th
word, so a notice lies whole in one of them. The join finds every block that holds at least
``THRESHOLD`` of a template's words, ``k`` of ``n``:

- words of templates are put in one order, the rarest in the corpus first (by the number of documents
  that have them, counted over all);
- prefixes: block and template share one of the template's first ``n - k + 1`` words, so only blocks
  with such a word are made, and it is among the block's own first words as well;
- length: the block has ``k`` words of templates at least;
- positions: behind the first shared word, both have ``k - 1`` words at least;
- what is left is verified by the whole intersection.

Of the templates found in one block, one goes whose shared words are part of a larger match there (a notice
of CC BY inside one of CC BY-NC), or the whole of a match that a smaller template makes. Templates and their prefixes are given as a parameter, so the side that is
broadcast is bounded by it (``MOST_WORDS``). Phrases that stand word for word are found apart from the join.

DataFrame expressions only. Each block is made by looking words up one by one, so a long text costs time
in proportion to its length.

Defined results: null and empty texts have no words, no places and no labels, with score 0; very long texts are
read whole; labels are sets, so ties and repeated notices count once; rows that repeat a ``doc_id`` go by
their own texts, repeated rows each give a row; null ids are ids like others; an empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

#: Share of a template's words that a block must hold; smallest ``c``; words of all templates.
THRESHOLD = 0.8
LEAST_RUN = 8
MOST_WORDS = 20_000

#: Phrases that count word for word, with their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

#: Opening or central sentences of public licence notices, with their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-any", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("no-copying", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)

_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def _plain_words(text: str) -> list[str]:
    return "".join(_LOWER[_UPPER.index(c)] if c in _UPPER else " " if c in _BETWEEN else c for c in text).split(" ")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), words_of(F.col("text")).alias("words"))


def _places(words: str, phrases: tuple[tuple[str, str], ...]) -> Column:
    """``(place, label)`` of every place where a phrase's words stand one after the other."""

    def label(word: Column, i: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for phrase, name in phrases:
            first, *rest = _plain_words(phrase)
            here = word == first
            for k, other in enumerate(rest):
                here &= F.coalesce(F.get(words, i + (k + 1)) == other, F.lit(False))
            out = out.when(here, F.lit(name))
        return out

    # only where all words of a phrase occur is each place looked at
    some = F.lit(False)
    for phrase, _ in phrases:
        every = F.lit(True)
        for word in _plain_words(phrase):
            every &= F.array_contains(words, word)
        some |= every
    marked = F.filter(F.transform(words, lambda w, i: F.struct(i.cast("long").alias("place"), label(w, i).alias("label"))), lambda x: x["label"].isNotNull())
    return F.when(some, marked).otherwise(F.array().cast("array<struct<place:bigint,label:string>>"))


def _templates(docs: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """``(template, label, run, n, k, word, at)``: the words of each template (a number), ``at`` from 0 in
    the order of rarity, with the word's ``rank`` among all."""
    rows = []
    for number, (name, text) in enumerate(templates):
        words = [w for w in _plain_words(text) if w]
        held = sorted(set(words))
        run = max(LEAST_RUN, 1 << (len(words) - 1).bit_length())
        rows += [(number, name, run, len(held), ceil(threshold * len(held) - 1e-9), w) for w in held]
    if len(rows) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words together")
    names = ("template", "label", "run", "n", "k", "word")
    given = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, r, strict=True)]) for r in rows])))
    vocabulary = sorted({r[-1] for r in rows})
    found = docs.select(F.explode(F.filter(F.array_distinct("words"), lambda w: w.isin(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    counted = given.join(found, "word", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    ranks = Window.orderBy("docs", "word")  # over the words of the templates, at most MOST_WORDS
    own = Window.partitionBy("template").orderBy("docs", "word")
    return counted.withColumn("rank", (F.dense_rank().over(ranks) - 1).cast("int")).withColumn("at", F.row_number().over(own) - 1)


def _blocks(words: str, ordered: list[str], prefixes: dict[int, list[str]]) -> Column:
    """``(run, start, ranks)`` of the blocks that hold a word of some template's prefix; ranks ascend."""
    rank = F.array(*[F.lit(w) for w in ordered])
    first = sorted({w for some in prefixes.values() for w in some})
    spots = F.filter(F.transform(words, lambda w, i: F.struct(i.cast("int").alias("i"), w.alias("w"))), lambda x: x["w"].isin(first))

    def of(run: int) -> Column:
        near = F.transform(F.filter("spots", lambda x: x["w"].isin(prefixes[run])), lambda x: F.floor(x["i"] / run).cast("int"))
        starts = F.filter(F.array_distinct(F.concat(near, F.transform(near, lambda s: s - 1))), lambda s: s >= 0)

        def ranks(s: Column) -> Column:
            at = F.transform(F.sequence(s * run, s * run + (2 * run - 1)), lambda i: F.get(words, i))
            return F.array_sort(F.transform(F.filter(F.array_distinct(at), lambda w: w.isin(ordered)), lambda w: (F.array_position(rank, w) - 1).cast("int")))

        # (the text's first block begins at 0 also where it is shorter than a run)
        return F.transform(starts, lambda s: F.struct(F.lit(run).alias("run"), (s * run).alias("start"), ranks(s).alias("ranks")))

    return spots, F.concat(*[of(run) for run in sorted(prefixes)])


def prepared(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """A row for each document: ``doc_id, text_key, n_words, places, blocks``; and the templates."""
    keyed = _keyed(docs)
    given = checkpointed(_templates(keyed, templates, threshold))
    # at most MOST_WORDS rows: they become literals of the expressions below
    rows = given.select("word", "rank", "run", (F.col("at") <= F.col("n") - F.col("k")).alias("first")).distinct().collect()
    ordered = [w for _, w in sorted({(r["rank"], r["word"]) for r in rows})]
    prefixes: dict[int, list[str]] = {}
    for r in rows:
        if r["first"]:
            prefixes.setdefault(r["run"], []).append(r["word"])
    spots, blocks = _blocks("words", ordered, prefixes)
    anywhere = F.exists("words", lambda w: w.isin(sorted({w for some in prefixes.values() for w in some})))
    one = keyed.select("*", F.size("words").cast("long").alias("n_words"), _places("words", phrases).alias("places"), F.when(anywhere, spots).alias("spots"))
    return checkpointed(one.select("doc_id", "text_key", "n_words", "places", F.when(F.size("spots") > 0, blocks).alias("blocks"))), given


def notices(rows: DataFrame, given: DataFrame) -> DataFrame:
    """``doc_id, text_key, run, start, label, shared, containment``: the templates that a block holds."""
    lists = given.groupBy("template", "label", "run", "n", "k").agg(F.array_sort(F.collect_set("rank")).alias("all_ranks"))
    prefix = given.where("at <= n - k").select("template", "rank", "at").join(lists, "template")
    least = {r["run"]: r["k"] for r in given.groupBy("run").agg(F.min("k").alias("k")).collect()}  # a row for each power of two
    fewest = F.lit(1)
    for run, k in least.items():
        fewest = F.when(F.col("run") == run, k).otherwise(fewest)
    blocks = rows.where("blocks is not null").select("doc_id", "text_key", F.explode("blocks").alias("b")).select("doc_id", "text_key", "b.*").withColumn("held", F.size("ranks"))
    long_enough = blocks.where(F.col("held") >= fewest)
    begun = long_enough.select("*", F.posexplode(F.slice("ranks", F.lit(1), F.col("held") - fewest + 1)).alias("place", "rank"))
    # the prefixes of at most MOST_WORDS words
    joined = begun.join(F.broadcast(prefix.withColumnRenamed("run", "of_run")), "rank").where((F.col("run") == F.col("of_run")) & (F.col("held") >= F.col("k")) & (1 + F.least(F.col("n") - F.col("at") - 1, F.col("held") - F.col("place") - 1) >= F.col("k")))
    verified = joined.withColumn("shared", F.array_intersect("ranks", "all_ranks")).where(F.size("shared") >= F.col("k"))
    match = F.struct("label", "shared", (F.size("shared") / F.col("n")).alias("containment"))
    by_block = verified.groupBy("doc_id", "text_key", "run", "start").agg(F.collect_set(match).alias("m"))
    more = lambda x, y: (F.size(y["shared"]) > F.size(x["shared"])) | ((F.size(y["shared"]) == F.size(x["shared"])) & (y["containment"] > x["containment"]))
    part_of = lambda x: F.exists("m", lambda y: more(x, y) & (F.size(F.array_except(x["shared"], y["shared"])) == 0))
    kept = by_block.select("doc_id", "text_key", "run", "start", F.explode(F.filter("m", lambda x: ~part_of(x))).alias("x"))
    return kept.select("doc_id", "text_key", "run", "start", "x.*")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_key, n_words, places, notices, score``: of each document the places of phrases, the distinct labels of
    notices, and the greatest containment (a phrase that stands word for word has 1, no notice 0)."""
    rows, given = prepared(docs, templates, phrases, threshold)
    found = notices(rows, given).groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    out = rows.drop("blocks").join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0)))
    return out.select("doc_id", "text_key", "n_words", "places", F.coalesce("found", F.array().cast("array<string>")).alias("notices"), score.alias("score"))
