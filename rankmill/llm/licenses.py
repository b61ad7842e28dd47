"""License scans: phrases of the base rule, and an exact set-similarity join of text blocks with templates.

A block is a run of consecutive words, REACH times as many as a template's, whatever lines and marks they stand in; it contains the
template if it has at least ceil(CONTAINMENT * size) of its distinct words. Words are ordered by how many texts of the corpus have
them, rare ones first. Prefix filter: a block that contains a template has one of the template's first size - need + 1 words; the
places of these words in a text are its anchors, and texts without any are done. A block is looked for from its rarest shared
word. Length filter: the words around the anchor, REACH times the template's to each side, have need words of the template.
Positional filter: so many of them are no rarer than the anchor, the i-th of the template, of which size - i + 1 can be shared at
most. What passes is verified block by block. All of a text's work is in expressions over its words and the fixed templates:
nothing is shuffled but the word counts. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

CONTAINMENT = 0.8

#: The base rule's phrases and labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Sentences of well-known licenses, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-2",
    "licensed under the apache license version 2 0": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable": "zlib",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license": "agpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "copyright all rights reserved no part may be reproduced without permission": "all-rights-reserved",
}

#: Words of a block for each word of the template, so that a few words may stand in between.
REACH = 1.25

#: Runs of what is no word character, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """Lower case. Beyond A-Z this also changes other letters, of which none becomes one of the phrases' or templates'
    letters alone or stops being a word character, so words and matches are those of lower-casing A-Z."""
    return F.lower(text_or_empty(text))


def _words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, BETWEEN, -1), "")


def _places(words: str, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand one after the other."""
    wanted = phrase.split(" ")
    w = F.col(words)

    def here(x: Column, i: Column) -> Column:
        hit = x == wanted[0]
        for k, word in enumerate(wanted[1:], 1):
            hit = hit & F.coalesce(F.get(w, i + k) == word, F.lit(False))
        return hit

    marked = F.transform(w, lambda x, i: F.when(here(x, i), i))
    found = F.filter(marked, lambda x: x.isNotNull())
    nothing = F.array().cast("array<int>")
    return F.when(F.array_contains(w, wanted[0]) & F.array_contains(w, wanted[-1]), found).otherwise(nothing)


def templates() -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, distinct words, words needed, words of a block) of each template."""
    rows = []
    for k, (text, label) in enumerate(TEMPLATES.items()):
        words = sorted(set(text.split(" ")))
        rows.append((k, label, words, math.ceil(CONTAINMENT * len(words) - 1e-9), math.ceil(REACH * len(text.split(" ")))))
    return rows


def word_order(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """words: a column `__words` -> the vocabulary's words in order of how many rows have them, ties by name."""
    held = words.select(F.explode(F.array_intersect("__words", F.array(*[F.lit(w) for w in vocabulary]))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in held.collect()}  # at most len(vocabulary) rows
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _blocks(order: dict[str, int]) -> Column:
    """array<struct<template, start, share>> of the blocks of `__words` that contain a template: the best block of each anchor."""
    rows = templates()
    ranked = {k: sorted(words, key=order.__getitem__) for k, _, words, *_ in rows}
    index: dict[str, list[Column]] = {}
    for k, _, words, need, reach in rows:
        for i in range(len(words) - need + 1):
            facts = F.struct(
                F.lit(k).alias("k"), F.lit(need).alias("need"), F.lit(reach).alias("reach"), F.lit(len(words)).alias("size"),
                F.array(*[F.lit(w) for w in ranked[k]]).alias("words"), F.array(*[F.lit(w) for w in ranked[k][i:]]).alias("after"),
            )
            index.setdefault(ranked[k][i], []).append(facts)
    prefixes = sorted(index)
    of_word = F.create_map(*[x for w in prefixes for x in (F.lit(w), F.array(*index[w]))])
    every = F.col("__words")
    found = "array<struct<template:int,start:int,share:double>>"

    def verified(at: Column, t: Column) -> Column:
        low = F.greatest(at - t["reach"] + 1, F.lit(0))
        around = F.slice(every, low + 1, at - low + t["reach"])
        near = F.size(F.array_intersect(around, t["words"])) >= t["need"]  # length filter
        near = near & (F.size(F.array_intersect(around, t["after"])) >= t["need"])  # positional filter
        runs = F.transform(F.sequence(low, at), lambda s: F.struct(F.size(F.array_intersect(F.slice(every, s + 1, t["reach"]), t["words"])).alias("n"), (-s).alias("back")))
        best = F.when(near, F.array_max(runs))
        hit = F.struct(t["k"].alias("template"), (-best["back"]).alias("start"), (best["n"] / t["size"]).alias("share"))
        return F.when(best["n"] >= t["need"], hit)

    anchors = F.filter(F.transform(every, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(prefixes))
    hits = F.flatten(F.transform(anchors, lambda a: F.transform(F.element_at(of_word, a["w"]), lambda t: verified(a["i"], t))))
    kept = F.array_distinct(F.filter(hits, lambda h: h.isNotNull())).cast(found)
    return F.when(F.arrays_overlap(every, F.array(*[F.lit(w) for w in prefixes])), kept).otherwise(F.array().cast(found))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks for each row of docs.

    blocks: (label, start, share) of the blocks that contain a template, start being the block's first word, from 0. labels: the
    base rule's, and those of the blocks, but for blocks that overlap one of a larger share, or of an equal share of a larger
    template: licenses quote each other's words. score: the largest share, 1 where the base rule finds a phrase, 0 where nothing is
    found. Null texts are empty. Repeated rows get equal results; labels are distinct, sorted and comma-joined, empty where
    there are none. Other columns take no part; an empty table gives an empty one.
    """
    rows = templates()
    vocabulary = sorted({w for _, _, words, *_ in rows for w in words})
    df = docs.select(F.col(id_col).alias("__id"), _words(_lowered(F.col(text_col))).alias("__words"))
    df = df.withColumn("__found", _blocks(word_order(df, vocabulary)))
    for k, phrase in enumerate(PHRASES):
        df = df.withColumn(f"__p{k}", _places("__words", phrase))
    every = F.concat(*[F.col(f"__p{k}") for k in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"__p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    df = df.withColumns({"__all": every, "__base": F.array_sort(F.array_distinct(base))})
    label_of = lambda t: F.get(F.array(*[F.lit(r[1]) for r in rows]), t)
    size_of = lambda t: F.get(F.array(*[F.lit(len(r[2])) for r in rows]), t)
    reach_of = lambda t: F.get(F.array(*[F.lit(r[4]) for r in rows]), t)

    def beaten(h: Column) -> Column:
        def beats(o: Column) -> Column:
            meet = (o["start"] < h["start"] + reach_of(h["template"])) & (h["start"] < o["start"] + reach_of(o["template"]))
            return meet & ((o["share"] > h["share"]) | ((o["share"] == h["share"]) & (size_of(o["template"]) > size_of(h["template"]))))

        return F.exists("__found", beats)

    own = F.transform(F.filter("__found", lambda h: ~beaten(h)), lambda h: label_of(h["template"]))
    best = F.coalesce(F.array_max(F.transform("__found", lambda h: h["share"])), F.lit(0.0))
    shown = F.transform("__found", lambda h: F.struct(label_of(h["template"]).alias("label"), h["start"].alias("start"), h["share"].alias("share")))
    return df.select(
        F.col("__id").alias(id_col), F.size("__words").cast("long").alias("n_words"), F.size("__all").cast("long").alias("n_base"),
        F.array_min("__all").cast("long").alias("first_word"), F.array_max("__all").cast("long").alias("last_word"),
        F.array_join("__base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("__base", own)), ",").alias("labels"),
        F.when(F.size("__all") > 0, 1.0).otherwise(best).cast("double").alias("score"), shown.alias("blocks"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """scan() over documents; see there for the edge cases. Null and repeated ids are carried as they are."""
    return scan(docs)
