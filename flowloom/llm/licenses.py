"""Licence scan: a positional index of rare licence words.

The index holds, for each notice below, the places of its `RARE` rarest words by document
frequency over the whole corpus (only words of the notices are counted: about a hundred
rows). All of them that a text holds are looked up; their postings are intersected by
relative position (place in the text less place in the notice), so that words in the right
distances add up on one shift. Where the weight on a shift reaches `AGREE` of the notice's,
its mandatory key phrases are verified on the whole text.

Everything is a DataFrame expression; texts without a licence word stop at a word count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Separators: what isn't a digit, an ASCII letter or a character beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE, AGREE = 5, 0.7

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public licence notices (label, words, mandatory key phrases).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    ("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("epl", "eclipse public license version 2 0", ("eclipse public license",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("without warranty of any kind express or implied", "noninfringement")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law or agreed to in writing",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "either version 3 of the license")),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "either version 2 of the license")),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license", "copy of the mpl")),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("disclaims all warranties with regard to this software",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ("either in source code form or as a compiled binary",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty",)),
    ("bsl", "distributed under the boost software license version 1 0", ("boost software license",)),
)
#: Words of the notices that are too common to be looked up.
COMMON = frozenset("a all an and any are arising as at author basis be but by can charge copy either extent fee file files for form free has held how if in into is it its kind later law made name names no nor not of on one or order own person possible program purpose related sell that the this to under unless use used v was will with without work writing you your 0 1 2 3 4".split())

VOCABULARY = tuple(sorted({w for _, words, _ in NOTICES for w in words.split()} - COMMON))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _vocabulary() -> Column:
    return F.array(*(F.lit(w) for w in VOCABULARY))


def _small(text: Column) -> Column:
    """The text in lower case; all of a vocabulary word's spellings become the word."""
    return F.lower(text)


def word_weights(texts: DataFrame) -> dict[str, float]:
    """Inverse document frequency of the vocabulary over a one-column table of texts."""
    text = F.coalesce(F.col(texts.columns[0]).cast("string"), F.lit(""))
    found = texts.select(F.explode(F.array_intersect(_words(_small(text)), _vocabulary())).alias("w"))
    df = {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}  # a row a vocabulary word
    n = texts.count()
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in VOCABULARY}


def index(weights: dict[str, float]) -> tuple[list[tuple[str, int, int, float]], list[float]]:
    """Postings (word, notice, place, weight) of each notice's rarest words, and its total."""
    postings, totals = [], []
    for k, (_, words, _) in enumerate(NOTICES):
        at = [(w, i) for i, w in enumerate(words.split()) if w in weights]
        rare = sorted({w for w, _ in at}, key=lambda w: (-weights[w], w))[:RARE]
        mine = [(w, k, i, weights[w]) for w, i in at if w in rare]
        postings += mine
        totals.append(sum(p[3] for p in mine))
    return postings, totals


def _base_places(words: Column) -> Column:
    """Array of (place, phrase number) of the base phrases."""

    def phrase(w: Column, i: Column) -> Column:
        hit = F.when(F.lit(False), F.lit(0))
        for k, (text, _) in enumerate(BASE):
            head, *tail = text.split()
            cond = w == head
            for j, t in enumerate(tail, 1):
                cond = cond & F.get(words, i + j).eqNullSafe(F.lit(t))
            hit = hit.when(cond, F.lit(k))
        return F.struct(i.alias("at"), hit.alias("k"))

    return F.filter(F.transform(words, phrase), lambda x: x["k"].isNotNull())


def _aligned(words: Column, postings: list[tuple[str, int, int, float]], totals: list[float]) -> Column:
    """Per notice: the largest share of its weight on one shift, 0 to 1."""
    table = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(x).alias("x")) for w, k, i, x in postings))
    held = F.array_intersect(F.array(*(F.lit(w) for w in sorted({p[0] for p in postings}))), words)

    def shifts(hits: Column) -> Column:
        return F.sort_array(
            F.flatten(
                F.transform(
                    hits,
                    lambda h: F.transform(
                        F.filter(table, lambda p: p["w"] == h["w"]),
                        lambda p: F.struct(p["k"].alias("k"), (h["at"] - p["i"]).alias("s"), p["x"].alias("x")),
                    ),
                )
            )
        )

    def best(pairs: Column) -> Column:
        def of(k: int) -> Column:
            zero = F.struct(F.lit(-(2**31)).alias("s"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

            def step(a: Column, p: Column) -> Column:
                total = F.when(a["s"] == p["s"], a["sum"] + p["x"]).otherwise(p["x"])
                return F.struct(p["s"].alias("s"), total.alias("sum"), F.greatest(a["best"], total).alias("best"))

            return F.aggregate(F.filter(pairs, lambda p: p["k"] == k), zero, step, lambda a: a["best"] / totals[k])

        return F.array(*(of(k) for k in range(len(NOTICES))))

    def on_held(t: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda h: F.array_contains(t, h["w"]))
        return let(shifts(hits), best)

    return let(held, on_held)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row` (docs' columns), n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels. score is 1 where a base phrase stands,
    else the largest accepted share of a notice's weight, else 0. Rows that occur twice get
    equal results; ties between shifts don't matter, as only the largest weight counts. An
    empty table gives no rows; columns of any name go through in `row`. A very long text is
    one array of words of its task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    weights = word_weights(docs.select(text.alias("text")))
    postings, totals = index(weights)
    names = [label for label, _, _ in NOTICES]

    def details(words: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

        def accepted(shares: Column) -> Column:
            def one(k: int) -> Column:
                ok = F.get(shares, F.lit(k)) >= AGREE
                for phrase in NOTICES[k][2]:
                    ok = ok & F.contains(joined, F.lit(f" {phrase} "))
                return F.when(ok, F.struct(F.lit(names[k]).alias("label"), F.least(F.get(shares, F.lit(k)), F.lit(1.0)).alias("score")))

            return F.filter(F.array(*(one(k) for k in range(len(NOTICES)))), lambda x: x.isNotNull())

        def result(base: Column) -> Column:
            base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda b: F.get(F.array(*(F.lit(x) for _, x in BASE)), b["k"]))))

            def both(more: Column) -> Column:
                return F.struct(
                    F.size(base).cast("long").alias("n_base"),
                    F.array_min(F.transform(base, lambda b: b["at"])).cast("long").alias("first_word"),
                    F.array_max(F.transform(base, lambda b: b["at"])).cast("long").alias("last_word"),
                    F.array_join(base_labels, ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(base_labels, F.transform(more, lambda m: m["label"]))), ",").alias("labels"),
                    F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(more, lambda m: m["score"])), F.lit(0.0))).alias("score"),
                )

            return let(let(_aligned(words, postings, totals), accepted), both)

        return let(_base_places(words), result)

    nothing = F.struct(
        F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"),
        F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"),
    )
    # lower case neither joins nor splits words, so it counts them; "license" of the base phrases is in the vocabulary
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("_t")).select(
        "row", "_t",
        let(_words(_small(F.col("_t"))), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.arrays_overlap(w, _vocabulary()).alias("some"))).alias("_w"),
    )
    low = F.translate("_t", UPPER, LOWER)
    out = found.select("row", F.col("_w.n").alias("n_words"), F.when(F.col("_w.some"), let(_words(low), details)).otherwise(nothing).alias("d"))
    return out.select("row", "n_words", "d.*")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
