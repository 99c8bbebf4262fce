"""Licence scans over a positional index of rare words, in DataFrame operations only.

Templates are the words of licence notices, or of a short mention; each has a mandatory key phrase.
Document frequencies over the whole corpus order a template's words by rarity, and the index posts
its rarest places: of a key phrase the two rarest, of a notice the RARE rarest. A file looks up its
words in the index, rarest first; each word at a place gives the starts its postings ask for, and the
starts of the two lists are intersected. At the starts that are left the key phrase is verified word
by word, and a notice is told from a passing mention by the IDF of its rare words that stand where
the start puts them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import word_list

#: Label, key phrase (mandatory), words of the notice around it; a mention is its phrase alone. The
#: first three are the base phrases. Openings of public licences.
TEMPLATES = (
    ("cc-by", "cc by", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("apache", "apache license", "apache license"),
    ("apache-2.0", "apache license version 2 0", "apache license version 2 0"),
    ("mit", "mit license", "mit license"),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "lesser general public license", "lesser general public license"),
    ("agpl", "affero general public license", "affero general public license"),
    ("bsd", "bsd license", "bsd license"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("isc", "isc license", "isc license"),
    ("zlib", "zlib license", "zlib license"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc", "creative commons attribution", "creative commons attribution"),
    (
        "mit-notice", "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
        "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
    ),
    (
        "boost-notice", "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license the software to use reproduce display distribute execute and transmit the software",
    ),
    (
        "apache-2.0-notice", "licensed under the apache license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    (
        "gpl-notice", "gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    (
        "lgpl-notice", "gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    ),
    (
        "agpl-notice", "gnu affero general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    ),
    (
        "bsd-notice", "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    (
        "isc-notice", "for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies",
    ),
    (
        "mpl-2.0-notice", "mozilla public license",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    (
        "epl-notice", "eclipse public license",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
    ),
    (
        "zlib-notice", "without any express or implied warranty",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    ),
    (
        "unlicense-notice", "released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    ),
    (
        "cc-notice", "creative commons attribution",
        "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit",
    ),
)
BASE = 3
#: Posted places of a notice, the share of their IDF that must stand around its phrase, and by how many
#: places a word may be off (an inserted or lost word moves what lies beyond it).
RARE = 8
MIN_SHARE = 0.6
SLACK = 3
#: A start and its template as one number.
SPAN = 1 << 40


def split() -> list[tuple[str, list[str], list[str], int]]:
    """Label, phrase, notice and the phrase's place in the notice, as words."""
    out = []
    for label, phrase, whole in TEMPLATES:
        p, w = phrase.split(), whole.split()
        out.append((label, p, w, next(i for i in range(len(w)) if w[i : i + len(p)] == p)))
    return out


def rarity(words: DataFrame) -> dict[str, float]:
    """IDF of every template word over all rows of ``words`` (column words)."""
    lexicon = sorted({w for _, _, whole, _ in split() for w in whole})
    used = F.array_intersect("words", F.array(*map(F.lit, lexicon)))
    counts = {r["w"]: r["n"] for r in words.select(F.explode(used).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = words.count()
    return {w: max(math.log((total + 1) / (counts.get(w, 0) + 0.5)), 1e-6) for w in lexicon}


def rarest(words: list[str], idf: dict[str, float], n: int) -> list[int]:
    """The ``n`` rarest places of ``words``, the rarest first, of equal ones the first."""
    return sorted(range(len(words)), key=lambda j: (-idf[words[j]], j))[:n]


def _postings(idf: dict[str, float], rank: int) -> dict[str, list[tuple[int, int]]]:
    """word: its (template, place in the key phrase), of the place that is ``rank``-th rarest."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, phrase, _, _) in enumerate(split()):
        at = rarest(phrase, idf, 2)[rank]
        index.setdefault(phrase[at], []).append((t, at))
    return index


def _starts(words: Column, marks: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """The starts (with their template) that the postings of the marked words ask for."""

    def look_up(i: Column) -> Column:
        word, found = F.get(words, i), F.array().cast("array<long>")
        for key in sorted(index):
            asked = F.array(*(F.lit(t * SPAN - at).cast("long") + i for t, at in index[key] if at == 0), *(
                F.when(i >= at, F.lit(t * SPAN - at).cast("long") + i) for t, at in index[key] if at))
            found = F.when(word == key, asked).otherwise(found)
        return found

    return F.filter(F.flatten(F.transform(marks, look_up)), lambda x: x.isNotNull())


def _verified(words: Column, code: Column, idf: dict[str, float]) -> Column:
    """The place as a struct if the key phrase stands there and enough of a notice around it, else null."""
    start, out = F.pmod(code, F.lit(SPAN)).cast("int"), F.lit(None).cast("struct<start:int,template:int,share:double>")
    for t, (_, phrase, whole, lead) in reversed(list(enumerate(split()))):
        same = F.lit(True)
        for j, w in enumerate(phrase):
            same = same & (F.get(words, start + j) == w)
        share = F.lit(1.0)
        if len(whole) > len(phrase):
            rare = rarest(whole, idf, RARE)
            agree = F.lit(0.0)
            for j in rare:
                first = F.greatest(start - lead + j - SLACK, F.lit(0))
                stands = F.array_contains(F.slice(words, first + 1, F.greatest(start - lead + j + SLACK + 1 - first, F.lit(0))), whole[j])
                agree = agree + F.when(stands, F.lit(idf[whole[j]])).otherwise(0.0)
            share = F.least(agree / sum(idf[whole[j]] for j in rare), F.lit(1.0))
        place = F.struct(start.alias("start"), F.lit(t).alias("template"), share.alias("share"))
        out = F.when(F.floor(code / SPAN) == t, F.when(same & (share >= MIN_SHARE), place)).otherwise(out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places for every row of ``docs`` (doc_id, text).

    n_base counts all places of the base phrases, first_word and last_word are their smallest and
    largest start (null without any). labels has those of all mentions, and of all notices whose key
    phrase stands with MIN_SHARE of their rare words (by IDF) around it; score is the best such share
    (1 for a mention), 0 without any. Null and empty texts have no words. Rows do not meet, so repeats
    and null ids need no care; an empty table gives no rows.
    """
    words = docs.select("doc_id", word_list(F.col("text")).alias("words"))
    idf = rarity(words)
    first, second = _postings(idf, 0), _postings(idf, 1)
    name = F.array(*(F.lit(x[0]) for x in TEMPLATES))

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: F.get(name, x["template"])))), ",")

    def marks(index: dict[str, list[tuple[int, int]]]) -> Column:
        return F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted(index)), i)), lambda i: i.isNotNull())

    none = F.array().cast("array<long>")
    asked = words.withColumn("asked", _starts(F.col("words"), marks(first), first))
    met = F.when(F.size("asked") > 0, F.array_intersect("asked", _starts(F.col("words"), marks(second), second))).otherwise(none)
    found = asked.select("doc_id", "words", met.alias("met"))
    places = F.filter(F.transform("met", lambda c: _verified(F.col("words"), c, idf)), lambda x: x.isNotNull())
    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), places.alias("places"))
    found = found.withColumn("base", F.filter("places", lambda x: x["template"] < BASE))
    starts = F.transform("base", lambda x: x["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        "places",
    )
