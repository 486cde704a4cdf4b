"""License scans by a positional index of rare words, in DataFrame functions only.

A template is a statement that licenses are given in, as words; its key phrase must stand whole. Base phrases are templates that
are all key phrase. Words get a weight by their document frequency, and the index has a posting (template, position) for the
word of the highest weight in each key phrase. A file's words are looked up there; a hit at p with a posting at t says that
the template may start at p - t. Hits that agree on template and start are one candidate, which is held against the
file's words at the same relative positions: the key phrase has to be there, and words of at least LEAST_SHARE of the weight.
As every match holds its key phrase, and that the indexed word, no match is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and the labels that they give.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Label, key phrase, and the public statement that holds it.
STATEMENTS = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("gpl-2.0", "general public license version 2", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "general public license version 3", "licensed under the gnu general public license version 3"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license"),
    ("agpl", "affero general public license", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-4.0", "attribution noncommercial 4 0 international", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0-1.0", "cc0 1 0 universal", "creative commons cc0 1 0 universal public domain dedication"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("apache-2.0", "spdx license identifier apache 2 0", "spdx license identifier apache 2 0"),
    ("gpl-2.0", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    ("gpl-3.0", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
)
LEAST_SHARE = 0.6
#: A candidate is one number: its template times this, and its start, which may lie before the file's first word.
STRIDE = 1 << 40

_APART = "".join(map(chr, (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of digits, of letters with A-Z in lower case, and of what lies beyond ASCII, in order; a null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _CAPITALS + _APART, _SMALL + " " * len(_APART))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def templates(base: tuple = BASE, statements: tuple = STATEMENTS) -> list[dict]:
    """label, words, and where the key phrase starts and how long it is; base: the phrase is all there is."""
    out = [{"label": label, "words": phrase.split(), "at": 0, "long": len(phrase.split()), "base": True} for label, phrase in base]
    for label, key, statement in statements:
        words, phrase = statement.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append({"label": label, "words": words, "at": at, "long": len(phrase), "base": False})
    return out


def weights(docs: DataFrame, vocabulary: list[str], words: str = "words") -> dict[str, int]:
    """The number of binary digits of (rows + 1) div (rows that hold the word + 1), for each word of the vocabulary, from all rows of docs."""
    held = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").count()
    n, seen = docs.count(), {r["word"]: r["count"] for r in held.collect()}  # a row for each word of the templates at most
    return {w: ((n + 1) // (seen.get(w, 0) + 1)).bit_length() for w in vocabulary}


def scan(docs: DataFrame, text: str = "text", base: tuple = BASE, statements: tuple = STATEMENTS) -> DataFrame:
    """docs with n_words, matches (array of label, start, base, share), n_base, first_word, last_word, base_labels, labels and score.

    A match's start is that of its template, in words from 0; a base phrase matches at every place where it stands. score is the largest share
    of a template's weight that stands in the file (1 for a whole phrase or statement, 0 without a match). Labels are
    distinct, sorted and joined by commas, empty without any. A null or empty text has no words. Repeated rows are judged alike; other
    columns stay as they are, but one named like a new one is replaced. No rows, no result.
    """
    made = templates(base, statements)
    vocabulary = sorted({w for t in made for w in t["words"]})
    weight = weights(docs.select(words_of(F.col(f"`{text}`")).alias("words")), vocabulary)
    anchors: dict[str, list[int]] = {}
    for n, t in enumerate(made):
        key = range(t["at"], t["at"] + t["long"])
        at = max(key, key=lambda i: (weight[t["words"][i]], -i))
        anchors.setdefault(t["words"][at], []).append(n * STRIDE - at)
    texts = lambda xs: F.array(*map(F.lit, xs))
    index = F.create_map(*(x for w, posts in anchors.items() for x in (F.lit(w), F.array(*(F.lit(p).cast("long") for p in posts)))))
    known = F.array(*(F.struct(F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"), texts(t["words"]).alias("words"), F.array(*(F.lit(weight[w]) for w in t["words"])).alias("weights"), F.lit(sum(weight[w] for w in t["words"])).alias("total"), F.lit(t["at"]).alias("at"), F.lit(t["long"]).alias("long")) for t in made))

    new = ["n_words", "matches", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    row = docs.select(F.struct(*kept).alias("row"), words_of(F.col(f"`{text}`")).alias("words"))
    rare = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(*anchors), i)))
    row = row.select("row", "words", rare.alias("rare"))
    starts = F.flatten(F.transform("rare", lambda p: F.transform(F.element_at(index, F.get("words", p)), lambda post: post + p)))
    row = row.select("row", "words", F.when(F.size("rare") > 0, F.array_distinct(starts)).otherwise(F.array().cast("array<long>")).alias("starts"))

    def held(c: Column) -> Column:
        n = F.floor((c + STRIDE // 2) / STRIDE).cast("int")
        t, start = F.get(known, n), (c - n.cast("long") * STRIDE).cast("int")
        there = lambda i: F.when(start + i >= 0, F.get("words", start + i))
        key = F.forall(F.sequence(t["at"], t["at"] + t["long"] - 1), lambda i: F.coalesce(there(i) == F.get(t["words"], i), F.lit(False)))
        got = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0), lambda a, i: a + F.when(there(i) == F.get(t["words"], i), F.get(t["weights"], i)).otherwise(0))
        return F.struct(t["label"].alias("label"), start.cast("long").alias("start"), t["base"].alias("base"), F.when(key, got / t["total"]).alias("share"))

    row = row.select("row", F.size("words").cast("long").alias("n_words"), F.filter(F.transform("starts", held), lambda m: m["share"] >= LEAST_SHARE).alias("matches"))
    places = F.transform(F.filter("matches", lambda m: m["base"]), lambda m: m["start"])
    row = row.select("row", "n_words", "matches", places.alias("places"))
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda m: m["label"]))), ",")
    return row.select(
        "row.*", "n_words", "matches", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        joined(F.filter("matches", lambda m: m["base"])).alias("base_labels"), joined("matches").alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
