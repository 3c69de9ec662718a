"""Licence scans with a positional index of rare words, in DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Licence notices as words, each with the phrases that it must hold.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    "lgpl": ("under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    "mit-notice": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
}
VOCABULARY = sorted({w for p in PHRASES for w in p.split()} | {w for text, _ in TEMPLATES.values() for w in text.split()})


def of_words(hits: Column, words: list[str]) -> Column:
    return F.filter(hits, lambda h: h["w"].isin(words))


def starts_at(hits: Column, word: str, back: int) -> Column:
    """Places of a word, less its position in a phrase."""
    return F.transform(of_words(hits, [word]), lambda h: h["at"] - back)


def spots(hits: Column, phrase: str) -> Column:
    """Start positions of a phrase: where each of its words stands at its place."""
    starts, *others = (starts_at(hits, w, i) for i, w in enumerate(phrase.split()))
    for places in others:
        starts = F.array_intersect(starts, places)
    return starts


def labelled(hits: Column, phrase: str, label: str) -> Column:
    return F.transform(spots(hits, phrase), lambda at: F.struct(F.lit(label).alias("label"), at.alias("at")))


def notice(hits: Column, label: str, idf: dict[str, float], rare: int, agree: int) -> Column:
    """(label, share of rare words that agree) where the template's notice stands, else null.

    Starts are sorted once: where k words agree, the k-th next one is equal. Starts near
    which a mandatory phrase stands are listed from the phrase's places, and sets are
    intersected, so a text of very many notices costs little more than its words.
    """
    text, needed = TEMPLATES[label]
    words = text.split()
    once = sorted((w for w in words if words.count(w) == 1), key=lambda w: (-idf[w], w))[:rare]
    least = min(agree, len(once))
    starts = F.array_sort(F.concat(*(starts_at(hits, w, words.index(w)) for w in once)))

    def named_by(ordered: Column, k: int) -> Column:
        return F.array_distinct(F.filter(ordered, lambda s, i: s == F.get(ordered, i + k - 1)))

    def judged(ordered: Column) -> Column:
        good = named_by(ordered, least)
        for p in needed:
            near = F.flatten(F.transform(spots(hits, p), lambda at: F.sequence(at - len(words), at + 1)))
            good = F.array_intersect(good, near)
        share = F.lit(least / len(once))
        for k in range(least + 1, len(once) + 1):
            share = F.when(F.size(named_by(ordered, k)) > 0, k / len(once)).otherwise(share)
        return F.when(F.size(good) > 0, F.struct(F.lit(label).alias("label"), share.alias("share")))

    return F.when(F.size(of_words(hits, once)) >= least, F.element_at(F.transform(F.array(starts), judged), 1))


def word_places(docs: DataFrame) -> DataFrame:
    """doc_id, n words, hits: (at, w) of each licence word of the whole text, in order."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", words.alias("all_words"))
    marked = F.transform("all_words", lambda w, i: F.when(w.isin(VOCABULARY), F.struct(i.alias("at"), w.alias("w"))))
    return rows.select("doc_id", F.size("all_words").cast("long").alias("n"), F.filter(marked, lambda x: x.isNotNull()).alias("hits"))


def rarity(places: DataFrame) -> dict[str, float]:
    """IDF of the licence words over all documents (as many rows as the vocabulary has words)."""
    n = places.count()
    counts = places.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in counts.collect()}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in VOCABULARY}


def scan(docs: DataFrame, rare: int = 4, agree: int = 2) -> DataFrame:
    """doc_id, n, base (array of (label, at)), more (labels of the method), score.

    Each template lists its ``rare`` highest-IDF words with their positions. A file's
    places of such words, less the position in the template, give the place where the
    notice would start; a start named by at least ``agree`` words (all, of a template
    with fewer) whose mandatory phrases stand inside it is a find. Null texts have no
    words; repeated rows give repeated rows; labels that tie are all kept; other columns, of any
    name, are ignored.
    """
    places = cut(word_places(docs))
    idf = rarity(places)
    hits = F.col("hits")
    base = F.flatten(F.array(*(labelled(hits, p, label) for p, label in PHRASES.items())))
    more = [notice(hits, label, idf, rare, agree) for label in TEMPLATES]
    named = F.filter(F.array(*more), lambda x: x.isNotNull())
    rows = places.select("doc_id", "n", F.when(F.size(hits) > 0, base).alias("base"), F.when(F.size(hits) > 0, named).alias("named"))
    score = F.greatest(F.when(F.size("base") > 0, F.lit(0.9)).otherwise(0.0), F.coalesce(F.array_max(F.transform("named", lambda x: F.least(F.lit(1.0), 0.5 + x["share"] / 2))), F.lit(0.0)))
    return rows.select("doc_id", "n", F.coalesce("base", F.array().cast("array<struct<label:string,at:int>>")).alias("base"), F.coalesce(F.transform("named", lambda x: x["label"]), F.array().cast("array<string>")).alias("more"), score.alias("score"))


def report(docs: DataFrame, **parameters) -> DataFrame:
    """One digest row per document; see ``scan``."""
    found = scan(docs, **parameters)
    at = F.transform("base", lambda x: x["at"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    every = F.array_sort(F.array_distinct(F.concat(base, "more")))
    return found.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.col("score").alias("score"),
    )
