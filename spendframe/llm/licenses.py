"""License scans: an exact set-similarity join of runs of words with license templates.

A block of a text is a run of consecutive words, ``SPREAD`` times as long as a template,
as the set of its words (A-Z as a-z). It meets the template when it contains at least
``percent`` of the template's different words. Line breaks do not count, so notices are
found on one line or wrapped at any width, with some words between; words scattered over
more than a block are not, however long the line is.

1. One pass over the texts extracts their words and stores the places of those that are
   in any template or phrase. Everything else reads this narrow table.
2. The texts with each template word are counted over all of them; rarer words come first
   in a global order, ties by name.
3. To contain c words of a template of n, a text must have one of the template's first
   n - c + 1 words in that order. For such a word, the number of words behind it in that
   order, in the text and in the template, has to leave room for c common ones, and the
   text must hold c words of the template at all.
4. What is left is verified on the blocks that begin at one of the template's words; a
   block that meets can be moved to its first one.

All steps are DataFrame expressions, and no rows are joined or shuffled but the counts:
templates are literals.

Defined cases: a null or empty text has no words, labels or places, and score 0;
repeated rows are labelled alike; a template without words never matches; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import frames

PERCENT = 90
#: A block has so many times the words of its template.
SPREAD = 2
#: Runs of digits, letters and everything beyond ASCII, in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that count wherever their words stand together.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Notices as the licenses ask for them or as they are commonly put.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z. ``lower`` is faster; it turns just two other letters into ASCII ones."""
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def _words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def words_in_order(text: str) -> list[str]:
    """The words of a template, as those of a text are read."""
    low = "".join(c.lower() if c in _UPPER else c for c in text)
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in low).split()


def word_places(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Columns doc_id, n_words and places (of the known words) of every row, stored.

    ``docs`` has doc_id and text.
    """
    words = docs.select("doc_id", _words_of(lower_ascii(F.col("text"))).alias("words"))
    known = F.array_compact(F.transform("words", lambda word, at: F.when(
        word.isin(vocabulary), F.struct(at.alias("at"), word.alias("word")))))
    return frames.store(words.select("doc_id", F.size("words").cast("long").alias("n_words"), known.alias("places")), "places")


def _frequencies(placed: DataFrame) -> dict[str, int]:
    """How many texts hold each known word."""
    held = placed.select(F.explode(F.array_distinct(F.col("places.word"))).alias("word"))
    return {row["word"]: row["n"] for row in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _template(label: str, text: str, words: list[str], percent: int) -> Column:
    """A template as a literal; its words in the global order."""
    least = -(-percent * len(words) // 100)
    return F.struct(
        F.lit(label).alias("label"), _strings(words).alias("words"), F.lit(least).alias("least"),
        _strings(words[: len(words) - least + 1]).alias("prefix"), F.lit(SPREAD * len(words_in_order(text))).alias("run"))


def met_templates(placed: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """The rows of :func:`word_places` with ``met``: label and best containment of each template met."""
    known = [(label, text, sorted(set(words_in_order(text)))) for label, text in templates if words_in_order(text)]
    if not known:
        return placed.withColumn("met", F.array().cast("array<struct<label:string,containment:double>>"))
    times = _frequencies(placed)
    order = sorted({word for _, _, words in known for word in words}, key=lambda word: (times.get(word, 0), word))
    rank = {word: place for place, word in enumerate(order)}
    literals = [_template(label, text, sorted(words, key=rank.__getitem__), percent) for label, text, words in known]
    rare = sorted({word for _, _, words in known
                   for word in sorted(words, key=rank.__getitem__)[: len(words) + percent * len(words) // -100 + 1]})

    def room(template: Column) -> Column:
        """Whether a shared prefix word leaves room on both sides for enough common words."""
        def fits(word: Column, place: Column) -> Column:
            at = F.array_position("block", word).cast("int")
            behind = F.least(F.size("block") - at, F.size(template["words"]) - place - 1)
            return (at > 0) & (behind + 1 >= template["least"])

        return F.exists(F.transform(template["prefix"], fits), lambda one: one)

    def holds(template: Column) -> Column:
        return (F.size("block") >= template["least"]) & room(template) & (
            F.size(F.array_intersect("block", template["words"])) >= template["least"])

    def common(template: Column) -> Column:
        """The most different words of a template that a block has."""
        mine = F.filter("places", lambda one: F.array_contains(template["words"], one["word"]))

        def most(own: Column) -> Column:
            def from_one(first: Column, at: Column) -> Column:
                near = F.filter(F.slice(own, at + 1, template["run"]), lambda one: one["at"] < first["at"] + template["run"])
                return F.size(F.array_distinct(near["word"]))

            return F.array_max(F.transform(own, from_one))

        return F.get(F.transform(F.array(mine), most), F.lit(0))

    def found(template: Column) -> Column:
        return F.struct(template["label"].alias("label"), template["least"].alias("least"), common(template).alias("common"),
                        F.size(template["words"]).alias("size"))

    words = F.array_distinct(F.col("places.word"))
    # Words in the global order: an intersection keeps the order of its first side.
    blocks = placed.select("*", F.when(F.arrays_overlap(words, _strings(rare)), F.array_intersect(_strings(order), words)).alias("block"))
    candidates = blocks.select("*", F.filter(F.array(*literals), holds).alias("asked"))
    counted = candidates.select("*", F.transform("asked", found).alias("found"))
    enough = F.filter("found", lambda one: one["common"] >= one["least"])
    met = F.transform(enough, lambda one: F.struct(one["label"].alias("label"), (one["common"] / one["size"]).alias("containment")))
    return counted.select(*placed.columns, F.coalesce(met, F.array().cast("array<struct<label:string,containment:double>>")).alias("met"))


def _phrase_places(label: str, words: list[str]) -> Column:
    """The places in ``places`` where the words stand together."""

    def stands(first: Column, at: Column) -> Column:
        here = first["word"] == words[0]
        for step, word in enumerate(words[1:], 1):
            following = F.get("places", at + step)
            here = here & (following["word"] == word) & (following["at"] == first["at"] + step)
        return F.when(here, F.struct(F.lit(label).alias("label"), first["at"].alias("at")))

    return F.array_compact(F.transform("places", stands))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT,
         text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, places of the phrases, base and all labels, and the score of each row."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), whole.alias("text"))
    vocabulary = {word for _, text in templates for word in words_in_order(text)} | {
        word for phrase in PHRASES.values() for word in phrase.split()}
    met = met_templates(word_places(rows, sorted(vocabulary)), templates, percent)
    based = met.select("doc_id", "n_words", "met", F.concat(*[
        _phrase_places(label, phrase.split()) for label, phrase in PHRASES.items()]).alias("base"))
    base_labels = F.array_sort(F.array_distinct(F.col("base.label")))
    return based.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.at")).cast("long").alias("first_word"), F.array_max(F.col("base.at")).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("base.label"), F.col("met.label"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("met.containment")), F.lit(0.0))).alias("score"))
