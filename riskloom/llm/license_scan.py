"""License scans as an exact set-similarity join of text blocks and license templates.

Blocks are sentences, over all their lines: a text is cut at sentence ends and blank lines only, as
notices are wrapped. A sentence of more than ``BLOCK_WORDS`` words is cut into overlapping windows,
so a notice inside a sentence lies whole in some block. A block matches a template if it holds at least
``CONTAINMENT`` of the template's distinct words. Words of the templates are ordered by the
number of documents that hold them, rarest first. A block that matches holds at least one word
of the template's prefix (prefix filter), is long enough (length filter), and what is left
behind the matched places in both orders suffices (positional filter). What passes is verified
by counting. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import ascii_lower, fenced, fenced_count, fenced_words
from riskloom.llm.texts import only
from riskloom.session import settle

CONTAINMENT = 0.8
BLOCK_WORDS = 64
MOST_TEMPLATES = 2_000  # templates whose words may be named in the plan

# fixed values: the base phrases and their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# fixed values: opening words of public license notices
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "licensed under the mozilla public license version 2 0"),
    ("epl-2", "licensed under the eclipse public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
)


def needed(n: int, containment: float = CONTAINMENT) -> int:
    """Words of a template of ``n`` distinct words that a block must hold."""
    return math.ceil(round(containment * n, 9))


def base_places(fenced_text: Column, n_words: Column, phrases: Mapping[str, str] = PHRASES) -> tuple[Column, Column, Column, Column]:
    """Number of places, smallest start, largest start and labels of the phrases."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        needle = F.lit(fenced(phrase))
        here = F.contains(fenced_text, needle)
        gone = F.length(fenced_text) - F.length(F.replace(fenced_text, needle, F.lit("")))
        counts.append(F.when(here, (gone / len(fenced(phrase))).cast("long")).otherwise(F.lit(0).cast("long")))
        before = F.substring_index(fenced_text, fenced(phrase), 1)
        after = F.substring_index(fenced_text, fenced(phrase), -1)
        blanks = lambda part: F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))
        firsts.append(F.when(here, (blanks(before) / 2).cast("long")))
        lasts.append(F.when(here, n_words - (blanks(after) / 2).cast("long") - len(phrase.split())))
        labels.append(F.when(here, F.lit(label)))
    found = F.array_compact(F.array(*labels))
    smallest = F.array_min(F.array_compact(F.array(*firsts)))
    largest = F.array_max(F.array_compact(F.array(*lasts)))
    return sum(counts[1:], counts[0]), smallest, largest, F.array_sort(F.array_distinct(found))


def blocks(text: Column, most: int = BLOCK_WORDS) -> Column:
    """Word arrays of the blocks of a text; blocks without a word are left out."""
    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - F.lit(most // 2), F.lit(1)), F.lit(most // 2))
        return F.transform(starts, lambda s: F.slice(words, s, most))

    sentences = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[.!?][ \r\n]|\n[\t\x0B-\r ]*\n")
    words = F.transform(sentences, lambda s: F.split(F.btrim(F.regexp_replace(s, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" ")), " "))
    return F.flatten(F.transform(F.filter(words, lambda w: w[0] != ""), cut))


_MET = "array<struct<template: int, label: string, own: array<int>, mine: array<int>>>"


def named(met: Column, containment: float = CONTAINMENT) -> Column:
    """Labels and scores of the templates that a block names, of all that it matches.

    The templates that share the most words with the block come first, of these the shortest, ties
    all. Then, again and again, those that share the most words no named template holds, as long as
    ``containment`` of their words that no named template holds stand in the block.
    """
    def step(state: Column, _: Column) -> Column:
        known = state["known"]
        left = F.transform(state["rest"], lambda t: F.struct(
            F.size(F.array_except(t["mine"], known)).alias("new"), (-F.size(t["own"])).alias("short"), F.size(F.array_except(t["own"], known)).alias("of"), t.alias("t")))
        able = F.filter(left, lambda t: (t["new"] > 0) & (t["new"] >= F.ceil(F.round(F.lit(containment) * t["of"], 9))))
        best = F.array_max(F.transform(able, lambda t: F.struct(t["new"].alias("new"), t["short"].alias("short"))))
        won = F.transform(F.filter(able, lambda t: F.struct(t["new"].alias("new"), t["short"].alias("short")) == best), lambda t: t["t"])
        after = F.struct(
            F.array_union(known, F.flatten(F.transform(won, lambda t: t["own"]))).alias("known"),
            F.array_except(state["rest"], won).alias("rest"),
            F.concat(state["kept"], F.transform(won, lambda t: F.struct(t["label"].alias("label"), (F.size(t["mine"]) / F.size(t["own"])).alias("score")))).alias("kept"))
        return F.when(F.size(able) > 0, after).otherwise(F.struct(known.alias("known"), F.array().cast(_MET).alias("rest"), state["kept"].alias("kept")))

    start = F.struct(F.array().cast("array<int>").alias("known"), met.cast(_MET).alias("rest"), F.array().cast("array<struct<label: string, score: double>>").alias("kept"))
    return F.aggregate(F.sequence(F.lit(1), F.size(met)), start, step)["kept"]


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_base``, ``first_word``,
    ``last_word``, ``base_labels``, ``labels`` and ``score``.

    ``labels`` joins the base labels and those of matched templates, of one block those that
    ``named`` keeps. ``score`` is 1 with a base label, else the largest containment
    of a kept match, else 0. Null and empty texts have no words, no labels and null places.
    Repeated rows each get their own row; other columns are not read. A template must fit into half a block; an empty template matches nothing.
    """
    spark = docs.sparkSession
    sets = [(i, label, sorted(set(words.split()))) for i, (label, words) in enumerate(templates) if words.split()]
    if len(sets) > MOST_TEMPLATES or any(len(t.split()) > block_words // 2 for _, t in templates):
        raise ValueError("too many templates, or one is longer than half a block")
    universe = sorted({w for _, _, words in sets for w in words})
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = texts.withColumn("_row", F.monotonically_increasing_id())
    spread = texts.withColumn("_words", fenced_words(F.col("text"))).withColumn("n_words", fenced_count(F.col("_words")))
    n_base, first, last, labels = base_places(F.col("_words"), F.col("n_words"), phrases)
    # Which template words a document holds serves the global order and the prefix filter.
    held = F.array_compact(F.array(*[F.when(F.contains("_words", F.lit(f" {w} ")), F.lit(i)) for i, w in enumerate(universe)]))
    fewest = min((needed(len(words), containment) for _, _, words in sets), default=1)
    scanned = spread.select(
        "_row", "doc_id", "n_words", n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"), labels.alias("base"), held.alias("held"),
        F.when(F.size(held) >= fewest, F.col("text")).alias("text"))
    scanned = settle(scanned, "license-scan")
    counted = {r["w"]: r["n"] for r in scanned.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # template words only
    order = sorted(range(len(universe)), key=lambda i: (counted.get(i, 0), universe[i]))
    rank = {universe[i]: k for k, i in enumerate(order)}
    entries, whole = [], []
    for number, label, words in sets:
        ranks = sorted(rank[w] for w in words)
        least = needed(len(ranks), containment)
        whole.append((number, label, ranks, len(ranks), least))
        entries += [(r, number, place, len(ranks), least) for place, r in enumerate(ranks[: len(ranks) - least + 1])]
    if not entries:
        matched = scanned.select("_row", F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("score")).filter("false")
    else:
        prefix_ranks = {e[0] for e in entries}
        starts = F.array(*[F.lit(i) for i in range(len(universe)) if rank[universe[i]] in prefix_ranks])
        numbers = F.map_from_arrays(F.array(*[F.lit(w) for w in universe]), F.array(*[F.lit(rank[w]) for w in universe]))
        known = F.array(*[F.lit(w) for w in universe])
        # Only documents that hold a prefix word and enough template words are cut into blocks.
        some = scanned.filter(F.col("text").isNotNull() & F.arrays_overlap("held", starts)).select("_row", F.posexplode(blocks(F.col("text"), block_words)).alias("block", "words"))
        ranked = some.select("_row", "block", F.array_intersect("words", known).alias("mine")).filter(F.size("mine") >= min(e[4] for e in entries))  # length filter
        ranked = ranked.select("_row", "block", F.array_sort(F.transform("mine", lambda w: numbers[w])).alias("ranks"))
        probes = ranked.select("_row", "block", "ranks", F.posexplode("ranks").alias("at", "token"))
        index = spark.createDataFrame(entries, "token int, template int, place int, n int, least int")
        room = F.lit(1) + F.least(F.col("n") - F.col("place") - 1, F.size("ranks") - F.col("at") - 1)
        # A match shares at least one prefix word; the first shared one leaves the most room behind it.
        passed = probes.join(index, "token").filter(room >= F.col("least")).select("_row", "block", "ranks", "template").distinct()
        full = spark.createDataFrame(whole, "template int, label string, own array<int>, n int, least int")
        verified = passed.join(full, "template").withColumn("mine", F.array_intersect("ranks", "own")).filter(F.size("mine") >= F.col("least"))
        met = verified.groupBy("_row", "block").agg(F.collect_list(F.struct("template", "label", "own", "mine")).alias("met"))  # as many as there are templates at most
        matched = met.select("_row", F.explode(named(F.col("met"), containment)).alias("kept")).select("_row", "kept.label", "kept.score")
    found = matched.groupBy("_row").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return scanned.drop("text", "held").join(found, "_row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))
