"""License scans by diagonal voting, in DataFrame expressions only.

All rolling word k-grams of every document are joined by hash to the k-grams of the license templates (whole public licence texts in
``license_texts`` and short statements; a parameter of bounded size, so that side is broadcast). Hits are compared word by word and
counted by offset diagonal (document position minus template position), and neighbouring diagonals of one template are merged. A merged
diagonal is solid when it holds ``solid`` k-grams or most of a short template; the solid ones of a template together, as an edited or
interleaved copy lies on several, count when their words cover at least ``least`` of it. Beside that stand the base phrases, found
wherever their words follow one another.

Defined results: null text is empty; a text of any length is read whole; a document without hits has null positions, empty label lists
and score 0; rows that share a doc_id are told apart by their text's hash, so repeated rows each get the same result; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LICENSE_WORD, LICENSE_WORD_OR_CAPITALS, ascii_lower_words, let, whole_text

#: The base phrases of the query contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Short public license statements, and the label that a document gets which holds one of them.
STATEMENTS: tuple[tuple[str, str], ...] = (
    ("mit-statement", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0-statement", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3-statement", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)

#: Template k-grams that may be broadcast.
MOST_TEMPLATE_GRAMS = 100_000

Templates = tuple[tuple[str, str], ...]


@lru_cache(maxsize=1)
def public_templates() -> Templates:
    """The statements and, by the name of its file, every whole licence text of the package."""
    texts = sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt"))
    return (*STATEMENTS, *texts)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def _places(words: Column, phrase: str) -> Column:
    p = phrase.split(" ")
    n = F.size(words)
    at = F.filter(F.sequence(F.lit(0), n - len(p)), lambda i: (F.get(words, i) == p[0]) & (F.get(words, i + len(p) - 1) == p[-1]) & (F.array_join(F.slice(words, i + 1, len(p)), " ") == phrase))
    return F.when(n >= len(p), at).otherwise(F.array().cast("array<int>"))


def base_places(words: Column) -> Column:
    """An array with, for each of PHRASES in order, the array of word positions where it starts."""
    none = F.array().cast("array<int>")
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return let(joined, lambda s: F.array(*[F.when(s.contains(f" {p} "), _places(words, p)).otherwise(none) for p in PHRASES]))


def _documents(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select("doc_id", F.xxhash64(text).alias("row_key"), ascii_lower_words(text, LICENSE_WORD, LICENSE_WORD_OR_CAPITALS).alias("words"))


def _rolling(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _gram(words: Column, at: Column, k: int) -> Column:
    return F.array_join(F.slice(words, at + 1, k), " ")


def diagonal_votes(docs: DataFrame, templates: Templates | None = None, k: int = 5, near: int = 3, least: float = 0.8, solid: int = 10) -> DataFrame:
    """doc_id, row_key, label, coverage, start, end: what every document has of a template (end excluded, in words)."""
    templates = public_templates() if templates is None else templates
    counts = [len(template_words(text)) for _, text in templates]
    for (label, _), n in zip(templates, counts):
        if n < k:
            raise ValueError(f"template {label!r} has fewer than {k} words")
    if sum(counts) > MOST_TEMPLATE_GRAMS:
        raise ValueError("the templates are too large to broadcast")
    one = docs.sparkSession.range(1)
    row = lambda **values: F.struct(*[F.lit(v).alias(k) for k, v in values.items()])
    t = one.select(F.inline(F.array(*[row(t=i, label=label, text=text) for i, (label, text) in enumerate(templates)])))
    t = t.select("t", "label", ascii_lower_words(F.col("text"), LICENSE_WORD, LICENSE_WORD_OR_CAPITALS).alias("w"))
    g = t.select("t", "w", F.posexplode(_rolling(F.col("w"), k)).alias("tp", "h")).select("t", "tp", "h", _gram(F.col("w"), F.col("tp"), k).alias("gram"))
    kinds = t.select("t", "label", F.size("w").alias("n_template"))

    d = _documents(docs)
    d = d.select("doc_id", "row_key", "words", let(F.col("words"), lambda w: _rolling(w, k)).alias("hs"))
    hits = d.select("doc_id", "row_key", "words", F.posexplode("hs").alias("p", "h")).join(F.broadcast(g), "h")
    # verified word by word, not by hash alone
    hits = hits.filter(_gram(F.col("words"), F.col("p"), k) == F.col("gram"))
    cell = hits.groupBy("doc_id", "row_key", "t", (F.col("p") - F.col("tp")).alias("diagonal")).agg(F.collect_set("tp").alias("tps"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    by = Window.partitionBy("doc_id", "row_key", "t").orderBy("diagonal")
    run = cell.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by) > near).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(by))
    merged = run.groupBy("doc_id", "row_key", "t", "run").agg(F.array_distinct(F.flatten(F.collect_list("tps"))).alias("tps"), F.min("lo").alias("start"), (F.max("hi") + k).alias("end"))
    merged = merged.join(F.broadcast(kinds), "t").filter(F.size("tps") >= F.least(F.lit(solid), F.ceil(least * (F.col("n_template") - k + 1))))
    whole = merged.groupBy("doc_id", "row_key", "t", "label", "n_template").agg(F.array_distinct(F.flatten(F.collect_list("tps"))).alias("tps"), F.min("start").alias("start"), F.max("end").alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("tps", lambda p: F.sequence(p, p + k - 1)))))
    spans = whole.withColumn("coverage", covered / F.col("n_template"))
    return spans.filter(F.col("coverage") >= least).select("doc_id", "row_key", "label", "coverage", "start", "end")


def license_scan(docs: DataFrame, templates: Templates | None = None, k: int = 5, near: int = 3, least: float = 0.8) -> DataFrame:
    """One row per document: word count, base places, base and method labels, score."""
    d = _documents(docs).select("doc_id", "row_key", "words")
    info = let(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), base_places(w).alias("at")))
    d = d.select("doc_id", "row_key", info.alias("i")).select("doc_id", "row_key", F.col("i.n_words").alias("n_words"), F.flatten("i.at").alias("at"), F.transform("i.at", lambda x: F.size(x) > 0).alias("found"))
    names = F.array(*[F.when(F.get("found", F.lit(i)), F.lit(x)) for i, x in enumerate(PHRASES.values())])
    d = d.withColumn("base", F.array_sort(F.array_compact(names)))
    votes = diagonal_votes(docs, templates, k, near, least).groupBy("doc_id", "row_key").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    votes = votes.select(F.col("doc_id").alias("vote_id"), F.col("row_key").alias("vote_key"), "more", "coverage")
    d = d.join(votes, F.col("doc_id").eqNullSafe(F.col("vote_id")) & (F.col("row_key") == F.col("vote_key")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return d.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce("coverage", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
