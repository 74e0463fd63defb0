"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule's cost and selectivity are estimated on a bounded sample (``sample_rows``, a documented parameter that affects the
order of evaluation only, never a verdict): the sample's rows are repeated until a rule takes well over what a Spark job takes anyway,
and the median of several readings counts. Rules are then chosen one by one, each time the one that rejects most of the documents
which those before it leave per second, and run in that order inside one CASE expression, so a document that an early rule
rejects never pays for the later ones, nor for the features that only they use. Where verdicts alone are wanted, the two base tests
are members of the cascade like the others.

Defined results: null or empty text has no words and fails the base rule; a text of any length is judged whole; ties and repeated
rows are judged row by row; an empty table gives an empty result; further input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, WORD, let, whole_text, words_of

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column, width: int = SHINGLE_WORDS) -> Column:
    """Words that lie in a ``width``-word window which occurs at least twice, the first occurrence included."""

    def covered(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            n = F.size(s)
            twice = F.filter(
                s,
                lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == x["h"])),
            )
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.when(j == 0, F.lit(width)).otherwise(F.least(F.lit(width), x - F.get(p, j - 1))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, starts), total)

    def windows(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
        found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
        return F.when(n <= width, F.lit(0).cast("long")).otherwise(found)

    return windows(words)


def features(text: Column) -> Column:
    """A struct of the base features of ``text``."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = words_of(text)
    return F.struct(
        let(w, lambda x: F.struct(F.size(x).cast("long").alias("n_words"), repeated_words(x).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, "\t\n\x0b\x0c\r ", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
    )


@dataclass(frozen=True)
class Rule:
    """``fails(columns)`` is true for a document to reject; ``columns`` has the base features, ``text`` and ``n_lines``."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


RULES: tuple[Rule, ...] = (
    Rule("symbols_per_word", lambda c: 10 * c["n_symbols"] > 2 * c["n_words"]),
    Rule("mean_word_length", lambda c: (c["word_chars"] > 15 * c["n_words"]) | (10 * c["word_chars"] < 15 * c["n_words"])),
    Rule("duplicate_lines", lambda c: (c["n_dup_lines"] > 1) & (10 * c["n_dup_lines"] > 3 * c["n_lines"])),
    Rule("capitals", lambda c: 2 * F.regexp_count(c["text"], F.lit(r"\p{Lu}")) > F.regexp_count(c["text"], F.lit(r"\p{L}"))),
    Rule("letters", lambda c: 2 * F.regexp_count(c["text"], F.lit(r"\p{L}")) < c["word_chars"]),
    Rule("stutter", lambda c: 10 * F.regexp_count(c["text"], F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))")) > 3 * c["n_words"]),
    Rule("shouted_ends", lambda c: 5 * F.regexp_count(c["text"], F.lit(r"!!")) > c["n_words"]),
)

#: The base rule's two tests, as members of a cascade.
BASE_RULES: tuple[Rule, ...] = (Rule("few_words", lambda c: c["n_words"] < 10), Rule("repeated_words", lambda c: 100 * c["n_repeat_words"] > 20 * c["n_words"]))

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base features of every document."""
    d = docs.select(F.col("doc_id"), whole_text().alias("text"))
    f = d.select("doc_id", "text", features(F.col("text")).alias("f"))
    return f.select(
        "doc_id", "text", F.col("f.w.n_words").alias("n_words"), F.col("f.word_chars").alias("word_chars"), F.col("f.n_symbols").alias("n_symbols"),
        F.col("f.lines.dup").alias("n_dup_lines"), F.col("f.w.n_repeat_words").alias("n_repeat_words"), F.col("f.lines.n").alias("n_lines"),
    )


def _columns() -> dict[str, Column]:
    return {c: F.col(c) for c in ("text", "n_lines", *_BASE)}


def lazy_features(text: Column, words: Column) -> dict[str, Column]:
    """The features as expressions of the text and its words, each evaluated where a rule that is reached uses it."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "text": text, "n_words": F.size(words), "n_repeat_words": repeated_words(words), "word_chars": F.length(F.translate(text, "\t\n\x0b\x0c\r ", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")), "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_lines": F.size(lines),
    }


def measured(sample: DataFrame, tests: Sequence[Column], least_seconds: float = 0.12, readings: int = 3, most_repeats: int = 512) -> list[float]:
    """Seconds that each test takes a row of ``sample``, above those of a job that tests nothing."""
    n = max(1, sample.count())

    def seconds(test: Column, repeats: int) -> float:
        many = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_again"))
        began = time.perf_counter()
        many.agg(F.sum(F.when(test, 1).otherwise(0))).first()
        return time.perf_counter() - began

    nothing: dict[int, float] = {}

    def above(test: Column, repeats: int) -> float:
        if repeats not in nothing:
            nothing[repeats] = median([seconds(F.lit(False), repeats) for _ in range(readings)])
        return seconds(test, repeats) - nothing[repeats]

    out = []
    seconds(F.lit(False), 1)
    for test in tests:
        repeats = 8
        seconds(test, repeats)  # compiled before it is timed
        while (took := above(test, repeats)) < least_seconds and repeats < most_repeats:
            repeats *= 8
        out.append(max(median([took, *[above(test, repeats) for _ in range(readings - 1)]]), 1e-6) / (n * repeats))
    return out


def greedy_order(hits: Sequence[Sequence[bool]], costs: Sequence[float]) -> list[int]:
    """Rules by rejections per cost among the rows that those before leave (hits: by row, whether each rule rejects it); then by cost."""
    left, rows, out = set(range(len(costs))), list(hits), []
    while left:
        worth = {k: sum(bool(r[k]) for r in rows) / costs[k] for k in left}
        best = max(left, key=lambda k: (worth[k], -costs[k], -k))
        out.append(best)
        left.discard(best)
        rows = [r for r in rows if not r[best]]
    return out


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 256, seed: int = 7, lazy: bool = False) -> list[Rule]:
    """The rules in the order of the cascade, by what at most ``sample_rows`` documents show.

    With ``lazy`` a rule's cost includes the features it uses, as in a cascade over the text itself.
    """

    def prepared(d: DataFrame) -> DataFrame:
        return d.select(F.coalesce(d["text"], F.lit("")).alias("text")).withColumn("words", words_of(F.col("text"))) if lazy else base_columns(d)

    sample = prepared(docs.sample(0.02, seed=seed).limit(sample_rows)).cache()
    try:
        if sample.count() < min(32, sample_rows):
            sample.unpersist()
            sample = prepared(docs.limit(sample_rows)).cache()
        c = lazy_features(F.col("text"), F.col("words")) if lazy else _columns()
        tests = [rule.fails(c) for rule in rules]
        hits = sample.select(*[F.coalesce(t, F.lit(False)).alias(f"t{k}") for k, t in enumerate(tests)]).collect()
        return [rules[k] for k in greedy_order(hits, measured(sample, tests))] if hits else list(rules)
    finally:
        sample.unpersist()


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 256) -> DataFrame:
    """doc_id, the base features, base_failed and kept of every document."""
    ordered = order_rules(docs, rules, sample_rows)
    f = base_columns(docs)
    c = _columns()
    failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
    verdict = F.when(failed, F.lit(False))
    for rule in ordered:
        verdict = verdict.when(rule.fails(c), F.lit(False))
    return f.select("doc_id", *_BASE, failed.alias("base_failed"), verdict.otherwise(F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES, sample_rows: int = 256) -> DataFrame:
    """The rows of ``docs`` that no rule of the cascade rejects, with their own columns and no others."""
    ordered = order_rules(docs, rules, sample_rows, lazy=True)
    text = F.coalesce(docs["text"], F.lit(""))

    def passes(t: Column) -> Column:
        def verdict(words: Column) -> Column:
            c = lazy_features(t, words)
            out = F.when(F.lit(False), F.lit(False))
            for rule in ordered:
                out = out.when(rule.fails(c), F.lit(False))
            return out.otherwise(F.lit(True))

        return let(words_of(t), verdict)

    f = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"))
    return f.filter(passes(F.col("text"))).select("row.*")


#: What SQL can say of the query: everything, the rules above restated.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, p, ws[p] || ' ' || ws[p+1] || ' ' || ws[p+2] || ' ' || ws[p+3] || ' ' || ws[p+4] AS s FROM g),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS n FROM h),
q AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r WHERE n > 1),
rep AS (SELECT doc_id, sum(CASE WHEN before IS NULL THEN 5 ELSE least(5, p - before) END)::BIGINT AS n FROM q GROUP BY doc_id),
f AS (SELECT w.doc_id, text, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS stutter,
        len(regexp_extract_all(text, '\p{Lu}')) AS caps, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '!!')) AS bangs
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 2 * n_words OR word_chars > 15 * n_words OR 10 * word_chars < 15 * n_words
       OR (n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines) OR 10 * stutter > 3 * n_words OR 2 * caps > letters OR 2 * letters < word_chars OR 5 * bangs > n_words) AS kept
FROM b
"""
