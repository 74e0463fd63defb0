"""Document fingerprints by winnowing, in DataFrame expressions only.

Words are hashed, every ``k`` consecutive words give a rolling k-gram hash of 64 bits, and of every window of ``w`` consecutive k-gram
hashes the smallest is chosen, the rightmost of equal ones. Any run of at least ``w + k - 1`` words that two texts share contains a
chosen k-gram of both (the match guarantee); positions are kept for it.

Defined results: null text is empty; a text without words has an empty fingerprint; a text of fewer than ``k`` words has one
k-gram of all its words; a text of any length is read whole; two empty fingerprints are alike to 1, an empty and another to 0; equal
texts have equal fingerprints. Ties of doc_id are ordered by text, null ids first; repeated rows follow one another; with a single row
the next is the row itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, shuffle_width, whole_text, words_of

_LOWEST = -(1 << 63)


def winnow(text: Column, k: int = 3, window: int = 8) -> Column:
    """array<struct<hash bigint, position int>> of the chosen k-grams in text order."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def grams(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        few = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= k, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))

    def places(g: Column) -> Column:
        # the place of the smallest hash of 1, 2, 4, ... grams from each on; a tie goes to the right one
        def wider(at: Column, step: int) -> Column:
            def better(i: Column) -> Column:
                return let(F.struct(F.get(at, i).alias("l"), F.get(at, i + step).alias("r")), lambda p: F.when(F.get(g, p["l"]) < F.get(g, p["r"]), p["l"]).otherwise(p["r"]))

            return F.transform(F.sequence(F.lit(0), F.size(at) - step - 1), better)

        def halve(at: Column, step: int) -> Column:
            return F.array_distinct(at) if step == window else let(wider(at, step), lambda x: halve(x, 2 * step))

        first = F.sequence(F.lit(0), F.size(g) - 1)
        # fewer grams than a window are one window
        last_least = F.size(g) - F.array_position(F.reverse(g), F.array_min(g)).cast("int")
        return F.when(F.size(g) == 0, F.array().cast("array<int>")).when(F.size(g) < window, F.array(last_least)).otherwise(let(first, lambda x: halve(x, 1)))

    def chosen(g: Column) -> Column:
        return F.transform(places(g), lambda i: F.struct(F.get(g, i).alias("hash"), i.alias("position")))

    return let(let(F.transform(words_of(text), lambda x: F.xxhash64(x)), grams), chosen)


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: x["hash"]))


def shown(chosen: Column) -> Column:
    """``position:hash`` of each chosen k-gram, comma-joined."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(x["position"].cast("string"), F.lit(":"), F.lower(F.hex(x["hash"])))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes."""

    def ratio(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        union = F.size(x) + F.size(y) - both
        return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / union)

    return let(hashes(a), lambda x: let(hashes(b), lambda y: ratio(x, y)))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document beside the text of the next one by doc_id, after the last the first, with a single shuffle of the texts.

    doc_id quantiles cut the ids into as many blocks as there are shuffle partitions; the first document of a block is also sent
    to the block before it, so that no row has to look beyond its own block.
    """
    d = docs.select("doc_id", whole_text().alias("text")).withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)))
    n = shuffle_width(d.sparkSession)
    bounds = d.agg(F.percentile_approx("ord", [(i + 1) / n for i in range(n - 1)] or [0.5], 10_000).alias("q"), F.min("ord").alias("lo")).first()
    lo = bounds["lo"] if bounds["lo"] is not None else 0
    cuts = sorted({x for x in bounds["q"] or [] if x > lo})
    wide = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if rows:
        # two short searches, of the block of cuts and then in it, instead of one over all cuts
        nested = F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rows])
        heads = F.array(*[F.lit(r[0]).cast("long") for r in rows])
        at = F.size(F.filter(heads, lambda x: x <= F.col("ord")))
        inside = F.size(F.filter(F.get(nested, F.greatest(F.col("r") - 1, F.lit(0))), lambda x: x <= F.col("ord")))
        d = d.withColumn("r", at).withColumn("block", F.greatest(F.col("r") - 1, F.lit(0)) * wide + inside)
        first = F.array_contains(F.get(nested, F.greatest(F.col("r") - 1, F.lit(0))), F.col("ord"))
    else:
        d, first = d.withColumn("block", F.lit(0)), F.lit(False)
    place = lambda block, wrap, copy: F.struct(block.cast("int").alias("block"), F.lit(wrap).alias("wrap"), F.lit(copy).alias("copy"))
    places = F.filter(
        F.array(
            place(F.col("block"), 0, False),
            F.when(first, place(F.col("block") - 1, 0, True)),
            F.when(F.col("ord") == lo, place(F.lit(len(cuts)), 1, True)),
        ),
        lambda x: x.isNotNull(),
    )
    dealt = d.select("doc_id", "ord", "text", F.explode(places).alias("p")).select("doc_id", "ord", "text", "p.*")
    by = Window.partitionBy("block").orderBy("wrap", "ord", "text")
    return dealt.withColumn("next_text", F.lead("text").over(by))


def fingerprints(docs: DataFrame, k: int = 3, window: int = 8) -> DataFrame:
    """doc_id and the winnowed fingerprint (array of hash and position) of every document."""
    return docs.select("doc_id", winnow(whole_text(), k, window).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, k: int = 3, window: int = 8) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and the likeness to it and to the next document's."""
    d = with_next(docs).withColumn("n", F.length("text")).withColumn("q", F.floor(F.col("n") / 4).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("q")), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), F.col("q")))
    d = d.select("doc_id", "ord", "wrap", "copy", "block", F.col("text"), F.col("n").cast("long").alias("n_chars"), edited.alias("edited"))
    by = Window.partitionBy("block").orderBy("wrap", "ord", "text")
    d = d.withColumn("fp", winnow(F.col("text"), k, window)).withColumn("next_fp", F.lead("fp").over(by)).filter(~F.col("copy"))
    d = d.withColumn("efp", winnow(F.col("edited"), k, window))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("fp")).alias("fingerprint"), shown(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
