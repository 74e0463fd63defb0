"""Mixing sources to target weights by capped water-filling and seeded whole and fractional repetitions.

The sources, by code point with the null source last, take the weights in turn and share ``share`` times all words. A source's
target stops at ``epochs`` times its words; the excess goes to the others in proportion to their weights until none is above its
cap, which is the level ``l`` with sum(min(cap, l * weight)) = total. Each document is then taken a whole number of times, and a
seeded choice of documents once more for the fraction that is left: within a source the documents are ordered by a keyed digest
of their id and text, first those above a hundredth of the source (there are at most a hundred), then the rest, and taken while the middle
of the document lies below the goal. So each source comes to within about half of its last document's words of its target.

Nothing is gathered by source: the rest's words are summed in 4096 digest buckets a source, and only the bucket in which the goal
lies is ordered, by distinct keys. The choice is a threshold on the key, a few values a source, so that documents are never shuffled
for it. Rows that repeat the key at the threshold (one id, source and text) are taken one by one until the goal is reached; they are numbered
by the tasks that read them, never in one place.

Defined results: null or empty text has size 0 and is taken 0 times its words; null source is a source of its own; a text of any length is
counted whole; repeated rows are documents of their own, also without a doc_id: a whole repetition takes all of them, a fraction as many as
bring the source to its target; when there are no words every target is 0; an empty table gives an empty
result; further columns pass through :func:`mixed` unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

WEIGHTS = (5, 2, 1)
#: More sources than this are joined by a shuffle instead of a broadcast.
MOST_BROADCAST_SOURCES = 100_000
_NO_ID = -(1 << 63)


def _sized(docs: DataFrame, seed: int) -> tuple[Column, Column, Column, Column]:
    text = F.coalesce(docs["text"], F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit("|"), F.md5(F.encode(text, "UTF-8"))))
    return docs["doc_id"], docs["source"], size, digest


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    doc_id, source, size, digest = _sized(docs, seed)
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), digest.alias("h"))


def water_fill(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """source, source_size, target from a table of one row per source (source, source_size)."""
    everything = Window.partitionBy()
    ranked = totals.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rn") - 1) % len(weights)))
    ranked = ranked.withColumn("cap", F.lit(epochs) * F.col("source_size")).withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rn")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") < F.col("cap"))
    # the first source, by cap over weight, that is not filled to its cap has the level of all that are not
    final = F.min(F.when(F.col("below"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("rn"), F.col("level")))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(final * F.col("weight"), F.col("cap").cast("double")))
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 11) -> DataFrame:
    """One row per source: source, source_size, target, whole, cut_big, cut_small (thresholds of the fractional repetition)."""
    d = checkpointed(sizes(docs, seed).withColumn("key", F.struct(F.col("h"), F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).alias("id"), F.col("size"))))
    totals = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = checkpointed(water_fill(totals, weights, share, epochs))
    few = goals.count() <= MOST_BROADCAST_SOURCES
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goals = goals.withColumn("extra", F.when(F.col("source_size") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnRenamed("source", "of_source")
        return left.join(F.broadcast(r) if few else r, left["source"].eqNullSafe(r["of_source"])).drop("of_source")

    def taken_upto(keys: DataFrame, goal: Column, base: Column) -> DataFrame:
        """source, taken (words), cut: the last key of which rows are taken, of how many there are, and how many."""
        running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        size = F.col("key.size")
        before = base + F.coalesce(F.sum(size * F.col("rows")).over(running), F.lit(0))
        # as many rows as have their middle below the goal
        some = F.when(size > 0, F.floor((goal - before) / size + 0.5)).otherwise(F.when(before <= goal, F.col("rows")).otherwise(0))
        keys = keys.withColumn("some", F.least(F.col("rows"), F.greatest(some, F.lit(0))).cast("long"))
        cut = F.max(F.when(F.col("some") > 0, F.struct("key", "rows", "some")))
        return keys.groupBy("source").agg(F.sum(size * F.col("some")).alias("taken"), cut.alias("cut"))

    d = beside(d, goals.select("source", "source_size", "extra"))
    big = F.col("size") * 100 > F.col("source_size")
    bigs = d.filter(big).groupBy("source", "source_size", "extra", "key").agg(F.count("*").alias("rows"))
    bigs = bigs.withColumn("all_big", F.sum(F.col("key.size") * F.col("rows")).over(Window.partitionBy("source")))
    big_sizes = bigs.groupBy("source").agg(F.first("all_big").alias("big_size"))
    big_sums = taken_upto(bigs, F.col("extra") * F.col("all_big") / F.col("source_size"), F.lit(0)).select("source", F.col("taken").alias("big_taken"), F.col("cut").alias("cut_big"))
    big_sums = big_sums.join(big_sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    g = goals.join(big_sums.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    g = g.withColumn("small_goal", F.greatest(F.lit(0.0), F.col("extra") - F.coalesce("big_taken", F.lit(0)))).withColumn("small_size", F.col("source_size") - F.coalesce("big_size", F.lit(0)))
    small = d.filter(~big).withColumn("bucket", F.substring("h", 1, 3))
    buckets = small.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    buckets = buckets.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    edge = beside(buckets, g.select("source", "small_goal")).filter((F.col("upto") > F.col("small_goal")) & (F.col("upto") - F.col("n") <= F.col("small_goal")))
    edge = edge.groupBy("source", "small_goal").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("base"))).alias("e"))
    e = edge.select(F.col("source"), "small_goal", F.col("e.bucket").alias("edge_bucket"), F.col("e.base").alias("base"))
    last = beside(small.select("source", "key", "bucket"), e).filter(F.col("bucket") == F.col("edge_bucket"))
    last = last.groupBy("source", "small_goal", "base", "key").agg(F.count("*").alias("rows"))
    last = taken_upto(last, F.col("small_goal"), F.col("base")).select(F.col("source").alias("of_source"), F.col("cut").alias("cut_in_edge"))
    g = g.join(e.select(F.col("source").alias("of_source"), "edge_bucket"), F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    g = g.join(last, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    none, least = F.lit(0).cast("long"), (F.lit(_NO_ID).alias("id"), F.lit(-1).cast("long").alias("size"))
    bound = lambda h: F.struct(F.struct(h.alias("h"), *least).alias("key"), none.alias("rows"), none.alias("some"))
    # no edge: the goal is all of the small documents, or there are none
    everything, nothing = bound(F.lit("g")), bound(F.lit(""))
    at_edge = F.coalesce("cut_in_edge", F.when(F.col("edge_bucket").isNotNull(), bound(F.col("edge_bucket"))).otherwise(everything))
    whole = F.col("extra") <= 0
    return checkpointed(
        g.select("source", "source_size", "target", "whole", F.when(whole, nothing).otherwise(F.coalesce("cut_big", nothing)).alias("cut_big"), F.when(whole, nothing).otherwise(at_edge).alias("cut_small"))
    )


def _with_repeats(d: DataFrame, p: DataFrame) -> DataFrame:
    """``d`` (doc_id, source, size, h and others) with its source's plan and the number of times that each row is taken."""
    d = _with_plan(d, p)
    key = F.struct(F.col("h").alias("h"), F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).alias("id"), F.col("size").alias("size"))
    cut = F.when(F.col("size") * 100 > F.col("plan.source_size"), F.col("plan.cut_big")).otherwise(F.col("plan.cut_small"))
    more = F.when(key < cut["key"], 1).when((key == cut["key"]) & (cut["some"] >= cut["rows"]) & (cut["some"] > 0), 1).otherwise(0)
    partly = lambda c: F.col(f"{c}.some") < F.col(f"{c}.rows")
    repeats = lambda x: (F.col("plan.whole") + x).cast("long")
    if p.filter(partly("cut_big") | partly("cut_small")).isEmpty():
        return d.withColumn("repeats", repeats(more))
    # repeated rows of which some are taken: numbered within the task that reads them, and by the numbers of rows of the tasks before
    tied = (key == cut["key"]) & (cut["some"] < cut["rows"])
    ties = d.filter(tied).select("*", key.alias("tie"), cut["some"].alias("some")).withColumn("task", F.spark_partition_id())
    by_task = ties.groupBy("source", "tie", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source", "tie").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select(F.col("source").alias("s"), F.col("tie").alias("t"), F.col("task").alias("k"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ties = ties.withColumn("no", F.row_number().over(Window.partitionBy("source", "tie", "task").orderBy("size")))
    ties = ties.join(by_task, F.col("source").eqNullSafe(F.col("s")) & (F.col("tie") == F.col("t")) & (F.col("task") == F.col("k")))
    ties = ties.withColumn("repeats", repeats(F.when(F.col("no") + F.col("before") <= F.col("some"), 1).otherwise(0))).select(*d.columns, "repeats")
    return d.filter(~tied).withColumn("repeats", repeats(more)).union(ties)


def _with_plan(d: DataFrame, p: DataFrame) -> DataFrame:
    few = p.count() <= MOST_BROADCAST_SOURCES
    side = p.select(F.col("source").alias("of_source"), F.struct(*p.columns).alias("plan"))
    return d.join(F.broadcast(side) if few else side, d["source"].eqNullSafe(side["of_source"]))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken and repeats of every document."""
    d = _with_repeats(sizes(docs, seed), plan(docs, weights, share, epochs, seed))
    return d.select("doc_id", "size", F.col("plan.source_size").alias("source_size"), F.col("plan.target").alias("target"), (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns and no others."""
    p = plan(docs, weights, share, epochs, seed)
    doc_id, source, size, digest = _sized(docs, seed)
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), digest.alias("h"))
    d = _with_repeats(d, p)
    return d.select("row", F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('11|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM t),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap,
        1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM r),
l AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio,
        (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM w),
f AS (SELECT arg_min(lev, (ratio, rn)) AS lev FROM l WHERE lev * weight < cap),
g AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT lev FROM f) * weight, cap::DOUBLE)) AS target FROM l),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
y AS (SELECT *, CASE WHEN source_size > 0 THEN target - whole * source_size ELSE 0.0 END AS extra FROM x),
j AS (SELECT d.doc_id, d.size, d.h, y.*, d.size * 100 > y.source_size AS big FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source),
m AS (SELECT *, (sum(size) OVER (PARTITION BY source, big ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::DOUBLE - size::DOUBLE / 2 AS middle,
        (sum(size) OVER (PARTITION BY source, big))::DOUBLE AS part FROM j),
b AS (SELECT source, coalesce(sum(size) FILTER (WHERE big AND middle <= extra * part / source_size AND extra > 0), 0)::DOUBLE AS big_taken FROM m GROUP BY source)
SELECT m.doc_id, m.size, m.source_size, m.target,
  m.size * (whole + CASE WHEN extra > 0 AND middle <= CASE WHEN big THEN extra * part / source_size ELSE greatest(0.0, extra - big_taken) END THEN 1 ELSE 0 END)::BIGINT AS taken
FROM m JOIN b ON m.source IS NOT DISTINCT FROM b.source
"""
