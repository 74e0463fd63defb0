"""Lifting many positions to reference paths at once: a search over oriented nodes for all starts together, then the step by context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.loops import checkpointed
from .intervals import range_join, steps_at

_KEY = ("start_node", "start_rev")


def _moves(g: Graph, both_ways: bool) -> DataFrame:
    """src, src_rev, dst, dst_rev: to the right of an oriented node, or to either side of it, which keeps its orientation."""
    right = g.adjacency()
    if not both_ways:
        return right
    left = right.select("src", (~F.col("src_rev")).alias("src_rev"), "dst", (~F.col("dst_rev")).alias("dst_rev"))
    return right.union(left).distinct()


def _searched(g: Graph, starts: DataFrame, goal: DataFrame, radius: int, both_ways: bool) -> DataFrame:
    """start_node, start_rev, hit (dist, hops, node, rev): the nearest oriented node of ``goal`` (node_id), by base pairs before it, then hops, then id.

    One table holds, for each start and oriented node, the smallest distance so far, and whether it is fresh. What is fresh and can still
    come before the start's hit is followed; a round is one join with the moves and one grouping.
    """
    goal = goal.select(F.col("node_id").alias("dst"), F.lit(True).alias("goal"))
    moves = _moves(g, both_ways).join(g.lengths().withColumnRenamed("node_id", "src"), "src").join(goal, "dst", "left")
    moves = checkpointed(moves.select(F.col("src").alias("node"), F.col("src_rev").alias("rev"), "dst", "dst_rev", "len", F.coalesce("goal", F.lit(False)).alias("dst_goal")))
    zero = F.lit(0).cast("long")
    key = [*_KEY, "node", "rev"]
    first = starts.join(goal.withColumnRenamed("dst", "start_node"), "start_node", "left")
    state = checkpointed(
        first.select(*_KEY, F.col("start_node").alias("node"), F.col("start_rev").alias("rev"), F.struct(zero.alias("dist"), zero.alias("hops")).alias("far"), F.lit(True).alias("fresh"), F.coalesce("goal", F.lit(False)).alias("goal"))
    )
    place = F.struct(F.col("far.dist").alias("dist"), F.col("far.hops").alias("hops"), "node", "rev")
    while True:
        hits = state.filter("goal").groupBy(*_KEY).agg(F.min(place).alias("hit"))
        out = state.filter("fresh").join(hits, list(_KEY), "left").join(moves, ["node", "rev"])
        out = out.withColumn("to", F.struct((F.col("far.dist") + F.col("len")).alias("dist"), (F.col("far.hops") + 1).alias("hops"))).filter(F.col("to.dist") < radius)
        out = out.filter(F.col("hit").isNull() | (F.col("to") <= F.struct(F.col("hit.dist").alias("dist"), F.col("hit.hops").alias("hops"))))
        step = out.select(*_KEY, F.col("dst").alias("node"), F.col("dst_rev").alias("rev"), F.col("to").alias("far"), F.lit(True).alias("fresh"), F.col("dst_goal").alias("goal"))
        # of equal distances the one that is not fresh is smaller
        both = state.withColumn("fresh", F.lit(False)).unionByName(step).groupBy(*key).agg(F.min(F.struct("far", "fresh")).alias("m"), F.max("goal").alias("goal"))
        state = checkpointed(both.select(*key, "m.far", "m.fresh", "goal"))
        if state.filter("fresh").isEmpty():
            return state.filter("goal").groupBy(*_KEY).agg(F.min(place).alias("hit"))


def nearest_steps(g: Graph, starts: DataFrame, reference: DataFrame, radius: int = 10_000) -> DataFrame:
    """start_node, start_rev, hit, both_ways of starts that meet a reference path (path_id): first looking one way, then, for those without a hit, both ways."""
    on = checkpointed(g.steps.join(reference.select("path_id"), "path_id", "left_semi").select("node_id").distinct())
    starts = checkpointed(starts.select(*_KEY).distinct())
    ahead = checkpointed(_searched(g, starts, on, radius, False))
    rest = checkpointed(starts.join(ahead, list(_KEY), "left_anti"))
    ahead = ahead.withColumn("both_ways", F.lit(False))
    return ahead if rest.isEmpty() else ahead.union(_searched(g, rest, on, radius, True).withColumn("both_ways", F.lit(True)))


def by_context(g: Graph, pairs: DataFrame, walk: int) -> DataFrame:
    """pairs (point, q_path, q_rank, t_path, t_rank) with the one of each point's target steps whose context is most like the query step's.

    A context is the nodes met on a walk to either side. The walks' lengths are what every step of the point can walk: the
    smallest of their shorter sides and of their longer sides, ``walk`` at most, either way round; the better of the four comparisons
    counts. Of equally good steps the middle one by rank is taken.
    """
    pairs = checkpointed(pairs)
    ends = pairs.select("point", F.explode(F.array(F.struct(F.lit(False).alias("target"), F.col("q_path").alias("path_id"), F.col("q_rank").alias("step_rank")), F.struct(F.lit(True).alias("target"), F.col("t_path").alias("path_id"), F.col("t_rank").alias("step_rank")))).alias("e")).select("point", "e.*").distinct()
    # what is read several times is written once
    p = checkpointed(g.positions().select("path_id", "step_rank", "node_id", "len", "step_start", "step_end"))
    s = ends.join(p, ["path_id", "step_rank"]).join(g.path_lengths().select("path_id", "path_len"), "path_id")
    left, right = F.col("step_start"), F.col("path_len") - F.col("step_end")
    s = checkpointed(s)
    sides = s.groupBy("point").agg(F.min(F.least(left, right, F.lit(walk))).alias("short"), F.min(F.least(F.greatest(left, right), F.lit(walk))).alias("long"))
    s = s.join(sides, "point").withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    before, after = (F.when(F.col("way") == k, F.col("short")).otherwise(F.col("long")) for k in (0, 1))
    s = s.withColumn("before", before).withColumn("after", after)
    who = ["point", "target", "path_id", "step_rank", "way"]
    r = s.select(*who, F.col("step_start").alias("own_start"), F.col("step_end").alias("own_end"), "before", "after", F.greatest(F.col("step_start") - F.col("before"), F.lit(0)).alias("start"), (F.col("step_end") + F.col("after")).alias("end"))
    met = checkpointed(range_join(r, p.select("path_id", F.col("step_rank").alias("other"), "node_id", "len", "step_start", "step_end")))
    walked = F.sum(F.when(F.col("other") != F.col("step_rank"), F.col("len")).otherwise(0))
    whole = met.groupBy(*who, "before", "after").agg(walked.alias("walked")).filter(F.col("walked") >= F.col("before") + F.col("after")).select(*who)
    c = checkpointed(met.groupBy(*who, "node_id").agg(F.count("*").alias("n"), F.first("len").alias("len")).join(whole, who))
    total = c.groupBy(*who).agg(F.sum(F.col("n") * F.col("len")).alias("all"))
    q = c.filter("NOT target").select("point", F.col("way").alias("q_way"), "node_id", F.col("n").alias("nq"), "len")
    t = c.filter("target").select("point", F.col("path_id").alias("t_path"), F.col("step_rank").alias("t_rank"), F.col("way").alias("t_way"), "node_id", F.col("n").alias("nt"))
    ways = ["point", "t_path", "t_rank", "q_way", "t_way"]
    j = q.join(t, ["point", "node_id"]).groupBy(*ways).agg(F.sum(F.least("nq", "nt") * F.col("len")).alias("i"))
    j = j.join(total.filter("NOT target").select("point", F.col("way").alias("q_way"), F.col("all").alias("a")), ["point", "q_way"])
    j = j.join(total.filter("target").select("point", F.col("path_id").alias("t_path"), F.col("step_rank").alias("t_rank"), F.col("way").alias("t_way"), F.col("all").alias("b")), ["point", "t_path", "t_rank", "t_way"])
    best = j.groupBy("point", "t_path", "t_rank").agg(F.max(F.col("i") / (F.col("a") + F.col("b") - F.col("i"))).alias("jaccard"))
    scored = checkpointed(pairs.select("point", "t_path", "t_rank").distinct().join(best, ["point", "t_path", "t_rank"], "left").fillna(0.0, ["jaccard"]))
    top = scored.join(scored.groupBy("point").agg(F.max("jaccard").alias("most")), "point").filter("jaccard = most")
    w = Window.partitionBy("point").orderBy("t_path", "t_rank")
    top = top.withColumn("no", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("point")))
    return top.filter(F.col("no") == F.floor(F.col("n") / 2) + 1).select("point", "t_path", "t_rank", "jaccard")


def _strand(c: Column) -> Column:
    return F.when(c, "-").otherwise("+")


def lifted(g: Graph, points: DataFrame, reference: DataFrame, radius: int = 10_000, walk: int | None = None) -> DataFrame:
    """points (point, node_id, offset, is_rev; with ``walk`` also path_id, step_rank) on reference paths: point, ref_path, ref_pos, dist, strand.

    From the other side of its node each point looks for the nearest node of a reference path. Of the reference's steps there
    the first is taken; with ``walk``, of that path's steps the one whose context is most like the point's own (:func:`by_context`).
    Where the search ends at the start, the offset counts on; elsewhere the place is the end of the node that faces the point.
    """
    points = checkpointed(points)
    near = nearest_steps(g, points.select(F.col("node_id").alias("start_node"), (~F.col("is_rev")).alias("start_rev")), reference, radius)
    at = points.withColumn("start_node", F.col("node_id")).withColumn("start_rev", ~F.col("is_rev")).join(near, list(_KEY))
    ref = checkpointed(g.positions().join(reference.select("path_id"), "path_id", "left_semi").select(F.col("path_id").alias("t_path"), F.col("step_rank").alias("t_rank"), F.col("node_id").alias("node"), F.col("is_rev").alias("t_rev"), "step_start", "len"))
    first = ref.groupBy("node").agg(F.min(F.struct("t_path", "t_rank")).alias("s")).select("node", "s.t_path", "s.t_rank")
    at = at.withColumn("node", F.col("hit.node")).join(first, "node")
    if walk is not None:
        steps = at.drop("t_rank").join(ref.select("node", "t_path", "t_rank"), ["node", "t_path"])
        chosen = by_context(g, steps.select("point", F.col("path_id").alias("q_path"), F.col("step_rank").alias("q_rank"), "t_path", "t_rank"), walk)
        at = at.drop("t_rank").join(chosen.select("point", "t_path", "t_rank"), ["point", "t_path"])
    at = at.join(ref.drop("node"), ["t_path", "t_rank"])
    turned = F.col("t_rev") == F.col("hit.rev")
    here = (F.col("hit.hops") == 0) | (F.col("both_ways") & (F.col("hit.hops") == F.col("len")))
    add = F.when(here, F.when(turned, F.col("len") - F.col("offset")).otherwise(F.col("offset"))).otherwise(F.when(turned, F.lit(0)).otherwise(F.col("len")))
    return at.select("point", F.col("t_path").alias("ref_path"), (F.col("step_start") + add).alias("ref_pos"), F.col("hit.dist").alias("dist"), _strand(turned).alias("strand"))


def path_points(g: Graph, points: DataFrame) -> DataFrame:
    """points (point, path_id, pos) as :func:`lifted` takes them."""
    at = steps_at(g, points.select("path_id", "pos").distinct())
    return points.join(at, ["path_id", "pos"]).select("point", "path_id", "step_rank", "node_id", "is_rev", "offset")


def immediate(g: Graph, points: DataFrame, reference: DataFrame) -> DataFrame:
    """points (point, node_id, offset, is_rev) at every step of a reference path on their own node: point, ref_path, ref_pos, strand."""
    ref = g.positions().join(reference.select("path_id"), "path_id", "left_semi").select(F.col("path_id").alias("ref_path"), "node_id", F.col("is_rev").alias("t_rev"), "step_start", "len")
    turned = F.col("t_rev") != F.col("is_rev")
    place = F.col("step_start") + F.when(turned, F.col("len") - F.col("offset")).otherwise(F.col("offset"))
    return points.join(ref, "node_id").select("point", "ref_path", place.alias("ref_pos"), _strand(turned).alias("strand"))


def lifted_ranges(g: Graph, ranges: DataFrame, reference: DataFrame, radius: int = 10_000, walk: int = 10_000, each: bool = False) -> DataFrame:
    """ranges (path_id, start, end, name, is_rev) with both ends lifted: name, path_id, start, end, ref_start_path, ref_start, ref_end_path, ref_end, strand.

    With ``each``, onto every reference path by itself, a row for each that both ends meet.
    """
    if each:
        out = None
        for r in reference.select("path_id").toLocalIterator():
            one = lifted_ranges(g, ranges, reference.filter(F.col("path_id") == r.path_id), radius, walk)
            out = one if out is None else out.union(one)
        return out if out is not None else lifted_ranges(g, ranges, reference, radius, walk)
    r = checkpointed(ranges.select("path_id", "start", "end", "name", "is_rev").withColumn("row", F.xxhash64("path_id", "start", "end", "name")))
    ends = r.select(F.explode(F.array(F.struct((F.col("row")).alias("row"), F.lit("a").alias("end_"), "path_id", F.col("start").alias("pos")), F.struct("row", F.lit("b").alias("end_"), "path_id", F.col("end").alias("pos")))).alias("e")).select("e.*").distinct()
    p = path_points(g, ends.select(F.concat_ws("|", F.col("row").cast("string"), "end_").alias("point"), "path_id", "pos"))
    at = lifted(g, p, reference, radius, walk).withColumn("row", F.substring_index("point", "|", 1).cast("long")).withColumn("end_", F.substring_index("point", "|", -1))
    a = at.filter("end_ = 'a'").select("row", F.col("ref_path").alias("ref_start_path"), F.col("ref_pos").alias("ref_start"), F.col("strand").alias("s"))
    b = at.filter("end_ = 'b'").select("row", F.col("ref_path").alias("ref_end_path"), F.col("ref_pos").alias("ref_end"))
    out = r.join(a, "row").join(b, "row")
    return out.select("name", "path_id", "start", "end", "ref_start_path", "ref_start", "ref_end_path", "ref_end", _strand((F.col("s") == "-") != F.col("is_rev")).alias("strand"))
