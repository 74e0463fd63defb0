"""Interval joins, runs of steps (gaps and islands), presence, overlap and lift-over along paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph, before_row, with_next
from ..plans.loops import checkpointed
from .chunks import joined_runs, renumbered, runs, with_next_value
from .stats import coverage_classes, visits_by_sample

BUCKET = 1024
#: Groups of a node that travel in one row.
GROUPS = 1024


def range_join(ranges: DataFrame, steps: DataFrame, width: int = BUCKET, closed_start: bool = False) -> DataFrame:
    """Pairs of a range (path_id, start, end, ...) and a step (path_id, step_start, step_end, ...) that overlap.

    Both sides are cut into buckets of ``width`` base pairs, so that the join is an equi-join on path and bucket even where a path
    is long; a pair counts in the bucket of the later of both starts only. ``closed_start`` also takes steps that end at the start.
    """
    lo = F.floor(F.col("start") / width)
    first = F.greatest(lo - 1, F.lit(0)) if closed_start else lo
    r = ranges.withColumn("_b", F.explode(F.sequence(first, F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width))))
    s = steps.withColumn("_b", F.explode(F.sequence(F.floor(F.col("step_start") / width), F.floor(F.greatest(F.col("step_end") - 1, F.col("step_start")) / width))))
    j = r.join(s, ["path_id", "_b"]).filter((F.col("step_start") < F.col("end")) & ((F.col("step_end") >= F.col("start")) if closed_start else (F.col("step_end") > F.col("start"))))
    once = F.floor(F.greatest("step_start", "start") / width) == F.col("_b")
    if closed_start:
        once = F.when(F.col("step_end") == F.col("start"), F.floor(F.col("step_start") / width) == F.col("_b")).otherwise(once)
    return j.filter(once).drop("_b")


def clipped(ranges: DataFrame, g: Graph) -> DataFrame:
    """Ranges cut at their path's end; empty ones go."""
    r = ranges.join(g.path_lengths().select("path_id", "path_len"), "path_id").withColumn("end", F.least("end", "path_len"))
    return r.filter("start < end").drop("path_len")


def mean_over_ranges(g: Graph, ranges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """path_id, start, end, mean of a node value by base pair over each range."""
    s = g.positions().join(values.select("node_id", value), "node_id").select("path_id", "step_start", "step_end", value)
    overlap = F.least("end", "step_end") - F.greatest("start", "step_start")
    j = range_join(ranges.select("path_id", "start", "end", "name"), s)
    return j.groupBy("path_id", "start", "end", "name").agg((F.sum(F.col(value) * overlap) / (F.first("end") - F.first("start"))).alias("mean"))


def mean_over_paths(g: Graph, values: DataFrame, value: str) -> DataFrame:
    """path_id, start, end, mean over every whole path with steps."""
    s = g.steps.join(g.lengths(), "node_id").join(values.select("node_id", value), "node_id")
    d = s.groupBy("path_id").agg(F.sum("len").alias("end"), F.sum(F.col(value) * F.col("len")).alias("t"))
    return d.select("path_id", F.lit(0).cast("long").alias("start"), "end", (F.col("t") / F.col("end")).alias("mean"))


def islands(steps: DataFrame, inside: Column, merge: int = 0) -> DataFrame:
    """Maximal runs of steps where ``inside`` holds: path_id, start, end, n_steps; runs less than ``merge`` base pairs apart join.

    steps must be all steps of their paths; chunks of a path meet in one task, not the path.
    """
    found = runs(steps, F.coalesce(inside, F.lit(False))).filter("key").drop("key")
    return joined_runs(found, merge) if merge > 0 else found


def windows(g: Graph, values: DataFrame, value: str, lo: float, hi: float, merge: int = 0, out: bool = False, only_tips: bool = False) -> DataFrame:
    """Runs of steps whose node value lies within (or, with ``out``, outside) the bounds, as BED rows."""
    s = g.positions().join(values.select("node_id", value), "node_id", "left")
    inside = (F.col(value) >= lo) & (F.col(value) <= hi)
    found = islands(s, ~inside if out else inside, merge)
    if only_tips:
        found = found.join(g.path_lengths().select("path_id", "path_len"), "path_id").filter("start = 0 OR end = path_len").drop("path_len")
    return found.select("path_id", "start", "end")


def non_reference_ranges(g: Graph, reference: DataFrame, min_size: int = 0) -> DataFrame:
    """Runs of steps on nodes that no reference path visits."""
    on = g.steps.join(reference.select("path_id"), "path_id", "left_semi").select("node_id").distinct().withColumn("ref", F.lit(True))
    s = g.positions().join(on, "node_id", "left")
    return islands(s, F.col("ref").isNull()).filter(F.col("end") - F.col("start") >= min_size)


def class_ranges(g: Graph, levels: tuple[float, ...] = (1, 3)) -> DataFrame:
    """Runs of steps of equal coverage class: path_id, start, end, class."""
    s = g.positions().join(coverage_classes(g, levels).select("node_id", "class"), "node_id", "left")
    return runs(s, F.col("class")).select("path_id", "start", "end", F.col("key").alias("class"))


def presence(g: Graph, ranges: DataFrame, delimiter: str = "#", fields: int = 1) -> DataFrame:
    """path_id, start, end, name, grp, pav: share of a range's base pairs on nodes that a group of paths visits.

    A node's groups go to its ranges as lists of ``GROUPS`` at most, and are only spread out where a range's nodes have met, so what is
    shuffled grows with the nodes of the ranges, not with those times their groups.
    """
    hit = range_join(ranges, g.positions().select("path_id", "node_id", "len", "step_start", "step_end"))
    key = ["path_id", "start", "end", "name"]
    by_node = hit.repartition(*key).groupBy(*key, "node_id").agg(F.sum("len").alias("len"))
    by_node = checkpointed(by_node.withColumn("t", F.sum("len").over(Window.partitionBy(*key))))
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("sample")) - 1
    lists = visits_by_sample(g, delimiter, fields).select("node_id", "sample", F.floor(nth / GROUPS).alias("_k"))
    lists = checkpointed(lists.groupBy("node_id", "_k").agg(F.collect_list("sample").alias("grps")).drop("_k"))
    met = by_node.join(lists, "node_id").repartition(*key)
    got = met.select(*key, "len", "t", F.explode("grps").alias("grp")).groupBy(*key, "grp").agg(F.sum("len").alias("c"), F.first("t").alias("t"))
    return got.select(*key, "grp", (F.col("c") / F.col("t")).alias("pav"))


def presence_matrix(pav: DataFrame, groups: Sequence[str], least: float | None = None) -> DataFrame:
    """:func:`presence` with a column for each of ``groups``: the share, 0 where a group is absent, or whether it is ``least`` at least (1, 0)."""
    wide = pav.groupBy("path_id", "start", "end", "name").pivot("grp", list(groups)).agg(F.first("pav"))
    share = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(0.0))
    return wide.select("path_id", "start", "end", "name", *[(share(c) if least is None else (share(c) >= least).cast("int")).alias(c) for c in groups])


def touching_paths(g: Graph, ranges: DataFrame) -> DataFrame:
    """path_id, start, end, touched: other paths that take an oriented node of the range."""
    hit = range_join(ranges, g.positions().select("path_id", "node_id", "is_rev", "step_start", "step_end"), closed_start=True).select("path_id", "start", "end", "node_id", "is_rev").distinct()
    other = g.steps.select(F.col("path_id").alias("touched"), "node_id", "is_rev").distinct()
    return hit.join(other, ["node_id", "is_rev"]).filter("touched != path_id").select("path_id", "start", "end", "touched").distinct()


def steps_at(g: Graph, points: DataFrame) -> DataFrame:
    """points (path_id, pos) with the step that holds them: node_id, is_rev, offset within the oriented node."""
    r = points.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1)
    j = range_join(r, g.positions().select("path_id", "step_rank", "node_id", "is_rev", "len", "step_start", "step_end"))
    return j.select("path_id", "pos", "step_rank", "node_id", "is_rev", "len", (F.col("pos") - F.col("step_start")).alias("offset"))


def graph_coordinates(g: Graph, points: DataFrame) -> DataFrame:
    """points (path_id, pos; both counted from 1) with their place in the concatenated nodes, from 1; reverse steps are mirrored."""
    at = steps_at(g, points.select("path_id", (F.col("pos") - 1).alias("pos")))
    at = at.join(g.pan_positions().select("node_id", "pan_start"), "node_id")
    place = F.col("pan_start") + F.when(F.col("is_rev"), F.col("len") - 1 - F.col("offset")).otherwise(F.col("offset"))
    return at.select("path_id", (F.col("pos") + 1).alias("pos"), (place + 1).alias("pan_pos"))


def contained(ranges: DataFrame, g: Graph) -> DataFrame:
    """ranges (base, start, end, name) that lie within a sub-path ``base:start-end``, re-based onto it."""
    base = F.regexp_extract("path_name", r"^(.*):(\d+)-(\d+)$", 1)
    lo = F.regexp_extract("path_name", r"^(.*):(\d+)-(\d+)$", 2)
    hi = F.regexp_extract("path_name", r"^(.*):(\d+)-(\d+)$", 3)
    p = g.paths.select("path_name", base.alias("path_id"), F.when(lo != "", lo.cast("long")).alias("step_start"), F.when(hi != "", hi.cast("long")).alias("step_end")).filter("step_start IS NOT NULL")
    j = range_join(ranges.withColumnRenamed("base", "path_id"), p).filter("start >= step_start AND end <= step_end")
    return j.select("path_name", (F.col("start") - F.col("step_start")).alias("start"), (F.col("end") - F.col("step_start")).alias("end"), "name")


def complement(ranges: DataFrame, g: Graph) -> DataFrame:
    """What the ranges leave of every path with steps: path_id, start, end."""
    r = ranges.select("path_id", "start", "end")
    r = r.union(g.path_lengths().select("path_id", F.col("path_len").alias("start"), F.col("path_len").alias("end")))
    upto = F.coalesce(F.max("end").over(before_row(Window.partitionBy("path_id").orderBy("start", "end"))), F.lit(0))
    return r.withColumn("_from", upto).filter(F.col("_from") < F.col("start")).select("path_id", F.col("_from").alias("start"), F.col("start").alias("end"))


def similarity(g: Graph, delimiter: str = "#", fields: int = 1, distances: bool = False, all_pairs: bool = False) -> DataFrame:
    """Pairs of path groups with shared length and the similarities (or distances) that follow from it."""
    v = visits_by_sample(g, delimiter, fields).join(g.lengths(), "node_id").select("node_id", "sample", "len", (F.col("cnt") * F.col("len")).alias("bp"), "cnt")
    length = v.groupBy("sample").agg(F.sum("bp").alias("length"))
    a, b = v.select("node_id", F.col("sample").alias("group_a"), F.col("bp").alias("x")), v.select("node_id", F.col("sample").alias("group_b"), F.col("bp").alias("y"))
    p = a.join(b, "node_id").groupBy("group_a", "group_b").agg(F.sum(F.least("x", "y")).alias("intersection"))
    la, lb = length.select(F.col("sample").alias("group_a"), F.col("length").alias("group_a_length")), length.select(F.col("sample").alias("group_b"), F.col("length").alias("group_b_length"))
    if all_pairs:
        every = la.crossJoin(lb)
        p = every.join(p, ["group_a", "group_b"], "left").fillna(0, ["intersection"])
    else:
        p = p.join(la, "group_a").join(lb, "group_b")
    inter, x, y = F.col("intersection"), F.col("group_a_length"), F.col("group_b_length")
    jaccard = inter / (x + y - inter)
    cosine, dice = inter / F.sqrt((x * y).cast("double")), 2.0 * inter / (x + y)
    identity = 2.0 * jaccard / (1.0 + jaccard)
    base = ["group_a", "group_b", "group_a_length", "group_b_length", inter.cast("long").alias("intersection")]
    if distances:
        return p.select(*base, (1 - jaccard).alias("jaccard_distance"), (1 - cosine).alias("cosine_distance"), (1 - dice).alias("dice_distance"), (1 - identity).alias("estimated_difference"), (x + y - 2 * inter).cast("double").alias("manhattan_distance"))
    return p.select(*base, jaccard.alias("jaccard"), cosine.alias("cosine"), dice.alias("dice"), identity.alias("estimated_identity"))


def oriented_overlap(g: Graph, delimiter: str = "#", fields: int = 1) -> DataFrame:
    """grp, query, target, overlap, overlap_frac of the paths of a group: shared oriented base pairs over the mean length."""
    from .stats import sample_of

    s = g.steps.join(sample_of(g, delimiter, fields), "path_id").join(g.lengths(), "node_id")
    v = s.groupBy("sample", "path_id", "node_id", "is_rev").agg(F.count("*").alias("c"), F.first("len").alias("len"))
    q = v.select("sample", "node_id", "is_rev", F.col("path_id").alias("query"), F.col("c").alias("cq"), "len")
    t = v.select("sample", "node_id", "is_rev", F.col("path_id").alias("target"), F.col("c").alias("ct"))
    p = q.join(t, ["sample", "node_id", "is_rev"]).filter("query != target").groupBy("sample", "query", "target").agg(F.sum(F.least("cq", "ct") * F.col("len")).alias("overlap"))
    n = g.path_lengths()
    p = p.join(n.select(F.col("path_id").alias("query"), F.col("path_len").alias("lq")), "query").join(n.select(F.col("path_id").alias("target"), F.col("path_len").alias("lt")), "target")
    return p.select(F.col("sample").alias("grp"), "query", "target", "overlap", (F.col("overlap") / ((F.col("lq") + F.col("lt")) / 2.0)).alias("overlap_frac"))


def bins(g: Graph, width: int) -> DataFrame:
    """path_id, bin, bp, mean_cov, mean_inv, mean_pos, first_nucl, last_nucl of the paths over bins of the concatenated nodes.

    Steps are cut at bin borders and sums of positions taken in closed form, so nothing is counted base by base.
    """
    n = g.pan_positions().select("node_id", "pan_start")
    s = g.positions().join(n, "node_id")
    first, last = F.floor(F.col("pan_start") / width), F.floor((F.col("pan_start") + F.col("len") - 1) / width)
    s = s.filter("len > 0").withColumn("bin", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("pan_start"), F.col("bin") * width)
    hi = F.least(F.col("pan_start") + F.col("len"), (F.col("bin") + 1) * width)
    m = hi - lo
    # path position of the first base of the piece, in path order
    at = F.col("step_start") + F.when(F.col("is_rev"), F.col("pan_start") + F.col("len") - hi).otherwise(lo - F.col("pan_start"))
    s = s.select("path_id", "bin", m.alias("m"), at.alias("at"), F.when(F.col("is_rev"), m).otherwise(0).alias("inv"), (lo - F.col("bin") * width).alias("lo"), (hi - F.col("bin") * width).alias("hi"))
    s = s.withColumn("pos_sum", F.col("m") * F.col("at") + F.floor(F.col("m") * (F.col("m") - 1) / 2))
    b = s.groupBy("path_id", "bin").agg(F.sum("m").alias("bp"), F.sum("inv").alias("inv"), F.sum("pos_sum").alias("p"), F.min("lo").alias("first_nucl"), (F.max("hi") - 1).alias("last_nucl"))
    b = b.join(g.path_lengths().select("path_id", "path_len"), "path_id")
    return b.select("path_id", F.col("bin").cast("long").alias("bin"), "bp", (F.col("bp") / width).alias("mean_cov"), (F.col("inv") / F.col("bp")).alias("mean_inv"), (F.col("p") / F.col("bp") / F.col("path_len")).alias("mean_pos"), "first_nucl", "last_nucl")


def _placed(g: Graph) -> DataFrame:
    """Steps with len and pan_start, without those on empty nodes; ranks have no gaps."""
    n = g.pan_positions().select("node_id", "len", "pan_start")
    s = g.steps.join(n, "node_id")
    return s if n.filter("len = 0").isEmpty() else renumbered(s.filter("len > 0"))


def bin_links(g: Graph, width: int) -> DataFrame:
    """path_id, from_bin, to_bin, n: moves between bins more than one apart."""
    enter = F.floor(F.when(F.col("is_rev"), F.col("pan_start") + F.col("len") - 1).otherwise(F.col("pan_start")) / width)
    leave = F.floor(F.when(F.col("is_rev"), F.col("pan_start")).otherwise(F.col("pan_start") + F.col("len") - 1) / width)
    s = with_next(_placed(g).select("path_id", "step_rank", enter.alias("enter"), leave.alias("from_bin")), "enter")
    return s.filter(F.abs(F.col("next_enter") - F.col("from_bin")) > 1).groupBy("path_id", "from_bin", F.col("next_enter").alias("to_bin")).agg(F.count("*").alias("n"))


def bin_jumps(g: Graph, width: int, drop_gaps: bool = False) -> DataFrame:
    """path_id, from_bin, to_bin, n: moves between bins (from 1) more than one apart, from 0 at a path's start and to 0 at its end.

    A node's bases count from its left to its right end on either strand. ``drop_gaps`` leaves out starts, ends, and forward moves
    with no bin of the same path strictly between: what the path jumps over, it never visits. Bins of a path are numbered in order,
    so that "none between" is "the next one", without a join over ranges.
    """
    first, last = (F.floor(F.col("pan_start") / width) + 1).alias("enter"), (F.floor((F.col("pan_start") + F.col("len") - 1) / width) + 1).alias("leave")
    s = _placed(g).select("path_id", "step_rank", first, last)
    outside = F.lit(0).cast("long")
    go = F.struct(F.col("leave").alias("from_bin"), F.coalesce("next_enter", outside).alias("to_bin"))
    begin = F.struct(outside.alias("from_bin"), F.col("enter").alias("to_bin"))
    moves = with_next(s, "enter").select("path_id", F.explode(F.when(F.col("step_rank") == 0, F.array(begin, go)).otherwise(F.array(go))).alias("m")).select("path_id", "m.*")
    j = moves.filter("from_bin = 0 OR to_bin = 0 OR abs(to_bin - from_bin) > 1").groupBy("path_id", "from_bin", "to_bin").agg(F.count("*").alias("n"))
    if not drop_gaps:
        return j
    b = with_next_value(s.select("path_id", F.explode(F.sequence("enter", "leave")).alias("from_bin")).distinct(), "from_bin", "next_bin")
    j = j.filter("from_bin != 0 AND to_bin != 0").join(b, ["path_id", "from_bin"])
    return j.filter("from_bin > to_bin OR next_bin < to_bin").select("path_id", "from_bin", "to_bin", "n")


def bin_coverage(g: Graph, width: int) -> DataFrame:
    """bin (from 1), bp, mean_depth: base pairs of all paths over each bin of the concatenated nodes, all paths in one row."""
    d = g.steps.groupBy("node_id").agg(F.count("*").alias("n"))
    s = g.pan_positions().select("node_id", "len", "pan_start").filter("len > 0").join(d, "node_id")
    s = s.withColumn("b", F.explode(F.sequence(F.floor(F.col("pan_start") / width), F.floor((F.col("pan_start") + F.col("len") - 1) / width))))
    part = F.least(F.col("pan_start") + F.col("len"), (F.col("b") + 1) * width) - F.greatest(F.col("pan_start"), F.col("b") * width)
    return s.groupBy((F.col("b") + 1).alias("bin")).agg(F.sum(part * F.col("n")).alias("bp")).select("bin", "bp", (F.col("bp") / width).alias("mean_depth"))


def self_dotplot(g: Graph) -> DataFrame:
    """path_id, from_pos, to_pos: pairs of visits of one node by one path."""
    s = g.positions().select("path_id", "node_id", "step_rank", "step_start")
    a = s.select("path_id", "node_id", F.col("step_rank").alias("ra"), F.col("step_start").alias("from_pos"))
    b = s.select("path_id", "node_id", F.col("step_rank").alias("rb"), F.col("step_start").alias("to_pos"))
    return a.join(b, ["path_id", "node_id"]).filter("ra < rb").select("path_id", "from_pos", "to_pos")


def annotations(g: Graph, ranges: DataFrame) -> DataFrame:
    """node_id, annotation (sorted names joined by ;), colour, of nodes under named ranges."""
    from ..functions.dna import colour

    hit = range_join(ranges, g.positions().select("path_id", "node_id", "step_start", "step_end"))
    names = hit.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("annotation"))
    return names.withColumn("colour", colour(F.col("annotation")))
