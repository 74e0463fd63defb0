"""Filters and rewrites that give a new graph: prune, keep and drop, chop, unchop, crush, flip, squeeze, cut, normalise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph, canonical, edges_of_steps
from ..plans.loops import checkpointed
from .chunks import prefix_sum, renumbered
from .stats import degree_table, depth_table

EDGE = ["from_id", "from_rev", "to_id", "to_rev"]


def reranked(steps: DataFrame) -> DataFrame:
    """Step ranks without gaps, in the order they had."""
    return renumbered(steps.select("path_id", "step_rank", "node_id", "is_rev")).select("path_id", "step_rank", "node_id", "is_rev")


def keep_paths(g: Graph, names: DataFrame) -> Graph:
    p = g.paths.join(names.select(F.col("name").alias("path_name")), "path_name", "left_semi").select(g.paths.columns)
    return g.with_(paths=p, steps=g.steps.join(p.select("path_id"), "path_id", "left_semi"))


def drop_paths(g: Graph, names: DataFrame) -> Graph:
    p = g.paths.join(names.select(F.col("name").alias("path_name")), "path_name", "left_anti").select(g.paths.columns)
    return g.with_(paths=p, steps=g.steps.join(p.select("path_id"), "path_id", "left_semi"))


def drop_empty_paths(g: Graph) -> Graph:
    return g.with_(paths=g.paths.join(g.steps.select("path_id").distinct(), "path_id", "left_semi"))


def drop_all_paths(g: Graph) -> Graph:
    return g.with_(paths=g.paths.limit(0), steps=g.steps.limit(0))


def without_nodes(g: Graph, gone: DataFrame, protected: DataFrame | None = None) -> Graph:
    """The graph less ``gone`` (node_id) and not ``protected``: their edges go, and steps on them are spliced out."""
    gone = gone.select("node_id").distinct()
    if protected is not None:
        gone = gone.join(protected.select("node_id"), "node_id", "left_anti")
    e = g.edges
    for end in ("from_id", "to_id"):
        e = e.join(gone.select(F.col("node_id").alias(end)), end, "left_anti")
    return g.with_(nodes=g.nodes.join(gone, "node_id", "left_anti"), edges=e.select(EDGE), steps=reranked(g.steps.join(gone, "node_id", "left_anti")))


def split_paths(g: Graph, steps: DataFrame) -> Graph:
    """``g`` with the paths cut into maximal runs of ``steps`` (a subset of its own), named ``path:start-end`` where cut."""
    at = g.positions().select("path_id", "step_rank", "step_start", "step_end")
    s = steps.join(at, ["path_id", "step_rank"])
    # consecutive ranks less their number are equal within a run
    s = prefix_sum(s, F.lit(1).cast("long"), "run").withColumn("run", F.col("step_rank") - F.col("run"))
    span = s.groupBy("path_id", "run").agg(F.min("step_start").alias("a"), F.max("step_end").alias("b"), F.min("step_rank").alias("lo"))
    whole = g.path_lengths().select("path_id", "path_len")
    named = span.join(whole, "path_id").join(g.paths, "path_id")
    named = named.withColumn("name", F.when((F.col("a") == 0) & (F.col("b") == F.col("path_len")), F.col("path_name")).otherwise(F.format_string("%s:%d-%d", "path_name", "a", "b")))
    named = named.withColumn("new_id", F.row_number().over(Window.orderBy("path_id", "a")).cast("long"))
    out = s.join(named.select("path_id", "run", "new_id", "lo"), ["path_id", "run"])
    ranks = F.col("step_rank") - F.col("lo")
    return g.with_(
        paths=named.select(F.col("new_id").alias("path_id"), F.col("name").alias("path_name"), F.lit(False).alias("is_circular")),
        steps=out.select(F.col("new_id").alias("path_id"), ranks.cast("long").alias("step_rank"), "node_id", "is_rev"),
    )


def prune_high_degree(g: Graph, most: int) -> Graph:
    return without_nodes(drop_all_paths(g), degree_table(g).filter(F.col("degree") > most))


def prune_by_depth(g: Graph, lo: int, hi: int | None = None) -> Graph:
    d = F.col("depth")
    return without_nodes(g, depth_table(g).filter((d < lo) | (F.lit(False) if hi is None else d > hi)))


def traversals(g: Graph) -> DataFrame:
    """Canonical edges with the number of consecutive step pairs over them."""
    t = g.transitions().select(canonical(F.col("src"), F.col("src_rev"), F.col("dst"), F.col("dst_rev")).alias("e"))
    return t.groupBy("e").agg(F.count("*").alias("n")).select("e.*", "n")


def prune_edges_by_depth(g: Graph, lo: int, hi: int) -> Graph:
    """Removes edges with at least one traversal whose number of them is out of bounds."""
    bad = traversals(g).filter((F.col("n") < lo) | (F.col("n") > hi))
    return g.with_(edges=g.edges.join(bad, EDGE, "left_anti"))


def best_edges(g: Graph, best: int) -> Graph:
    """Keeps, of every oriented node, the ``best`` most traversed edges; an edge stays if either end keeps it. Ties go by target."""
    n = g.edges.join(traversals(g), EDGE, "left").select(*EDGE, F.coalesce("n", F.lit(0)).alias("n"))
    there = n.select(*EDGE, "n", F.col("from_id").alias("s"), F.col("from_rev").alias("sr"), F.col("to_id").alias("t"), F.col("to_rev").alias("tr"))
    back = n.select(*EDGE, "n", F.col("to_id").alias("s"), (~F.col("to_rev")).alias("sr"), F.col("from_id").alias("t"), (~F.col("from_rev")).alias("tr"))
    w = Window.partitionBy("s", "sr").orderBy(F.col("n").desc(), "t", "tr")
    kept = there.union(back).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= best).select(EDGE).distinct()
    return g.with_(edges=kept)


def tips(g: Graph) -> DataFrame:
    """node_id of nodes without edges on a side."""
    return degree_table(g).filter("degree_in = 0 OR degree_out = 0").select("node_id")


def cut_tips(g: Graph, below_depth: int | None = None) -> Graph:
    gone = tips(g)
    if below_depth is not None:
        gone = gone.join(depth_table(g).filter(F.col("depth") < below_depth), "node_id", "left_semi")
    return without_nodes(g, gone)


def isolated(g: Graph) -> DataFrame:
    """node_id of nodes without edges under exactly one step, of a path of one step."""
    alone = degree_table(g).filter("degree = 0").select("node_id")
    longer = g.steps.groupBy("path_id").agg(F.count("*").alias("n")).filter("n > 1").select("path_id", F.lit(True).alias("longer"))
    s = g.steps.join(longer, "path_id", "left").groupBy("node_id").agg(F.count("*").alias("k"), F.max("longer").alias("longer")).filter("k = 1 AND longer IS NULL")
    return alone.join(s, "node_id", "left_semi")


def remove_isolated(g: Graph) -> Graph:
    return without_nodes(g, isolated(g))


def chop(g: Graph, most: int) -> Graph:
    """Nodes of more than ``most`` base pairs cut into pieces; new ids are the new ranks, steps and edges follow."""
    from ..model import running_total

    n = g.nodes.withColumn("k", F.greatest(F.ceil(F.col("len") / most), F.lit(1)).cast("long"))
    n = running_total(n, "node_rank", "k", "base")
    piece = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    seq = F.substring(F.col("seq"), (F.col("i") * most + 1).cast("int"), F.lit(most))
    new = F.col("base") + F.col("i") + 1
    nodes = piece.select(new.alias("node_id"), seq.alias("seq"), F.length(seq).cast("long").alias("len"), new.alias("node_rank"))
    inner = piece.filter(F.col("i") < F.col("k") - 1).select(new.alias("from_id"), F.lit(False).alias("from_rev"), (new + 1).alias("to_id"), F.lit(False).alias("to_rev"))
    m = n.select("node_id", "base", "k")
    e = g.edges.join(m.select(F.col("node_id").alias("from_id"), F.col("base").alias("fb"), F.col("k").alias("fk")), "from_id").join(m.select(F.col("node_id").alias("to_id"), F.col("base").alias("tb"), F.col("k").alias("tk")), "to_id")
    # an edge leaves the last piece in its direction and enters the first
    outer = e.select(
        F.when(F.col("from_rev"), F.col("fb") + 1).otherwise(F.col("fb") + F.col("fk")).alias("from_id"), "from_rev", F.when(F.col("to_rev"), F.col("tb") + F.col("tk")).otherwise(F.col("tb") + 1).alias("to_id"), "to_rev"
    )
    c = outer.union(inner).select(canonical(*[F.col(x) for x in EDGE]).alias("e")).select("e.*").distinct()
    s = prefix_sum(g.steps.join(m, "node_id"), F.col("k"), "first").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    s = s.select("path_id", (F.col("first") + F.col("i")).alias("step_rank"), F.when(F.col("is_rev"), F.col("base") + F.col("k") - F.col("i")).otherwise(F.col("base") + F.col("i") + 1).alias("node_id"), "is_rev")
    return Graph(nodes, c, g.paths, s)


def crush(g: Graph) -> Graph:
    """Runs of N become one N."""
    seq = F.regexp_replace("seq", "N+", "N")
    return g.with_(nodes=g.nodes.select("node_id", seq.alias("seq"), F.length(seq).cast("long").alias("len"), "node_rank"))


def flip_paths(g: Graph, suffix: str = "_inv") -> Graph:
    """Paths with more base pairs in reverse than forward are reverse-complemented and renamed; edges they need are added."""
    s = g.steps.join(g.lengths(), "node_id")
    rev = s.groupBy("path_id").agg(F.sum(F.when(F.col("is_rev"), F.col("len")).otherwise(-F.col("len"))).alias("d")).filter("d > 0").select("path_id").withColumn("flip", F.lit(True))
    last = g.steps.join(rev, "path_id").groupBy("path_id").agg(F.max("step_rank").alias("last"))
    marked = g.steps.join(rev.join(last, "path_id"), "path_id", "left")
    flip = F.coalesce("flip", F.lit(False))
    steps = marked.select("path_id", F.when(flip, F.col("last") - F.col("step_rank")).otherwise(F.col("step_rank")).alias("step_rank"), "node_id", F.when(flip, ~F.col("is_rev")).otherwise(F.col("is_rev")).alias("is_rev"))
    paths = g.paths.join(rev, "path_id", "left").select("path_id", F.when(flip, F.concat("path_name", F.lit(suffix))).otherwise(F.col("path_name")).alias("path_name"), "is_circular")
    edges = g.edges.select(EDGE).union(edges_of_steps(steps).select(EDGE)).distinct()
    return Graph(g.nodes, edges, paths, steps)


def squeeze(graphs: Sequence[Graph], name_with_rank: bool = False) -> Graph:
    """One graph of many: ids of each are shifted beyond those before it."""
    out: Graph | None = None
    node_base = path_base = rank_base = 0
    for k, g in enumerate(graphs):
        n = g.nodes.withColumn("node_id", F.col("node_id") + node_base).withColumn("node_rank", F.col("node_rank") + rank_base)
        e = g.edges.withColumn("from_id", F.col("from_id") + node_base).withColumn("to_id", F.col("to_id") + node_base)
        p = g.paths.withColumn("path_id", F.col("path_id") + path_base)
        if name_with_rank:
            p = p.withColumn("path_name", F.concat("path_name", F.lit(f"#{k}")))
        s = g.steps.withColumn("node_id", F.col("node_id") + node_base).withColumn("path_id", F.col("path_id") + path_base)
        part = Graph(n, e, p, s)
        out = part if out is None else Graph(*[getattr(out, x).unionByName(getattr(part, x)) for x in ("nodes", "edges", "paths", "steps")])
        if k < len(graphs) - 1:
            top = g.nodes.agg(F.max("node_id"), F.max("node_rank")).first()
            node_base, rank_base = node_base + (top[0] or 0), rank_base + (top[1] or 0)
            path_base += g.paths.agg(F.max("path_id")).first()[0] or 0
    if out is None:
        raise ValueError("no graphs")
    return out


def induced(g: Graph, keep: DataFrame) -> Graph:
    """The subgraph of ``keep`` (node_id): edges with both ends in it and maximal runs of steps as paths."""
    keep = keep.select("node_id").distinct()
    e = g.edges
    for end in ("from_id", "to_id"):
        e = e.join(keep.select(F.col("node_id").alias(end)), end, "left_semi")
    sub = split_paths(g, g.steps.join(keep, "node_id", "left_semi").select(g.steps.columns))
    return sub.with_(nodes=g.nodes.join(keep, "node_id", "left_semi"), edges=e.select(EDGE))


def lace(g: Graph) -> Graph:
    """Adds the edges that consecutive steps lack."""
    return g.with_(edges=g.edges.select(EDGE).union(edges_of_steps(g.steps).select(EDGE)).distinct())


def inject(g: Graph, intervals: DataFrame) -> Graph:
    """intervals (path_id, start, end, name) become paths; nodes are cut where intervals begin or end."""
    # each table is written before the next is made from it, so that no plan shuffles for all of them
    g = g.with_(steps=checkpointed(g.steps))
    intervals = checkpointed(intervals.select("path_id", "start", "end", "name"))
    at = g.positions()
    ends = intervals.select("path_id", F.explode(F.array("start", "end")).alias("pos"))
    from .intervals import range_join

    hit = range_join(ends.distinct().select("path_id", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")), at.select("path_id", "node_id", "is_rev", "len", "step_start", "step_end"))
    cut = F.when(F.col("is_rev"), F.col("step_end") - F.col("start")).otherwise(F.col("start") - F.col("step_start"))
    cuts = hit.select("node_id", cut.alias("cut"), "len").filter("cut > 0 AND cut < len").groupBy("node_id").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    h = chop_at(g, checkpointed(cuts))
    h = h.with_(nodes=checkpointed(h.nodes), steps=checkpointed(h.steps))
    pos = h.positions().select("path_id", "step_rank", "node_id", "is_rev", "step_start", "step_end")
    s = range_join(intervals, pos)
    top = g.paths.agg(F.coalesce(F.max("path_id"), F.lit(0))).first()[0]
    names = checkpointed(intervals.withColumn("new_id", (F.row_number().over(Window.orderBy("path_id", "start", "end", "name")) + top).cast("long")))
    s = s.join(names, ["path_id", "start", "end", "name"])
    rank = F.row_number().over(Window.partitionBy("new_id").orderBy("step_rank")) - 1
    new_steps = checkpointed(s.select(F.col("new_id").alias("path_id"), rank.cast("long").alias("step_rank"), "node_id", "is_rev"))
    new_paths = names.select(F.col("new_id").alias("path_id"), F.col("name").alias("path_name"), F.lit(False).alias("is_circular"))
    return h.with_(paths=h.paths.union(new_paths), steps=h.steps.union(new_steps))


def chop_at(g: Graph, cuts: DataFrame) -> Graph:
    """Nodes cut at the offsets of ``cuts`` (node_id, cuts: sorted array); ids as in :func:`chop`."""
    from ..model import running_total

    n = g.nodes.join(cuts, "node_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    n = n.withColumn("borders", F.concat(F.array(F.lit(0).cast("long")), "cuts", F.array("len"))).withColumn("k", (F.size("borders") - 1).cast("long"))
    n = running_total(n, "node_rank", "k", "base")
    piece = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    lo, hi = F.get("borders", F.col("i")), F.get("borders", F.col("i") + 1)
    new = F.col("base") + F.col("i") + 1
    nodes = piece.select(new.alias("node_id"), F.substring(F.col("seq"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("seq"), (hi - lo).alias("len"), new.alias("node_rank"))
    inner = piece.filter(F.col("i") < F.col("k") - 1).select(new.alias("from_id"), F.lit(False).alias("from_rev"), (new + 1).alias("to_id"), F.lit(False).alias("to_rev"))
    m = n.select("node_id", "base", "k")
    e = g.edges.join(m.select(F.col("node_id").alias("from_id"), F.col("base").alias("fb"), F.col("k").alias("fk")), "from_id").join(m.select(F.col("node_id").alias("to_id"), F.col("base").alias("tb"), F.col("k").alias("tk")), "to_id")
    outer = e.select(F.when(F.col("from_rev"), F.col("fb") + 1).otherwise(F.col("fb") + F.col("fk")).alias("from_id"), "from_rev", F.when(F.col("to_rev"), F.col("tb") + F.col("tk")).otherwise(F.col("tb") + 1).alias("to_id"), "to_rev")
    c = outer.union(inner).select(canonical(*[F.col(x) for x in EDGE]).alias("e")).select("e.*").distinct()
    s = prefix_sum(g.steps.join(m, "node_id"), F.col("k"), "first").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    s = s.select("path_id", (F.col("first") + F.col("i")).alias("step_rank"), F.when(F.col("is_rev"), F.col("base") + F.col("k") - F.col("i")).otherwise(F.col("base") + F.col("i") + 1).alias("node_id"), "is_rev")
    return Graph(nodes, c, g.paths, s)


def sort_paths(g: Graph, by: str = "min", delimiter: str | None = None, reverse: bool = False) -> DataFrame:
    """path_id, new_rank: paths by their smallest, largest or mean node id, bins of one name prefix together."""
    agg = {"min": F.min("node_id").cast("double"), "max": F.max("node_id").cast("double"), "avg": F.avg("node_id")}[by]
    p = g.paths.join(g.steps.groupBy("path_id").agg(agg.alias("k")), "path_id", "left")
    group: Column = F.lit(0)
    if delimiter is not None:
        p = p.withColumn("prefix", F.substring_index("path_name", delimiter, 1))
        group = F.min("path_id").over(Window.partitionBy("prefix"))
    p = p.withColumn("g", group)
    k = F.col("k").desc_nulls_last() if reverse else F.col("k").asc_nulls_last()
    return p.select("path_id", F.row_number().over(Window.orderBy("g", k, "path_id")).cast("long").alias("new_rank"))


def id_ranges(nodes: DataFrame) -> DataFrame:
    """first_id, last_id of runs of consecutive node ids."""
    from ..model import running_total

    n = running_total(nodes.select("node_id").distinct().withColumn("one", F.lit(1).cast("long")), "node_id", "one", "r")
    return n.groupBy((F.col("node_id") - F.col("r")).alias("g")).agg(F.min("node_id").alias("first_id"), F.max("node_id").alias("last_id")).select("first_id", "last_id")
