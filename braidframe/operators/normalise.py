"""Normalisation by sibling merging, strand operators, extraction, breadth-first order, plane layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from ..model import Graph, before_row, canonical, edges_of_steps, running_total
from ..plans.loops import checkpointed, dropped
from .chunks import runs
from .intervals import range_join
from .rewrite import EDGE, chop_at, induced, lace
from .traverse import components, cycle_edges, forward_edges, peel, reach, unchop


def turned(g: Graph) -> Graph:
    """The same graph with every node the other way round; path sequences stay."""
    e = g.edges.select(canonical(F.col("from_id"), ~F.col("from_rev"), F.col("to_id"), ~F.col("to_rev")).alias("e")).select("e.*")
    return Graph(g.nodes.withColumn("seq", reverse_complement(F.col("seq"))), e, g.paths, g.steps.withColumn("is_rev", ~F.col("is_rev")))


def split_strands(g: Graph) -> Graph:
    """One forward node for each strand of each node, 2 id for the forward and 2 id + 1 for the reverse one; edges never change strand."""
    n = g.nodes.select((F.col("node_id") * 2).alias("node_id"), "seq", "len", (F.col("node_rank") * 2 - 1).alias("node_rank"))
    r = g.nodes.select((F.col("node_id") * 2 + 1).alias("node_id"), reverse_complement(F.col("seq")).alias("seq"), "len", (F.col("node_rank") * 2).alias("node_rank"))
    a = g.adjacency()
    no = F.lit(False)
    e = a.select((F.col("src") * 2 + F.col("src_rev").cast("long")).alias("from_id"), no.alias("from_rev"), (F.col("dst") * 2 + F.col("dst_rev").cast("long")).alias("to_id"), no.alias("to_rev"))
    e = e.select(canonical(*[F.col(c) for c in EDGE]).alias("e")).select("e.*").distinct()
    s = g.steps.select("path_id", "step_rank", (F.col("node_id") * 2 + F.col("is_rev").cast("long")).alias("node_id"), no.alias("is_rev"))
    return Graph(n.union(r), e, g.paths, s)


def sibling_prefixes(g: Graph) -> DataFrame:
    """node_id, grp, n: nodes that follow exactly the same oriented nodes and begin alike, their group and its common prefix length."""
    a = g.adjacency().filter("NOT dst_rev")
    parents = a.groupBy(F.col("dst").alias("node_id")).agg(F.array_sort(F.collect_set(F.struct("src", "src_rev"))).alias("parents"))
    n = g.nodes.filter("len > 0").join(parents, "node_id").withColumn("first", F.substring("seq", 1, 1))
    w = Window.partitionBy("parents", "first")
    n = n.withColumn("grp", F.min("node_id").over(w)).withColumn("size", F.count("*").over(w)).withColumn("low", F.min("seq").over(w)).withColumn("high", F.max("seq").over(w)).filter("size > 1")
    # strings in order share with the first what all share
    same = F.aggregate(
        F.sequence(F.lit(1), F.least(F.length("low"), F.length("high"))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(F.col("low"), i, F.lit(1)) == F.substring(F.col("high"), i, F.lit(1))), i).otherwise(k)
    )
    return n.select("node_id", "grp", same.cast("long").alias("n"))


def merge_siblings(g: Graph) -> Graph:
    """Common prefixes of siblings become one node; path sequences stay."""
    s = checkpointed(sibling_prefixes(g))
    cuts = s.join(g.lengths(), "node_id").filter("n < len").select("node_id", F.array("n").alias("cuts"))
    # ids after the cuts, as chop_at gives them
    k = g.nodes.join(cuts.select("node_id", F.lit(2).cast("long").alias("k")), "node_id", "left").withColumn("k", F.coalesce("k", F.lit(1).cast("long")))
    first = running_total(k, "node_rank", "k", "base").select("node_id", (F.col("base") + 1).alias("piece"))
    c = chop_at(g, cuts)
    p = s.join(first, "node_id")
    rep = p.groupBy("grp").agg(F.min("piece").alias("rep"))
    to = checkpointed(p.join(rep, "grp").filter("piece != rep").select("piece", "rep"))

    def renamed(df: DataFrame, column: str) -> DataFrame:
        return df.join(to, df[column] == to["piece"], "left").withColumn(column, F.coalesce("rep", column)).drop("piece", "rep")

    e = renamed(renamed(c.edges, "from_id"), "to_id").select(canonical(*[F.col(x) for x in EDGE]).alias("e")).select("e.*").distinct()
    return Graph(c.nodes.join(to, c.nodes["node_id"] == to["piece"], "left_anti"), e, c.paths, renamed(c.steps, "node_id").select(c.steps.columns))


def normalise(g: Graph) -> Graph:
    """Unchop and merge siblings on both sides until the graph grows no shorter; each round but the last takes base pairs away, so it ends."""

    def kept(x: Graph) -> Graph:
        return Graph(*[checkpointed(t) for t in (x.nodes, x.edges, x.paths, x.steps)])

    now = kept(unchop(kept(g)))
    length = now.nodes.agg(F.sum("len")).first()[0]
    while True:
        now = kept(merge_siblings(now))
        now = kept(turned(merge_siblings(turned(now))))
        now = kept(unchop(now))
        new = now.nodes.agg(F.sum("len")).first()[0]
        if new == length:
            return now
        length = new


def mergeable(g: Graph) -> DataFrame:
    """node_id of nodes that have a sibling with a common prefix, on either side: none after :func:`normalise`."""
    return sibling_prefixes(g).select("node_id").union(sibling_prefixes(turned(g)).select("node_id")).distinct()


def extract(g: Graph, ranges: DataFrame, context: int = 0, laced: bool = False, inverse: bool = False) -> Graph:
    """The subgraph under path ranges and ``context`` edges around (or, with ``inverse``, all but that); paths become sub-paths ``name:start-end``."""
    hit = range_join(ranges.select("path_id", "start", "end"), g.positions().select("path_id", "node_id", "step_start", "step_end"))
    seeds = hit.select("node_id").distinct()
    keep = reach(g, seeds, context).select("node_id") if context else seeds
    sub = induced(g, g.nodes.select("node_id").join(keep, "node_id", "left_anti") if inverse else keep)
    return lace(sub) if laced else sub


def close_gaps(g: Graph, keep: DataFrame, closer: int, rounds: int | None = None) -> DataFrame:
    """keep (node_id) and the nodes of every stretch of a path that leaves them for less than ``closer`` base pairs and comes back.

    Nodes that are filled in are kept on other paths too, so it goes on for ``rounds`` rounds, or until no node is added.
    """
    p = checkpointed(g.positions().select("path_id", "step_rank", "node_id", "step_start", "step_end"))
    ends = g.path_lengths().select("path_id", "path_len")
    now = checkpointed(keep.select("node_id").distinct())
    done = 0
    while rounds is None or done < rounds:
        marked = p.join(now.withColumn("kept", F.lit(True)), "node_id", "left")
        away = runs(marked, F.col("kept").isNotNull()).filter(~F.col("key") & (F.col("end") - F.col("start") < closer))
        away = away.join(ends, "path_id").filter("start > 0 AND end < path_len").select("path_id", "start", "end")
        new = checkpointed(range_join(away, p.select("path_id", "node_id", "step_start", "step_end")).select("node_id").distinct().join(now, "node_id", "left_anti"))
        if new.isEmpty():
            break
        now = checkpointed(now.union(new))
        done += 1
    return now


def extract_merged(g: Graph, ranges: DataFrame, closer: int, rounds: int | None = 6, context: int = 0) -> Graph:
    """:func:`extract` with gaps of less than ``closer`` base pairs closed, the paths cut into what is left of them (``path:start-end``),
    and every edge that they need."""
    from .rewrite import split_paths

    seeds = extract(g, ranges, context).nodes.select("node_id")
    keep = close_gaps(g, seeds, closer, rounds)
    sub = split_paths(g, g.steps.join(keep, "node_id", "left_semi"))
    inside = induced(g, keep)
    e = inside.edges.select(EDGE).union(edges_of_steps(sub.steps).select(EDGE)).distinct()
    return Graph(inside.nodes, e, sub.paths, sub.steps)


def split_extract(g: Graph, ranges: DataFrame, full_range: bool = False) -> DataFrame:
    """name, node_id: the nodes of each range on its own; with ``full_range`` all between the smallest and the largest id under it."""
    hit = range_join(ranges.select("path_id", "start", "end", "name"), g.positions().select("path_id", "node_id", "step_start", "step_end")).select("name", "node_id").distinct()
    if not full_range:
        return hit
    # ids as intervals of one line, so that the bucketed join finds them
    span = hit.groupBy("name").agg(F.min("node_id").alias("start"), (F.max("node_id") + 1).alias("end")).withColumn("path_id", F.lit(0))
    at = g.nodes.select(F.lit(0).alias("path_id"), "node_id", F.col("node_id").alias("step_start"), (F.col("node_id") + 1).alias("step_end"))
    return range_join(span, at).select("name", "node_id")


def range_totals(g: Graph, ranges: DataFrame) -> DataFrame:
    """name, nodes, bp: how many nodes lie between the smallest and the largest id under each range, and their base pairs.

    What :func:`split_extract` with ``full_range`` counts up to, from running totals over the ids, so that no range is spelled out.
    """
    hit = range_join(ranges.select("path_id", "start", "end", "name"), g.positions().select("path_id", "node_id", "step_start", "step_end"))
    span = hit.groupBy("name").agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    n = g.nodes.groupBy("node_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("l"))
    n = checkpointed(running_total(running_total(n, "node_id", "n", "n0"), "node_id", "l", "l0"))
    lo = n.select(F.col("node_id").alias("lo"), "n0", "l0")
    hi = n.select(F.col("node_id").alias("hi"), (F.col("n0") + F.col("n")).alias("n1"), (F.col("l0") + F.col("l")).alias("l1"))
    return span.join(lo, "lo").join(hi, "hi").select("name", (F.col("n1") - F.col("n0")).alias("nodes"), (F.col("l1") - F.col("l0")).alias("bp"))


def apply_order(g: Graph, ranks: DataFrame) -> Graph:
    """The graph with ``new_rank`` of ``ranks`` (node_id, new_rank) as the ids and ranks of its nodes."""
    to = checkpointed(ranks.select(F.col("node_id").alias("old"), F.col("new_rank").alias("new")))

    def renamed(df: DataFrame, column: str) -> DataFrame:
        return df.join(to, df[column] == to["old"]).withColumn(column, F.col("new")).drop("old", "new")

    e = renamed(renamed(g.edges, "from_id"), "to_id").select(canonical(*[F.col(c) for c in EDGE]).alias("e")).select("e.*")
    return Graph(renamed(g.nodes, "node_id").withColumn("node_rank", F.col("node_id")).select(g.nodes.columns), e, g.paths, renamed(g.steps, "node_id").select(g.steps.columns))


def flipped(g: Graph, flips: DataFrame) -> Graph:
    """The graph with the nodes of ``flips`` (node_id, flip) turned where flip is true; path sequences stay."""
    f = checkpointed(flips.filter("flip").select(F.col("node_id").alias("turned")).withColumn("t", F.lit(True)))

    def turn(df: DataFrame, column: str, rev: str) -> DataFrame:
        return df.join(f, df[column] == f["turned"], "left").withColumn(rev, F.col(rev) != F.coalesce("t", F.lit(False))).drop("turned", "t")

    n = g.nodes.join(f, g.nodes["node_id"] == f["turned"], "left").withColumn("seq", F.when(F.col("t"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    e = turn(turn(g.edges, "from_id", "from_rev"), "to_id", "to_rev").select(canonical(*[F.col(c) for c in EDGE]).alias("e")).select("e.*")
    return Graph(n.select(g.nodes.columns), e, g.paths, turn(g.steps, "node_id", "is_rev").select(g.steps.columns))


def sort_pipeline(g: Graph, orders: str) -> tuple[DataFrame, Graph]:
    """(old_id, node_id) and the graph after one order upon the other, each by a letter.

    s: topological, c: topological without edges that go back within a strong component, b: breadth first, z: depth first, r: random, f: reversed,
    Y: path-guided, g: groom (turns nodes and keeps their order).
    """
    from .forest import depth_first_order
    from .sampling import path_sgd, random_order
    from .traverse import break_cycles, groom, topological_order

    def backwards(x: Graph) -> DataFrame:
        return x.nodes.select("node_id", F.row_number().over(Window.orderBy(F.desc("node_rank"))).cast("long").alias("new_rank"))

    makers = {"s": topological_order, "c": lambda x: topological_order(break_cycles(x)), "b": breadth_first_order, "z": depth_first_order, "r": random_order, "f": backwards, "Y": path_sgd}
    ids = g.nodes.select(F.col("node_id").alias("old_id"), "node_id")
    for letter in orders:
        if letter == "g":
            g = flipped(g, groom(g))
            continue
        if letter not in makers:
            raise ValueError(f"no order is called {letter!r}")
        ranks = checkpointed(makers[letter](g).select("node_id", "new_rank"))
        ids = checkpointed(ids.join(ranks, "node_id").select("old_id", F.col("new_rank").alias("node_id")))
        h = apply_order(g, ranks)
        g = Graph(*[checkpointed(t) for t in (h.nodes, h.edges, h.paths, h.steps)])
    return ids, g


def breadth_first_order(g: Graph) -> DataFrame:
    """node_id, hops, new_rank: by edges from the nearest head (a node that no forward edge enters), then id; the rest last."""
    heads = peel_heads(g)
    seen = reach(g, heads, 1 << 30)
    n = g.nodes.select("node_id").join(seen, "node_id", "left")
    return n.select("node_id", "hops", F.row_number().over(Window.orderBy(F.col("hops").asc_nulls_last(), "node_id")).cast("long").alias("new_rank"))


def peel_heads(g: Graph) -> DataFrame:
    into = g.adjacency().filter("NOT src_rev AND NOT dst_rev").select(F.col("dst").alias("node_id")).distinct()
    return g.nodes.select("node_id").join(into, "node_id", "left_anti")


def extended(g: Graph, other: Graph) -> Graph:
    """``g`` with the nodes, edges and paths of ``other`` that it lacks, by id and by path name; where both have a node, its sequence is that of ``g``."""
    from .edit import add_edges, add_nodes, add_paths

    h = add_edges(add_nodes(g, other.nodes.select("node_id", "seq")), other.edges)
    named = other.steps.join(other.paths.select("path_id", "path_name"), "path_id")
    return add_paths(h, other.paths, named.select("path_name", F.col("step_rank").alias("k"), "node_id", "is_rev"))


def unrolled(g: Graph, length: int, on_cycles: DataFrame | None = None) -> DataFrame:
    """old_id, layer, dist: the copies of nodes that :func:`dagify` makes; ``on_cycles`` are the edges on cycles, if they are known.

    An edge back (to the same or a smaller id within a strongly connected component) leads to the next layer. A copy is made where
    less than ``length`` base pairs lie on some walk to it from any node of the first layer; ``dist`` is the least. Nodes without
    sequence count as one base pair, so the layers end.
    """
    inner = checkpointed((cycle_edges(g) if on_cycles is None else on_cycles).join(g.lengths().select(F.col("node_id").alias("src"), F.greatest("len", F.lit(1)).alias("w")), "src"))
    best = checkpointed(g.nodes.select(F.col("node_id").alias("old_id"), F.lit(0).cast("long").alias("layer"), F.lit(0).cast("long").alias("dist")))
    front = best
    while True:
        step = front.join(inner, front["old_id"] == inner["src"]).select(F.col("dst").alias("old_id"), (F.col("layer") + (F.col("src") >= F.col("dst")).cast("long")).alias("layer"), (F.col("dist") + F.col("w")).alias("d"))
        step = step.filter(F.col("d") < length).groupBy("old_id", "layer").agg(F.min("d").alias("d"))
        front = checkpointed(step.join(best, ["old_id", "layer"], "left").filter("dist IS NULL OR d < dist").select("old_id", "layer", F.col("d").alias("dist")))
        if front.isEmpty():
            return best
        best = checkpointed(best.union(front).groupBy("old_id", "layer").agg(F.min("dist").alias("dist")))


def dagify(g: Graph, length: int) -> tuple[Graph, DataFrame]:
    """A graph without cycles in which every forward walk of up to ``length`` base pairs can still be walked, and (node_id, old_id, layer).

    Components that hold cycles are unrolled in layers. Paths are not carried over; edges that change strand go (see
    :func:`split_strands`).
    """
    inside = checkpointed(cycle_edges(g))
    c = unrolled(g, length, inside)
    top = g.nodes.agg(F.coalesce(F.max("node_rank"), F.lit(0))).first()[0] + 1
    c = c.join(g.nodes.select(F.col("node_id").alias("old_id"), "node_rank"), "old_id").withColumn("at", F.col("layer") * top + F.col("node_rank"))
    c = running_total(c.withColumn("one", F.lit(1).cast("long")), "at", "one", "before")
    c = checkpointed(c.select((F.col("before") + 1).alias("node_id"), "old_id", "layer"))
    a = c.select(F.col("node_id").alias("from_id"), F.col("old_id").alias("src"), F.col("layer").alias("from_layer"))
    b = c.select(F.col("node_id").alias("to_id"), F.col("old_id").alias("dst"), F.col("layer").alias("to_layer"))
    e = forward_edges(g).join(inside.withColumn("inside", F.lit(True)), ["src", "dst"], "left").join(a, "src")
    e = e.withColumn("to_layer", F.when(F.col("inside"), F.col("from_layer") + (F.col("src") >= F.col("dst")).cast("long")).otherwise(0))
    e = e.join(b, ["dst", "to_layer"]).select("from_id", F.lit(False).alias("from_rev"), "to_id", F.lit(False).alias("to_rev"))
    e = e.select(canonical(*[F.col(x) for x in EDGE]).alias("e")).select("e.*")
    n = c.join(g.nodes.select(F.col("node_id").alias("old_id"), "seq", "len"), "old_id").select("node_id", "seq", "len", F.col("node_id").alias("node_rank"))
    return Graph(n, e, g.paths.limit(0), g.steps.limit(0)), c


def is_acyclic(g: Graph) -> bool:
    return peel(g)[1].isEmpty()


def stacked(g: Graph, layout: DataFrame, gap: float = 1.0) -> DataFrame:
    """layout (node_id, x, y) with each component moved to begin at x 0 and ``gap`` above the one before it, the largest (nodes, then id) lowest."""
    at = layout.join(components(g), "node_id")
    box = at.groupBy("component").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("y") - F.min("y") + gap).alias("h"), F.count("*").alias("n"))
    # one narrow row a component
    box = checkpointed(box.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "component")).cast("long")))
    below = F.coalesce(F.sum("h").over(before_row(Window.orderBy("place"))), F.lit(0.0))
    box = box.select("component", "x0", "y0", below.alias("base"))
    return at.join(box, "component").select("node_id", "component", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0") + F.col("base")).alias("y"))


def plane_layout(g: Graph, rounds: int = 8, terms: int = 2, seed: int = 1, theta: float = 0.99, space: int = 1000) -> DataFrame:
    """node_id, x, y: as :func:`braidframe.operators.sampling.path_sgd`, with two coordinates, y from a keyed digest at first."""
    from .sampling import sgd_steps, step_pairs

    p = sgd_steps(g)
    y0 = F.pmod(F.xxhash64(F.lit(seed), "node_id"), F.lit(1000)) / 100.0
    at = checkpointed(g.pan_positions().select("node_id", F.col("pan_start").cast("double").alias("x"), y0.alias("y")))
    longest = float(p.agg(F.max("step_start")).first()[0] or 1)
    for k in range(rounds):
        eta = longest**2 * (1.0 / longest**2) ** (k / max(1, rounds - 1))
        d = step_pairs(p.join(at, "node_id"), k, rounds, terms, seed, theta, space, ("x", "y"))
        dx, dy = F.col("other_x") - F.col("x"), F.col("other_y") - F.col("y")
        far = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
        pull = F.least(F.lit(1.0), F.lit(eta) / F.pow("d", 2)) * (far - F.col("d")) / 2 / far
        here = F.struct("node_id", (pull * dx).alias("mx"), (pull * dy).alias("my"))
        there = F.struct(F.col("other").alias("node_id"), (-pull * dx).alias("mx"), (-pull * dy).alias("my"))
        both = d.select(F.explode(F.array(here, there)).alias("b")).select("b.*")
        move = both.groupBy("node_id").agg(F.avg("mx").alias("mx"), F.avg("my").alias("my"))
        before, at = at, checkpointed(at.join(move, "node_id", "left").select("node_id", (F.col("x") + F.coalesce("mx", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("my", F.lit(0.0))).alias("y")))
        dropped(before)
    dropped(p)
    return at
