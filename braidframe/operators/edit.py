"""Edits by tables of changes: each takes a graph and gives a new one, whatever the number of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph, canonical, running_total
from .rewrite import EDGE


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select(canonical(*[F.col(c) for c in EDGE]).alias("e")).select("e.*").distinct()


def add_nodes(g: Graph, nodes: DataFrame) -> Graph:
    """New nodes (node_id, seq) behind all others, by id; ids that are there already stay as they are."""
    new = nodes.select("node_id", "seq").dropDuplicates(["node_id"]).join(g.nodes.select("node_id"), "node_id", "left_anti")
    top = g.nodes.agg(F.coalesce(F.max("node_rank"), F.lit(0))).first()[0]
    new = running_total(new.withColumn("one", F.lit(1).cast("long")), "node_id", "one", "before")
    return g.with_(nodes=g.nodes.unionByName(new.select("node_id", "seq", F.length("seq").cast("long").alias("len"), (F.col("before") + 1 + top).alias("node_rank"))))


def set_sequences(g: Graph, nodes: DataFrame) -> Graph:
    """The sequences of ``nodes`` (node_id, seq) in place of what the nodes have; unknown ids are passed over."""
    n = g.nodes.join(nodes.select("node_id", F.col("seq").alias("new")), "node_id", "left").withColumn("seq", F.coalesce("new", "seq"))
    return g.with_(nodes=n.withColumn("len", F.length("seq").cast("long")).select(g.nodes.columns))


def add_edges(g: Graph, edges: DataFrame) -> Graph:
    """Edges (from_id, from_rev, to_id, to_rev) given from either end; those that are there already count once."""
    return g.with_(edges=g.edges.select(EDGE).union(_edges(edges)).distinct())


def drop_edges(g: Graph, edges: DataFrame) -> Graph:
    """Without the edges given, from either end; steps over them stay."""
    return g.with_(edges=g.edges.select(EDGE).join(_edges(edges), EDGE, "left_anti"))


def shift_ids(g: Graph, by: int) -> Graph:
    """Every node id larger by ``by``."""
    up = lambda df, *columns: df.withColumns({c: F.col(c) + by for c in columns})
    return Graph(up(g.nodes, "node_id"), up(g.edges, "from_id", "to_id"), g.paths, up(g.steps, "node_id"))


def add_paths(g: Graph, paths: DataFrame, steps: DataFrame) -> Graph:
    """New paths (path_name, is_circular) with steps (path_name, k, node_id, is_rev) in the order of k; ids go on from the largest."""
    top = g.paths.agg(F.coalesce(F.max("path_id"), F.lit(0))).first()[0]
    new = paths.select("path_name", "is_circular").dropDuplicates(["path_name"]).join(g.paths.select("path_name"), "path_name", "left_anti")
    # only names are ranked, not steps
    new = new.withColumn("path_id", (F.row_number().over(Window.orderBy("path_name")) + top).cast("long"))
    rank = F.row_number().over(Window.partitionBy("path_id").orderBy("k")) - 1
    s = steps.join(new.select("path_name", "path_id"), "path_name").select("path_id", rank.cast("long").alias("step_rank"), "node_id", "is_rev")
    return g.with_(paths=g.paths.unionByName(new.select(g.paths.columns)), steps=g.steps.unionByName(s))


def set_circular(g: Graph, paths: DataFrame) -> Graph:
    """The flag of ``paths`` (path_id, is_circular) in place of what the paths have."""
    p = g.paths.join(paths.select("path_id", F.col("is_circular").alias("new")), "path_id", "left")
    return g.with_(paths=p.withColumn("is_circular", F.coalesce("new", "is_circular")).select(g.paths.columns))


def rewrite_segments(g: Graph, segments: DataFrame, steps: DataFrame | None = None) -> Graph:
    """Steps from rank ``first`` up to ``last`` (not included) of ``segments`` (path_id, first, last) give way to ``steps``
    (path_id, first, k, node_id, is_rev) in the order of k.

    Segments of a path may not overlap. One without length inserts before ``first``, one of a single step sets it, one
    without steps cuts out; ``first`` 0 prepends and the number of steps appends.
    """
    gone = segments.filter("last > first").select("path_id", F.explode(F.sequence("first", F.col("last") - 1)).alias("step_rank"))
    kept = g.steps.join(gone, ["path_id", "step_rank"], "left_anti").select("path_id", F.col("step_rank").alias("at"), F.lit(True).alias("old"), F.lit(0).cast("long").alias("k"), "node_id", "is_rev")
    if steps is not None:
        new = steps.join(segments.select("path_id", "first"), ["path_id", "first"], "left_semi")
        kept = kept.unionByName(new.select("path_id", F.col("first").alias("at"), F.lit(False).alias("old"), F.col("k").cast("long").alias("k"), "node_id", "is_rev"))
    rank = F.row_number().over(Window.partitionBy("path_id").orderBy("at", "old", "k")) - 1
    return g.with_(steps=kept.select("path_id", rank.cast("long").alias("step_rank"), "node_id", "is_rev"))


def append_steps(g: Graph, steps: DataFrame) -> Graph:
    """``steps`` (path_id, k, node_id, is_rev) behind the last step of their paths."""
    ends = g.paths.select("path_id").join(g.steps.groupBy("path_id").agg(F.count("*").alias("n")), "path_id", "left").select("path_id", F.coalesce("n", F.lit(0)).alias("first"))
    return rewrite_segments(g, ends.withColumn("last", F.col("first")), steps.join(ends, "path_id"))


def prepend_steps(g: Graph, steps: DataFrame) -> Graph:
    """``steps`` (path_id, k, node_id, is_rev) before the first step of their paths."""
    none = F.lit(0).cast("long")
    return rewrite_segments(g, g.paths.select("path_id", none.alias("first"), none.alias("last")), steps.withColumn("first", none))


def combine(g: Graph, links: DataFrame) -> Graph:
    """Nodes joined by ``links`` (a, a_rev, b, b_rev) become one where nothing else branches off or ends between them."""
    from .traverse import perfect_links, unchop

    ends = ["a", "a_rev", "b", "b_rev"]
    both = links.select(ends).union(links.select("b", ~F.col("b_rev"), "a", ~F.col("a_rev"))).distinct()
    return unchop(g, perfect_links(g).join(both, ends, "left_semi"))
