"""The data model: a bidirected sequence graph with embedded paths as four DataFrames, and what is derived from them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "node_id long, seq string, len long, node_rank long"
EDGE_SCHEMA = "from_id long, from_rev boolean, to_id long, to_rev boolean"
PATH_SCHEMA = "path_id long, path_name string, is_circular boolean"
STEP_SCHEMA = "path_id long, step_rank long, node_id long, is_rev boolean"

IN_ORDER = ("path_id", "step_rank")


def step_order() -> Window:
    return Window.partitionBy("path_id").orderBy("step_rank")


def before_row(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def canonical(a: Column, ar: Column, b: Column, br: Column) -> Column:
    """struct(from_id, from_rev, to_id, to_rev): the smaller of an edge and the same edge seen from its other end."""
    names = ("from_id", "from_rev", "to_id", "to_rev")
    pack = lambda *x: F.struct(*[c.alias(n) for c, n in zip(x, names)])
    return F.least(pack(a, ar, b, br), pack(b, ~br, a, ~ar))


#: Steps of a path that meet in one task, at most.
CHUNK = 1 << 16


def with_next(steps: DataFrame, *columns: str) -> DataFrame:
    """``steps`` with each of ``columns`` of the next step of the path as ``next_*``, null on the last one; ranks have no gaps.

    Paths are looked at in chunks of ``CHUNK`` steps, and the first step of a chunk is also a guest at the end of the one before,
    so that a path of any length is spread over tasks in a single shuffle.
    """
    chunk = F.floor(F.col("step_rank") / CHUNK)
    border = (F.col("step_rank") > 0) & (F.col("step_rank") % CHUNK == 0)
    s = steps.withColumn("_c", F.explode(F.when(border, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))))
    w = Window.partitionBy("path_id", "_c").orderBy("step_rank")
    s = s.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return s.filter(F.col("_c") == chunk).drop("_c")


def running_total(df: DataFrame, order: str, value: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows with a smaller ``order``, without one task for all rows.

    Quantiles of ``order`` cut the rows into parts; sums of the parts (one row each) are added up, and only within a part do
    rows meet. ``order`` must be unique.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = df.agg(F.percentile_approx(order, [(i + 1) / n for i in range(n - 1)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    df = df.withColumn("_part", part)
    sums = df.groupBy("_part").agg(F.sum(value).alias("_s"))
    sums = sums.select("_part", F.coalesce(F.sum("_s").over(before_row(Window.orderBy("_part"))), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(value).over(before_row(Window.partitionBy("_part").orderBy(order))), F.lit(0))
    return df.join(F.broadcast(sums), "_part").withColumn(out, (F.col("_base") + within).cast("long")).drop("_part", "_base")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame
    steps: DataFrame

    def with_(self, **parts: DataFrame) -> Graph:
        return replace(self, **parts)

    @property
    def spark(self):
        return self.nodes.sparkSession

    def counts(self) -> dict[str, int]:
        """Numbers of nodes, edges, paths and steps."""
        return {x: getattr(self, x).count() for x in ("nodes", "edges", "paths", "steps")}

    def id_bounds(self) -> tuple[int | None, int | None]:
        """The smallest and the largest node id."""
        return tuple(self.nodes.agg(F.min("node_id"), F.max("node_id")).first())

    def has_nodes(self, ids: DataFrame) -> DataFrame:
        """ids (node_id) that are nodes."""
        return ids.join(self.nodes.select("node_id"), "node_id", "left_semi")

    def has_edges(self, edges: DataFrame) -> DataFrame:
        """edges (src, src_rev, dst, dst_rev), seen from either end, that are there."""
        return edges.join(self.adjacency(), ["src", "src_rev", "dst", "dst_rev"], "left_semi")

    def has_paths(self, names: DataFrame) -> DataFrame:
        """names (name) that are paths."""
        return names.join(self.paths.select(F.col("path_name").alias("name")), "name", "left_semi")

    def follow(self, ends: DataFrame, left: bool = False) -> DataFrame:
        """The neighbours (dst, dst_rev) of oriented nodes (src, src_rev), on their right or their left side."""
        a = self.adjacency()
        if left:
            a = a.select("src", (~F.col("src_rev")).alias("src_rev"), "dst", (~F.col("dst_rev")).alias("dst_rev"))
        return ends.join(a, ["src", "src_rev"])

    def steps_on(self, ids: DataFrame) -> DataFrame:
        """Steps on nodes (node_id)."""
        return self.steps.join(ids.select("node_id"), "node_id", "left_semi")

    def steps_of(self, names: DataFrame) -> DataFrame:
        """Steps of paths (name)."""
        p = self.paths.select("path_id", F.col("path_name").alias("name"))
        return self.steps.join(p, "path_id").join(names.select("name"), "name", "left_semi").drop("name")

    def path_ends(self) -> DataFrame:
        """path_id, first_node, last_node of paths with steps."""
        at = lambda f: f(F.struct("step_rank", "node_id"))["node_id"]
        return self.steps.groupBy("path_id").agg(at(F.min).alias("first_node"), at(F.max).alias("last_node"))

    def lengths(self) -> DataFrame:
        return self.nodes.select("node_id", "len")

    def adjacency(self) -> DataFrame:
        """(src, src_rev, dst, dst_rev): every edge seen from both ends; an inverting loop has one such view."""
        # both views of an edge come from one pass over the edges
        view = lambda a, ar, b, br: F.struct(a.alias("src"), ar.alias("src_rev"), b.alias("dst"), br.alias("dst_rev"))
        f, fr, t, tr = (F.col(c) for c in ("from_id", "from_rev", "to_id", "to_rev"))
        both = F.when((f == t) & (fr != tr), F.array(view(f, fr, t, tr))).otherwise(F.array(view(f, fr, t, tr), view(t, ~tr, f, ~fr)))
        return self.edges.select(F.explode(both).alias("v")).select("v.*")

    def positions(self) -> DataFrame:
        """Steps with len, step_start and step_end in base pairs along their path."""
        # lengths are added up within chunks of a path and over chunks; only paths of several chunks have rows to join
        s = self.steps.join(self.lengths(), "node_id").withColumn("_c", F.floor(F.col("step_rank") / CHUNK))
        sums = s.groupBy("path_id", "_c").agg(F.sum("len").alias("_s"))
        bases = sums.withColumn("_base", F.sum("_s").over(before_row(Window.partitionBy("path_id").orderBy("_c")))).filter("_c > 0").select("path_id", "_c", "_base")
        within = F.coalesce(F.sum("len").over(before_row(Window.partitionBy("path_id", "_c").orderBy("step_rank"))), F.lit(0))
        s = s.withColumn("step_start", within).join(bases, ["path_id", "_c"], "left").withColumn("step_start", F.col("step_start") + F.coalesce("_base", F.lit(0)))
        return s.drop("_c", "_base").withColumn("step_end", F.col("step_start") + F.col("len"))

    def pan_positions(self) -> DataFrame:
        """Nodes with pan_start, their offset in the concatenation of all nodes by rank."""
        return running_total(self.nodes, "node_rank", "len", "pan_start")

    def transitions(self) -> DataFrame:
        """Consecutive steps of a path: (path_id, step_rank, src, src_rev, dst, dst_rev)."""
        t = with_next(self.steps, "node_id", "is_rev").filter("next_node_id IS NOT NULL")
        return t.select("path_id", "step_rank", F.col("node_id").alias("src"), F.col("is_rev").alias("src_rev"), F.col("next_node_id").alias("dst"), F.col("next_is_rev").alias("dst_rev"))

    def path_lengths(self) -> DataFrame:
        """path_id, n_steps, path_len, of paths with steps."""
        return self.steps.join(self.lengths(), "node_id").groupBy("path_id").agg(F.count("*").alias("n_steps"), F.sum("len").alias("path_len"))


def edges_of_steps(steps: DataFrame) -> DataFrame:
    """The canonical edges that consecutive steps need, with their support."""
    t = with_next(steps, "node_id", "is_rev").filter("next_node_id IS NOT NULL")
    e = t.select(canonical(F.col("node_id"), F.col("is_rev"), F.col("next_node_id"), F.col("next_is_rev")).alias("e")).select("e.*")
    return e.groupBy("from_id", "from_rev", "to_id", "to_rev").agg(F.count("*").alias("support"))
