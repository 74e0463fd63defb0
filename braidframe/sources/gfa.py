"""GFA version 1: reading into a graph, writing, and line-type counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph, canonical, running_total


class GraphError(ValueError):
    """A file that is not a valid graph."""


def line_types(spark: SparkSession, path: str) -> DataFrame:
    """line_type, n: the lines of a file by their first character."""
    return spark.read.text(path).filter(F.length("value") > 0).groupBy(F.substring("value", 1, 1).alias("line_type")).agg(F.count("*").alias("n"))


def numbered(lines: DataFrame, name: str) -> DataFrame:
    """``lines`` (with ``at``) and their number from 1 in the file's order; only ``at`` is sorted, in parts, not the lines."""
    place = running_total(lines.select("at", F.lit(1).cast("long").alias("one")), "at", "one", "before").select("at", (F.col("before") + 1).alias(name))
    return lines.join(place, "at")


def read_gfa(spark: SparkSession, path: str, compact: bool = False, checked: bool = True) -> Graph:
    """S, L and P records; overlaps and optional tags are dropped. Ids must be numbers and unique, edges between known nodes."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("f", F.split("value", "\t"))
    kind = F.substring("value", 1, 1)
    s = lines.filter(kind == "S").select("at", F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).alias("seq"))
    if checked and s.filter(~F.col("name").rlike(r"^\d+$")).limit(1).count():
        raise GraphError("node names must be numbers")
    nodes = s.select("at", F.col("name").cast("long").alias("node_id"), "seq", F.length("seq").cast("long").alias("len"))
    nodes = numbered(nodes, "node_rank").select("node_id", "seq", "len", "node_rank")
    if checked and nodes.groupBy("node_id").count().filter("count > 1").limit(1).count():
        raise GraphError("node ids must be unique")
    link = lines.filter(kind == "L").select(*[F.get("f", F.lit(i)).alias(n) for i, n in ((1, "a"), (2, "ar"), (3, "b"), (4, "br"))])
    e = link.select(canonical(F.col("a").cast("long"), F.col("ar") == "-", F.col("b").cast("long"), F.col("br") == "-").alias("e"))
    edges = e.select("e.*").dropDuplicates()
    if checked:
        known = nodes.select("node_id")
        for end in ("from_id", "to_id"):
            if edges.join(known, edges[end] == known["node_id"], "left_anti").limit(1).count():
                raise GraphError("an edge ends at an unknown node")
    p = numbered(lines.filter(kind == "P").select("at", "f"), "path_id").select("path_id", F.get("f", F.lit(1)).alias("path_name"), F.get("f", F.lit(2)).alias("segments"), (F.array_contains("f", "TP:Z:circular")).alias("is_circular"))
    steps = p.filter(F.length("segments") > 0).select("path_id", F.posexplode(F.split("segments", ",")).alias("k", "seg"))
    steps = steps.filter("seg != '*'").select("path_id", F.col("k").cast("long").alias("step_rank"), F.expr("substring(seg, 1, length(seg) - 1)").cast("long").alias("node_id"), F.col("seg").endswith("-").alias("is_rev"))
    g = Graph(nodes, edges, p.select("path_id", "path_name", "is_circular"), steps)
    return compacted(g) if compact else g


def compacted(g: Graph) -> Graph:
    """Node ids replaced by node ranks."""
    ids = g.nodes.select(F.col("node_id").alias("old"), F.col("node_rank").alias("new"))

    def renamed(df: DataFrame, column: str) -> DataFrame:
        return df.join(ids, df[column] == ids["old"]).drop(column, "old").withColumnRenamed("new", column).select(df.columns)

    return Graph(g.nodes.withColumn("node_id", F.col("node_rank")), renamed(renamed(g.edges, "from_id"), "to_id"), g.paths, renamed(g.steps, "node_id"))


def gfa_lines(g: Graph, annotated: bool = False) -> DataFrame:
    """section, key, line: the records of a file, in the order H, S, L, P; depth tags on S lines if ``annotated``."""
    sign = lambda c: F.when(c, "-").otherwise("+")
    head = g.spark.range(1).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("key"), F.lit("H\tVN:Z:1.0").alias("line"))
    s = g.nodes
    fields = [F.lit("S"), F.col("node_id").cast("string"), F.col("seq")]
    if annotated:
        s = s.join(g.steps.groupBy("node_id").agg(F.count("*").alias("depth")), "node_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
        fields += [F.concat(F.lit("DP:i:"), F.col("depth").cast("string")), F.concat(F.lit("RC:i:"), (F.col("depth") * F.col("len")).cast("string"))]
    s = s.select(F.lit(1).alias("section"), F.col("node_rank").alias("key"), F.concat_ws("\t", *fields).alias("line"))
    e = g.edges.select(F.lit(2).alias("section"), F.col("from_id").alias("key"), F.concat_ws("\t", F.lit("L"), F.col("from_id").cast("string"), sign(F.col("from_rev")), F.col("to_id").cast("string"), sign(F.col("to_rev")), F.lit("0M")).alias("line"))
    walk = g.steps.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("step_rank", F.concat(F.col("node_id").cast("string"), sign(F.col("is_rev"))).alias("seg")))).alias("w"))
    p = g.paths.join(walk, "path_id", "left").select(
        F.lit(3).alias("section"), F.col("path_id").alias("key"),
        F.concat_ws("\t", F.lit("P"), "path_name", F.coalesce(F.array_join(F.transform("w", lambda x: x["seg"]), ","), F.lit("")), F.lit("*"), F.when(F.col("is_circular"), "TP:Z:circular")).alias("line"),
    )
    return head.union(s).union(e).union(p)


def write_gfa(g: Graph, path: str, annotated: bool = False) -> None:
    gfa_lines(g, annotated).orderBy("section", "key", "line").select("line").write.mode("overwrite").text(path)


def save(g: Graph, path: str) -> None:
    """The four tables as parquet, the steps clustered by path."""
    for name in ("nodes", "edges", "paths"):
        getattr(g, name).write.mode("overwrite").parquet(f"{path}/{name}")
    g.steps.repartition("path_id").sortWithinPartitions("path_id", "step_rank").write.mode("overwrite").parquet(f"{path}/steps")


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(*[spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "paths", "steps")])


def open_graph(spark: SparkSession, path: str) -> Graph:
    """A graph by its name: ``.gfa`` text, otherwise saved tables."""
    return read_gfa(spark, path) if path.endswith(".gfa") else load(spark, path)
