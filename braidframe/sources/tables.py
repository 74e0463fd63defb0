"""Deterministic adapters from the relational tables to graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph, edges_of_steps
from ..plans.loops import checkpointed

LINE_KEY = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # part keys count from 0, so the key itself is the rank
    return _read(spark, sf_dir, "part").select(
        (F.col("p_partkey") + 1).alias("node_id"), F.col("p_name").alias("seq"), F.length("p_name").cast("long").alias("len"), (F.col("p_partkey") + 1).alias("node_rank")
    )


def _steps(lines: DataFrame) -> DataFrame:
    # the path id is named before the window, so that later windows over paths find the rows dealt out already
    w = Window.partitionBy("path_id").orderBy(*LINE_KEY)
    return lines.withColumnRenamed("l_orderkey", "path_id").select(
        "path_id", (F.row_number().over(w) - 1).cast("long").alias("step_rank"), (F.col("l_partkey") + 1).alias("node_id"), (F.col("l_returnflag") == "R").alias("is_rev")
    )


def supply_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat_ws("#", "n_name", F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    return p.select(F.col("o_orderkey").alias("path_id"), name.alias("path_name"), F.lit(False).alias("is_circular"))


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts are nodes, orders paths, line items steps."""
    steps = _steps(_read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_KEY, "l_returnflag"))
    return Graph(supply_nodes(spark, sf_dir), edges_of_steps(steps).drop("support"), supply_paths(spark, sf_dir), steps)


def account_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """What a customer has from a supplier is a node, an order a path over its lines' suppliers: one or more components a customer,
    with chains, bubbles and cycles. The sequence spells the supplier's number in bases; all line items count."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_KEY, "l_returnflag")
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    node = F.col("o_custkey") * 1_000_000 + F.col("l_suppkey") + 1
    seq = F.translate(F.concat(F.lit("1"), F.col("l_suppkey").cast("string")), "0123456789", "ACGTACGTAC")
    w = Window.partitionBy("path_id").orderBy(*LINE_KEY)
    s = lines.join(o, "l_orderkey").withColumnRenamed("l_orderkey", "path_id")
    # the wide rows are dealt out once; what nodes, edges and steps are made from is a narrow table
    s = checkpointed(s.select("path_id", (F.row_number().over(w) - 1).cast("long").alias("step_rank"), node.alias("node_id"), (F.col("l_returnflag") == "R").alias("is_rev"), seq.alias("seq")))
    steps = s.drop("seq")
    nodes = s.select("node_id", "seq").distinct().select("node_id", "seq", F.length("seq").cast("long").alias("len"), F.col("node_id").alias("node_rank"))
    return Graph(nodes, edges_of_steps(steps).drop("support"), supply_paths(spark, sf_dir), steps)


def supply_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, start, end, name: a range of each order, to be clipped at its path's end by those who use it."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path_id"))
    return o.select("path_id", (F.col("path_id") % 10).alias("start"), (F.col("path_id") % 10 + 15).alias("end"), F.concat(F.lit("r"), F.col("path_id").cast("string")).alias("name"))


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Event types are nodes, users paths, events in time order steps: few nodes under deep coverage."""
    e = _read(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    kinds = e.select("event_type").distinct().select("event_type", F.row_number().over(Window.orderBy("event_type")).cast("long").alias("node_id"))
    nodes = kinds.select("node_id", F.col("event_type").alias("seq"), F.length("event_type").cast("long").alias("len"), F.col("node_id").alias("node_rank"))
    s = e.join(kinds, "event_type")
    steps = s.select(F.col("user_id").alias("path_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1).cast("long").alias("step_rank"), "node_id", F.lit(False).alias("is_rev"))
    paths = e.select("user_id").distinct().select(F.col("user_id").alias("path_id"), F.concat(F.lit("user#"), F.col("user_id").cast("string")).alias("path_name"), F.lit(False).alias("is_circular"))
    return Graph(nodes, edges_of_steps(steps).drop("support"), paths, steps)
