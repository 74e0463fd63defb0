"""The step index as bucketed tables: steps with their positions, once by path and once by node, so that joins and groupings by either need no shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph

#: table: the column that its buckets and their order go by, and what else the order has.
TABLES = {"by_path": ("path_id", "step_rank"), "by_node": ("node_id",), "nodes": ("node_id",), "lengths": ("path_id",), "paths": ("path_id",), "edges": ("from_id",)}


@dataclass(frozen=True)
class IndexedGraph(Graph):
    """A graph over the index's tables: positions and path lengths are read, not made."""

    tables: tuple[tuple[str, DataFrame], ...] = ()

    def table(self, name: str) -> DataFrame:
        return dict(self.tables)[name]

    def positions(self) -> DataFrame:
        return self.table("by_path")

    def by_node(self) -> DataFrame:
        """:meth:`positions` in buckets by node."""
        return self.table("by_node")

    def path_lengths(self) -> DataFrame:
        return self.table("lengths")


def write_index(g: Graph, folder: str, buckets: int = 200) -> IndexedGraph:
    """The index of ``g`` as bucketed tables below ``folder``, with the same number of ``buckets`` each, so that they join bucket by bucket."""
    p = g.positions()
    lengths = p.groupBy("path_id").agg(F.count("*").alias("n_steps"), F.sum("len").alias("path_len"))
    frames = {"by_path": p, "by_node": p, "nodes": g.nodes, "lengths": lengths, "paths": g.paths, "edges": g.edges}
    for name, df in frames.items():
        first, *more = TABLES[name]
        # rows of a bucket meet before they are written, so that each has one file
        dealt = df.repartition(buckets, first)
        writer = dealt.write.bucketBy(buckets, first).sortBy(first, *more).option("path", f"{folder}/{name}").format("parquet")
        writer.saveAsTable(f"index_{uuid4().hex}_{name}")
    return open_index(g.spark, folder, buckets, {n: df.schema for n, df in frames.items()})


def open_index(spark: SparkSession, folder: str, buckets: int, schemas: dict | None = None) -> IndexedGraph:
    """The index below ``folder``, also in another session: its tables are named to the catalog anew."""
    tables = {}
    for name, (first, *more) in TABLES.items():
        schema = (schemas or {}).get(name) or spark.read.parquet(f"{folder}/{name}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        view = f"index_{uuid4().hex}_{name}"
        order = ", ".join([first, *more])
        spark.sql(f"CREATE TABLE {view} ({columns}) USING parquet CLUSTERED BY ({first}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{folder}/{name}'")
        tables[name] = spark.table(view)
    steps = tables["by_path"].select("path_id", "step_rank", "node_id", "is_rev")
    return IndexedGraph(tables["nodes"], tables["edges"], tables["paths"], steps, tuple(tables.items()))
