"""The bucketed step index: the same answers, and no shuffle for what goes by path or node."""

from pyspark.sql import functions as F

from braidframe.operators import intervals as I
from braidframe.operators import stats as S
from braidframe.sources import index
from braidframe.sources.tables import supply_graph


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index(spark, tmp_path):
    g = supply_graph(spark, "/root/testdata/sf0.001")
    i = index.write_index(g, str(tmp_path / "index"), 4)
    columns = ["path_id", "step_rank", "node_id", "is_rev", "len", "step_start", "step_end"]
    assert rows(i.positions().select(*columns)) == rows(g.positions().select(*columns)) and rows(i.path_lengths()) == rows(g.path_lengths())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_path = i.positions().join(i.path_lengths(), "path_id").groupBy("path_id").agg(F.sum("step_start"), F.first("path_len"))
        by_node = i.by_node().join(i.nodes.select("node_id", "seq"), "node_id").groupBy("node_id").agg(F.count("*"))
        for df in (by_path, by_node):
            assert "Exchange" not in plan(df) and df.count() > 0
        assert "Exchange" in plan(g.positions().groupBy("path_id").count())
        again = index.open_index(spark, str(tmp_path / "index"), 4)
        assert rows(again.by_node().groupBy("node_id").count()) == rows(g.steps.groupBy("node_id").count()) and "Exchange" not in plan(again.by_node().groupBy("node_id").count())
        ranges = g.paths.select("path_id", F.lit(3).cast("long").alias("start"), F.lit(25).cast("long").alias("end"), "path_name").withColumnRenamed("path_name", "name")
        depth = S.depth_table(g)
        assert rows(I.mean_over_ranges(i, ranges, depth, "depth")) == rows(I.mean_over_ranges(g, ranges, depth, "depth"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
