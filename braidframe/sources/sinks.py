"""Text formats for results: BED, BEDPE, PAF, gene arrows, FASTA, YAML, JSON lines; a graph file for each component; layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph


def bed_lines(ranges: DataFrame, g: Graph, *extra: str) -> DataFrame:
    """line: path name, start, end and further columns, tab separated."""
    named = ranges.join(g.paths.select("path_id", "path_name"), "path_id")
    return named.select(F.concat_ws("\t", "path_name", F.col("start").cast("string"), F.col("end").cast("string"), *[F.col(c).cast("string") for c in extra]).alias("line"))


def bedpe_lines(matches: DataFrame) -> DataFrame:
    c = ["query", "query_start", "query_end", "ref", "ref_start", "ref_end", "score", "inv", "self_cov", "nth_best"]
    return matches.select(F.concat_ws("\t", *[F.col(x).cast("string") for x in c]).alias("line"))


def paf_lines(matches: DataFrame, lengths: DataFrame) -> DataFrame:
    """PAF rows of segment matches; the identity is 1 - min(1, -ln(2J / (1 + J)))."""
    q = lengths.select(F.col("path_id").alias("query"), F.col("path_len").alias("ql"))
    r = lengths.select(F.col("path_id").alias("ref"), F.col("path_len").alias("rl"))
    m = matches.join(q, "query").join(r, "ref")
    identity = 1 - F.least(F.lit(1.0), -F.log(2 * F.col("score") / (1 + F.col("score"))))
    span = F.greatest(F.col("query_end") - F.col("query_start"), F.col("ref_end") - F.col("ref_start"))
    cols = ["query", "ql", "query_start", "query_end", "inv", "ref", "rl", "ref_start", "ref_end"]
    return m.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols], F.round(identity * span).cast("long").cast("string"), span.cast("string"), F.lit("255"), F.format_string("id:f:%.6f", identity), F.format_string("jc:f:%.6f", F.col("score"))).alias("line"))


def gggenes_lines(matches: DataFrame) -> DataFrame:
    """line: molecule, gene, start, end, strand of segment matches, for arrow plots of genes; a header comes first."""
    c = [F.col("query").cast("string"), F.col("ref").cast("string"), F.col("query_start").cast("string"), F.col("query_end").cast("string"), F.when(F.col("inv") == "+", "1").otherwise("0")]
    head = matches.sparkSession.range(1).select(F.lit("molecule\tgene\tstart\tend\tstrand").alias("line"))
    return head.union(matches.select(F.concat_ws("\t", *c).alias("line")))


def fasta_lines(sequences: DataFrame, width: int = 80) -> DataFrame:
    """path_name, k, line: a header and the sequence cut into lines."""
    n = F.ceil(F.length("sequence") / width)
    s = sequences.withColumn("k", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    line = F.when(F.col("k") == 0, F.concat(F.lit(">"), "path_name")).otherwise(F.substring(F.col("sequence"), (F.col("k") - 1) * width + 1, F.lit(width)))
    return s.select("path_name", "k", line.alias("line"))


def fastq_lines(sequences: DataFrame, quality: str = "I") -> DataFrame:
    s = F.col("sequence")
    return sequences.select(F.concat(F.lit("@"), "path_name", F.lit("\n"), s, F.lit("\n+\n"), F.expr(f"repeat('{quality}', length(sequence))")).alias("line"))


def yaml_lines(summary: DataFrame) -> DataFrame:
    """line: ``key: value`` of a one-row table."""
    pairs = F.array(*[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in summary.columns])
    return summary.select(F.explode(pairs).alias("line"))


def json_lines(bins: DataFrame) -> DataFrame:
    """line: per path its bins as one JSON object."""
    b = F.struct("bin", "mean_cov", "mean_inv", "mean_pos")
    return bins.groupBy("path_id").agg(F.array_sort(F.collect_list(b)).alias("bins")).select(F.to_json(F.struct("path_id", "bins")).alias("line"))


def write_components(g: Graph, path: str) -> None:
    """A folder ``component=N`` with a graph file for each weakly connected component; paths without steps go to none."""
    from ..operators.traverse import components
    from .gfa import gfa_lines

    c = components(g)
    of_path = g.steps.join(c, "node_id").groupBy("path_id").agg(F.min("component").alias("component"))
    lines = gfa_lines(g)
    at = c.select(F.col("node_id").alias("key"), "component")
    # nodes are listed by rank, edges by their first node
    nodes = lines.filter("section = 1").join(g.nodes.select(F.col("node_rank").alias("key"), "node_id"), "key").join(c, "node_id")
    edges = lines.filter("section = 2").join(at, "key")
    paths = lines.filter("section = 3").join(of_path.withColumnRenamed("path_id", "key"), "key")
    parts = [x.select("component", "section", "key", "line") for x in (nodes, edges, paths)]
    every = parts[0].union(parts[1]).union(parts[2]).orderBy("component", "section", "key", "line")
    every.select("component", "line").write.mode("overwrite").partitionBy("component").text(path)


def write_layout(layout: DataFrame, path: str) -> None:
    """node_id, x, y as a table."""
    layout.select("node_id", "x", "y").write.mode("overwrite").parquet(path)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node_id long, x double, y double").parquet(path)
