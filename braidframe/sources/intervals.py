"""BED and GFF readers, region strings and list files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """name: distinct non-empty lines."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name != ''").distinct()


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """name, grp: a path name and its group a line, tab separated; a line without a group stands for a group of its own."""
    f = F.split("value", "\t")
    d = spark.read.text(path).filter(F.trim("value") != "")
    return d.select(F.get(f, F.lit(0)).alias("name"), F.coalesce(F.get(f, F.lit(1)), F.get(f, F.lit(0))).alias("grp")).distinct()


def region(text: str) -> tuple[str, int | None, int | None]:
    """``path[:start[-end]]``, split at the last colon."""
    import re

    m = re.fullmatch(r"(.+):(\d+)(?:-(\d+))?", text)
    return (m[1], int(m[2]), int(m[3]) if m[3] else None) if m else (text, None, None)


def read_bed(spark: SparkSession, path: str, g: Graph | None = None) -> DataFrame:
    """path_name, start, end, name, is_rev. A missing start is 0, a missing end the path's; empty ranges and, with ``g``, unknown paths go."""
    f = F.split("value", "\t")
    d = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    d = d.select(
        F.get(f, F.lit(0)).alias("path_name"), F.coalesce(F.get(f, F.lit(1)).cast("long"), F.lit(0)).alias("start"), F.get(f, F.lit(2)).cast("long").alias("end"),
        F.coalesce(F.get(f, F.lit(3)), F.lit("")).alias("name"), F.coalesce(F.get(f, F.lit(5)) == "-", F.lit(False)).alias("is_rev"),
    )
    if g is not None:
        known = g.paths.join(g.path_lengths(), "path_id", "left").select("path_name", F.coalesce("path_len", F.lit(0)).alias("path_len"))
        d = d.join(known, "path_name").withColumn("end", F.coalesce("end", "path_len")).drop("path_len")
    return d.filter("end IS NULL OR start < end")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """path_name, start (0-based), end, annotation; names ``path:start-end`` are taken as sub-paths and the range re-based and clipped."""
    f = F.split("value", "\t")
    d = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.length("value") > 0))
    d = d.select(F.get(f, F.lit(0)).alias("path_name"), (F.get(f, F.lit(3)).cast("long") - 1).alias("start"), F.get(f, F.lit(4)).cast("long").alias("end"), F.get(f, F.lit(8)).alias("annotation"))
    return rebased(d)


def rebased(ranges: DataFrame) -> DataFrame:
    lo = F.regexp_extract("path_name", r":(\d+)-(\d+)$", 1)
    hi = F.regexp_extract("path_name", r":(\d+)-(\d+)$", 2)
    base = F.when(lo != "", lo.cast("long")).otherwise(0)
    end = F.when(hi != "", F.least(F.col("end"), hi.cast("long"))).otherwise(F.col("end"))
    return ranges.withColumn("end", end - base).withColumn("start", F.greatest(F.col("start") - base, F.lit(0))).filter("start < end")
