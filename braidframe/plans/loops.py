"""Fix-point loops: each round's table is checkpointed, so that the lineage stays short and outlives an executor."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the master is local and no folder is named, as in tests.
FALLBACK = "/tmp/braidframe-checkpoints"
#: Where the tables of :func:`checkpointed` lie.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which the driver and all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return FALLBACK


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a table in :func:`shared_folder`, read back: its size is known to the next join, and nothing of the plan before it stays.

    (A reliable checkpoint keeps the constraints of its plan, which grow with every round of a loop until planning takes longer than running.)
    """
    spark = df.sparkSession
    path = until_exit(spark, f"{shared_folder(spark)}/round-{uuid4().hex}")
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions within leave no shuffle files, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def dropped(*tables: DataFrame | None) -> None:
    """Removes tables of :func:`checkpointed` which no plan that is still to run reads; others are left as they are."""
    for t in tables:
        if t is not None and (path := _FOLDERS.pop(t, None)):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which is removed with all below it when the driver ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    return path


def settled_count(df: DataFrame) -> int:
    return df.count()


def signature(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Number of rows and the exclusive or of their hashes: equal for equal tables of distinct rows, and never too large for a long."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0).cast("long")).alias("x")).first()
    return r["n"], r["x"]


def stars(pairs: DataFrame) -> DataFrame:
    """node, root: the smallest node of the connected component of every node in ``pairs`` (a, b; narrow, undirected).

    Alternating large and small stars: every node's larger neighbours are tied to its smallest one, then every node and its smaller
    neighbours to the smallest of them, until the edges are stars. The edges never grow in number, rounds are few whatever the
    diameter, and smallest neighbours are pre-aggregated before they are joined back, so a hub is no group in one task.
    """
    e = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    seen = signature(e, "u", "v")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = checkpointed(large)
        dropped(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.filter("u != v").select("u", "v").distinct())
        dropped(large)
        now = signature(e, "u", "v")
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = checkpointed(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))
    dropped(e)
    return out
