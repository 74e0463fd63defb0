"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word patterns and 5-word window of the query contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` as a positive class, which Java's matcher runs through eight times as fast.
LICENSE_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
LICENSE_WORD_OR_CAPITALS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
SHINGLE_WORDS = 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so that it is evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def ascii_lower_words(text: Column, pattern: str, pattern_with_capitals: str) -> Column:
    """The words of ``text`` after lower-casing A-Z alone, without a slow character map over the whole text.

    ``pattern`` finds words in the lowered text and ``pattern_with_capitals`` the same ones in the text as it is. A string of
    ASCII alone can be lowered as a whole; in others only the words that hold capitals are.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.transform(words_of(text, pattern_with_capitals), lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(ascii_lower(w)))
    return F.when(ascii_only, words_of(F.lower(text), pattern)).otherwise(lowered)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows to Python for the actions within, so that long texts do not add up in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_folder(spark: SparkSession, fallback: str = "/tmp/braidframe-checkpoints") -> str:
    """The folder that the cluster names in spark.checkpoint.dir; ``fallback`` only on a local master that names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return fallback


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files that outlive an executor."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def settled(df: DataFrame, rows_a_part: int = 200_000) -> DataFrame:
    """:func:`checkpointed`, read back in as few partitions as its rows need, so that small tables do not make many small files."""
    out = checkpointed(df)
    return out.coalesce(parts_for(out.count(), rows_a_part))


def parts_for(rows: int, rows_a_part: int = 200_000) -> int:
    return max(1, -(-rows // rows_a_part))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
