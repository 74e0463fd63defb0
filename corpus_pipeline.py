"""The corpus pipeline: quality rules, near-duplicate removal, pseudonyms, source mixing, packing.

Every stage takes the columns of documents and further ones, whatever their names, reads texts of any length whole, and gives an empty
result for an empty table. What nulls, ties and repeated rows give is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidframe.llm import jaccard_join, mixing, packing, pii, quality
from braidframe.llm.common import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the cascade go.

    Null and empty texts have no words and go; rows are judged one by one, so repeated rows go or stay together.
    """
    return quality.kept_documents(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays.

    One of repeated rows stays; texts without words are linked with nothing and all stay; rows without a doc_id come after those with one.
    """
    return jaccard_join.deduplicated(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text.

    Null text stays null, empty text empty; equal values get equal pseudonyms in every row, so repeated rows stay alike.
    """
    out = pii.pseudonymised(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null and empty texts are taken as often as other documents of their place in the order and add no words; a null source is a source of its own; ties and repeated rows are taken alike.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are their end id alone; repeated rows are packed each; ties of length keep the order of the input.
    """
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality_stage), ("ngram_jaccard", jaccard_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The mixing order and the packing have no SQL form; the run is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
    return docs
