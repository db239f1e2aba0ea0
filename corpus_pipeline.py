"""The training-data pipeline: STAGES, each a function (spark, docs, sf_dir) -> DataFrame, and run() over all of them.

Each stage works on all that the one before kept. All but the last return the columns of documents, and any others there
are, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.line_dedup import drop_lines
from quire.llm.minhash import drop_near_copies
from quire.llm.packing import pack
from quire.llm.quality_rules import keep_good
from quire.llm.secrets import redact_secrets
from quire.sources.folders import run_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule. Null, empty and wordless ones go; repeated rows are judged one by one; an empty table stays empty."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in three documents or more go, but in the document with the largest id that has them.

    Every row stays. A null text stays null; repeated rows count as one document; a null id never is the largest.
    """
    return drop_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the least id, by shingles of five words and a similarity of 0.8.

    Null, empty and wordless texts stay, as they are linked with nothing; so do repeated rows of an id that stays.
    """
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every row stays, null and empty texts as they are."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows of 1024, one row per piece; null texts are empty and have the end token alone."""
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near copies", near_copies), ("secret scan", secrets), ("packing", packing)]

#: Packing by fill levels and forests can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
