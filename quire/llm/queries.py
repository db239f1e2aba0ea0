"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.exact_dedup import exact_dedup
from quire.llm.html_content import main_text
from quire.llm.line_dedup import line_dedup
from quire.llm.minhash import near_duplicates
from quire.llm.mixing import mix
from quire.llm.packing import pack
from quire.llm.periodic_runs import looped, periodic_runs, run_digests
from quire.llm.quality_rules import quality_rules
from quire.llm.repair_turns import damaged, repair_digests
from quire.llm.repeats import remove_repeats
from quire.llm.secrets import scan_secrets
from quire.llm.sentencepieces import decode_pieces, sample_pieces
from quire.llm.warc import archive_folder, read_warc, write_warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("row")


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled ids, and the digest of what they decode to."""
    return decode_pieces(sample_pieces(table(spark, sf_dir, "documents"))).drop("text")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(looped(table(spark, sf_dir, "documents"))))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mix(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_digests(damaged(turns), turns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_repeated_substrings": op6_repeated_substrings,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_html_extraction": op8_html_extraction,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_mixing": op12_source_mixing,
    "op13_conversation_repair": op13_conversation_repair,
}
