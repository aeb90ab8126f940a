"""The corpus pipeline: raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written as Parquet in the shared folder and read again, so a lost executor costs no more than its
tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versespark.llm import bpe, line_dedup, mixing, near_dup, quality
from versespark.llm.common import staged
from versespark.llm.queries import MIX, tokenizer_path

#: The expected share of tokens that mixing draws.
BUDGET = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source."""
    return quality.passed(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the runs of lines that stand earlier in the corpus."""
    df = line_dedup.dedup_lines(docs)
    return df.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return near_dup.drop_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that tokens follow the target shares of languages, sources and topics."""
    return mixing.mix(docs, MIX, BUDGET).filter("mix.drawn").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each document, and whether they decode to its text."""
    df = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return df.select("doc_id", "lang", "source", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Near-dedup and BPE can't be stated in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
