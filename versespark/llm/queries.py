"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_wrappers, line_dedup, mixing, near_dup, permutation_index, quality, resampling, sql, substring_dedup, toxicity, url_filter, warc, whitening
from .url_labels import labelled_urls

Query = Callable[[SparkSession, str], DataFrame]

#: The prefix rules of the URL query, and whether each blocks.
URL_RULES = [
    url_filter.Rule("org/", False),
    url_filter.Rule("example.org/es/", True),
    url_filter.Rule("example.org/en/1", True),
    url_filter.Rule("com/fr/", False),
    url_filter.Rule("com/de/", True),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    removed = n_bytes - F.octet_length("kept")
    return df.select("doc_id", n_bytes.alias("n_bytes"), removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = html_wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", near_dup.kept(found).alias("kept"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = bpe.encode_decode(docs, tokenizer_path())
    return df.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: Target shares of tokens; categories that aren't named share the rest by their tokens.
MIX = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "source": {"src0": 0.15}, "topic": {"prose": 0.9}}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, MIX).select("doc_id", "mix.topic", "mix.tokens", F.round("mix.weight", 6).alias("weight"), F.round("mix.probability", 6).alias("probability"), "mix.converged", "mix.drawn")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(labelled_urls(spark))
    return url_filter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, keep=["doc_id"]).select("row.doc_id", *quality.MEASURES, "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    history = warc.with_positions(warc.merge_index(warc.read_warc(spark, folder)))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "history_pos")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = line_dedup.dedup_lines(docs, removed="n_removed")
    return df.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("kept_bytes"), "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = resampling.resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return df.select("doc_id", "n_features", "weight", "score", "rank")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = toxicity.fold(F.col("doc_id")) == 0
    lexicon = toxicity.learn(docs, labels.filter(~held_out))
    score = F.col("toxicity.score")
    return toxicity.judge(docs, lexicon).select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.size("toxicity.hits").alias("n_hits"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_permutation_index, op3_html_wrappers, op4_near_dedup, op5_bpe_round_trip, op6_mixing, op7_url_filter, op8_quality_rules, op9_warc, op10_line_dedup, op11_whitening, op12_resampling, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    """The others are approximate, trained, or too slow in SQL on whole tables; tests/llm holds them against brute force."""
    return {"op6_mixing": sql.mixing_sql(MIX), "op8_quality_rules": sql.QUALITY, "op9_warc": sql.CAPTURES, "op10_line_dedup": sql.LINES, "op12_resampling": sql.RESAMPLING}
