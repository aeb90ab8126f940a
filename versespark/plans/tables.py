"""The given tables, and what queries make of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..sources import staging

#: The search index of each application and state of the documents: built once, asked by all searches.
_INDEXES: dict[tuple, tuple] = {}
#: The distinct words of documents, for batches that are asked once.
_WORDS: dict[tuple, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as searchable entries: the first line is the title, all lines are verses, language is the collection."""
    d = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    meta = {c: none for c in ("subtopic", "raag", "taal", "form")}
    return d.select(F.col("lang").alias("mode"), F.col("doc_id").alias("id"), F.get(lines, F.lit(0)).alias("title"), F.col("source").alias("section"), *[v.alias(k) for k, v in meta.items()], empty.alias("headings"), lines.alias("verses"), empty.alias("notes"), F.col("doc_id").alias("search_number"))


def _kept(kept: dict[tuple, tuple], build: Callable[[DataFrame], S.Index], spark: SparkSession, sf_dir: str) -> S.Index:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet").select("path", "modificationTime", "length")
    state = files.agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in kept or kept[key][0] != state or not all(map(staging.there, kept[key][1].tables)):
        kept[key] = (state, build(pads(spark, sf_dir)))
    return kept[key][1]


def index_of(spark: SparkSession, sf_dir: str) -> S.Index:
    """The documents' search index. It is built again if a file of the table is another, or newer, or of another length, or
    if the index's own files are gone."""
    return _kept(_INDEXES, S.build_index, spark, sf_dir)


def words_of(spark: SparkSession, sf_dir: str) -> S.Index:
    """The same for batches that are asked once: the words of documents only, which cost a fraction of an index."""
    return _kept(_WORDS, S.scan_index, spark, sf_dir)


def release(spark: SparkSession) -> None:
    """Delete what queries of this application left in the shared folder; indexes are built again when they are asked for."""
    _INDEXES.clear()
    _WORDS.clear()
    staging.release(spark)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line (from 0), text: the lines of documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


#: The same in SQL.
LINES_SQL = "select doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1))::int as line, unnest(string_split(text, chr(10))) as text from documents where text is not null"


def first_words(spark: SparkSession, sf_dir: str, n: int, quoted: bool = False) -> DataFrame:
    """query_id, query: the first words of each benchmark item."""
    b = table(spark, sf_dir, "benchmark")
    q = F.array_join(F.slice(F.split("text", " "), 1, n), " ")
    return b.select(F.col("item_id").alias("query_id"), (F.concat(F.lit('"'), q, F.lit('"')) if quoted else q).alias("query"))
