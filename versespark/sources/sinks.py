"""Writers: the same rows give the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus(df: DataFrame, path: str, order: list[str], partitions: int = 16) -> None:
    """JSON lines in order: ranges of the order, sorted within."""
    df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def chunked(df: DataFrame, path: str, key: str = "id", size: int = 100) -> None:
    """Folders of `size` ids each (chunk = (id - 1) div size + 1), so that a reader opens one of them."""
    chunk = (F.floor((F.col(key) - 1) / size) + 1).cast("int")
    df.withColumn("chunk", chunk).repartition("chunk").sortWithinPartitions(key).write.mode("overwrite").partitionBy("chunk").parquet(path)


def read_chunk(spark, path: str, key: str, value: int, size: int = 100) -> DataFrame:
    """The rows of one id; only its chunk is read."""
    return spark.read.parquet(path).filter((F.col("chunk") == (value - 1) // size + 1) & (F.col(key) == value)).drop("chunk")


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(lines: DataFrame, section: str, entry: str, order: str, text: str) -> DataFrame:
    """section, markdown: a heading for each section and entry, then its lines."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    d = lines.groupBy(section, entry).agg(body.alias("_b"))
    d = d.withColumn("_b", F.concat(F.lit("### "), F.col(entry).cast("string"), F.lit("\n\n"), F.col("_b")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(entry, "_b"))), lambda x: x["_b"]), "\n\n")
    return d.groupBy(section).agg(F.concat(F.lit("## "), F.first(F.col(section).cast("string")), F.lit("\n\n"), whole).alias("markdown"))


def audit(counts: DataFrame, exceptions: dict[str, DataFrame], path: str) -> None:
    """A row of counts, and a folder for each kind of exception."""
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    for name, rows in exceptions.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def checksums(files: DataFrame) -> DataFrame:
    """path, sha256 of a folder's files in order."""
    return files.select("path", F.sha2("content", 256).alias("sha256")).orderBy("path")
