"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import staging

#: A table may be broadcast when it has at most this many rows (narrow rows: some tens of MB).
BROADCAST_ROWS = 500_000

#: The byte budget of one Arrow batch on its way to a Python worker.
ARROW_BATCH_BYTES = 8 << 20


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` written into the shared folder and read back; most tables here are worth packing well."""
    return staging.staged(df, name, codec)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if a count shows that it has at most `rows` rows; otherwise as it is, for a shuffled join."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the batches that go to Python by bytes and by rows, so that very long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once: a lambda over a one-element array binds it."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that don't clash with the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
