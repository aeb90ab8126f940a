"""Scans in order that don't put a key, or all rows, into one task.

Rows are dealt by ranges of key and order, so a hot key is spread over as many tasks as its rows are worth, and are written
with the number of their range. Each range is scanned on its own; what a scan carries from range to range (a count, or the
last value of a key that reaches over several ranges) is one row for a range and key, is carried on over these rows, and
joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

PART = "_part"
#: So many rows of a join, window or sort are one task's share.
ROWS = 500_000


def tasks_for(*tables: DataFrame) -> int:
    """How many tasks the rows of tables that meet in a join, or are sorted, are dealt to: spark.sql.shuffle.partitions, or
    more, so that the rows of a task, and what it holds of them in memory, don't grow with the tables."""
    rows = max(d.count() for d in tables)
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def shared_out(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """`df` dealt by keys to as many tasks if they are more than Spark's own; else as it is, as Spark may know better."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def dealt(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """`df` with `_part`: the number of the range of keys and order that a row is in. Rows that tie are in the same one."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()), "scan-ranges")


def numbered(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """`df` with the place of each row, from 1, in the order of all rows."""
    d = dealt(df, [], order, parts)
    # one row for each range
    sizes = d.groupBy(PART).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(PART))
    starts = sizes.select(PART, (upto - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(PART).orderBy(*order)) + F.col("_before")
    return d.join(F.broadcast(starts), PART).withColumn(name, place).drop(PART, "_before")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, own: bool = False, parts: int | None = None) -> DataFrame:
    """`df` with the last value that isn't null before each row of its key, in the given order; with `own`, up to the row
    itself. Wrap a value in a struct to carry nulls. `order` should leave no ties."""
    d = dealt(df.withColumn("_v", value), keys, order, parts)
    w = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    there = F.col("_v").isNotNull()
    last = d.groupBy(*keys, PART).agg(F.max_by(F.when(there, F.col("_v")), F.when(there, F.struct(*order))).alias("_last"))
    # keys in more than one range: two rows for each range at most, its first key and its last
    over = Window.partitionBy(*keys)
    several = last.withColumn("_n", F.count("*").over(over)).filter("_n > 1")
    into = several.select(F.struct(*[F.col(k) for k in keys]).alias("_k"), F.col(PART).alias("_p"), F.last("_last", ignorenulls=True).over(over.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)).alias("_into")).filter("_into is not null")
    d = d.withColumn("_local", F.last("_v", ignorenulls=True).over(w))
    same = (F.col(PART) == F.col("_p")) & F.struct(*[F.col(k) for k in keys]).eqNullSafe(F.col("_k"))
    return d.join(F.broadcast(into), same, "left").withColumn(name, F.coalesce("_local", "_into")).drop(PART, "_v", "_local", "_k", "_p", "_into")
