"""Streams of review events, queries and progress.

The order of events is (ts, event_id). State is kept by key in the RocksDB state store, which keeps what doesn't fit in
memory on disk, uploads what a batch changed to the checkpoint, and deletes old versions by itself. It is as large as the
number of keys; a watermark would bound it by forgetting old keys, which none of these may do. `state_of` reads it back
as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATUSES = ["pending", "issue", "verified"]
MOST_COMMENT = 100_000


def valid(events: DataFrame, statuses: list[str] = STATUSES):
    """A predicate on review events: a known status and a comment that isn't too long."""
    return F.col("status").isin(statuses) & (F.length(F.coalesce("comment", F.lit(""))) <= MOST_COMMENT)


def stamped(reviews: DataFrame, viewport: str = "viewport") -> DataFrame:
    """reviews as they are stored: the viewport (a struct; null: empty) as JSON, and when it is written, in UTC."""
    return reviews.withColumns({viewport: F.coalesce(F.to_json(viewport), F.lit("{}")), "updated": F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())})


def latest(events: DataFrame, key: str) -> DataFrame:
    """The last event of each key: a partial maximum before the shuffle."""
    cols = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*cols), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(last.alias("_e")).select(key, "_e.*")


def merged(state: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """State with a batch of events taken in, whatever order they come in."""
    return latest(state.unionByName(batch.select(*state.columns)), key)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How a row is kept in the state: as JSON, with all of a time's digits.
JSON = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class KeepGreatest(StatefulProcessor):
    """For each key the row with the greatest (first, second). A batch's rows may come in any order; a key is given out when
    its row has changed, and rows that aren't `good` are given out as they are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "first long, second long, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get() if self.last.exists() else None
        best = known
        for batch in rows:
            bad = batch[~batch["good"]]
            if len(bad):
                yield pd.DataFrame({"key": bad["key"], "good": False, "row": bad["row"]})
            for row in batch.loc[batch["good"], ["first", "second", "row"]].itertuples(index=False, name=None):
                if best is None or (int(row[0]), int(row[1])) > (best[0], best[1]):
                    best = (int(row[0]), int(row[1]), row[2])
        if best is not known:
            self.last.update(best)
            yield pd.DataFrame({"key": [key[0]], "good": [True], "row": [best[2]]})

    def close(self) -> None:
        pass


def greatest_by_key(events: DataFrame, key: str, first: Column, second: Column, good: Column) -> DataFrame:
    """A stream of `events` (the key among them) that were taken in as the greatest of their key, or aren't good, with `good`."""
    schema = events.schema
    d = events.select(F.col(key).alias("key"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(first, F.lit(0)).cast("long").alias("first"), F.coalesce(second, F.lit(0)).cast("long").alias("second"), F.to_json(F.struct(*events.columns), JSON).alias("row"))
    out = d.groupBy("key").transformWithStateInPandas(KeepGreatest(), f"key {schema[key].dataType.simpleString()}, good boolean, row string", "update", "none")
    return out.select("good", F.from_json("row", schema.simpleString(), JSON).alias("e")).select("good", "e.*")


def state_of(spark: SparkSession, checkpoint: str, schema: str) -> DataFrame:
    """The rows that a stream keeps by key, read from its checkpoint."""
    d = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    return d.select(F.from_json("value.row", schema, JSON).alias("e")).select("e.*")


def upsert_stream(events: DataFrame, key: str, changes_path: str, rejects_path: str, checkpoint: str, statuses: list[str] = STATUSES):
    """A streaming query that keeps the last valid event of each key in its state (read by state_of), and writes a batch's
    changes and what is invalid to folders of its own. A batch that is run again writes the same."""
    order = F.unix_micros(F.col("ts")), F.col("event_id")
    d = greatest_by_key(events, key, *order, valid(events, statuses) & F.col(key).isNotNull())

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        batch.filter("good").drop("good").write.mode("overwrite").parquet(f"{changes_path}/batch={n}")
        batch.filter("not good").drop("good").write.mode("overwrite").parquet(f"{rejects_path}/batch={n}")
        batch.unpersist()

    with rocksdb(events.sparkSession):
        return d.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest_query(requests: DataFrame, session: str = "session") -> DataFrame:
    """The last query of each session (request_id, query); earlier ones are dropped before any search."""
    return requests.groupBy(session).agg(F.max("request_id").alias("request_id"), F.max_by("query", "request_id").alias("query"))


def newest_only_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, session: str = "session"):
    """Each micro-batch answers the last query of each session; requests older than one seen before are left out."""
    d = greatest_by_key(requests, session, F.col("request_id"), F.lit(0), F.col(session).isNotNull()).filter("good").drop("good")

    def write(batch: DataFrame, n: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/answers/batch={n}")

    with rocksdb(requests.sparkSession):
        return d.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def progress_stream(events: DataFrame, active: DataFrame, path: str, checkpoint: str):
    """Progress of active requests (a table) as it comes, appended to `path`."""
    return progress(events, active).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame, active: DataFrame) -> DataFrame:
    """Progress of active requests (request_id): at most 0.99 until an event says that it is complete; 0 of an unknown total."""
    share = F.coalesce(F.try_divide(F.col("bytes").cast("double"), F.col("total")), F.lit(0.0))
    return events.join(active, "request_id").withColumn("progress", F.when(F.col("complete"), 1.0).otherwise(F.least(F.lit(0.99), share)))


def progress_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def next_pending(state: DataFrame, key: str, after: int) -> DataFrame:
    return state.filter((F.col("status") == "pending") & (F.col(key) > after)).agg(F.min(key).alias(key))


def last_in_order(events: DataFrame, key: str) -> DataFrame:
    """events with is_last, for tables that keep all of them."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("is_last", F.row_number().over(w) == 1)
