"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-versespark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staging_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str, codec: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Write `df` as Parquet and read it back: it is computed once, however often it is used, and survives lost executors.
    With `by`, files lie in folders by these columns, so filters on them decide what is read."""
    path = f"{staging_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def there(df: DataFrame) -> bool:
    """Whether the files of a staged table are still there."""
    context = df.sparkSession.sparkContext
    paths = [context._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    return all(p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p) for p in paths)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Results that were not written or collected yet are lost with them."""
    jvm, folder = spark.sparkContext._jvm, staging_dir(spark)
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
