"""Readers with explicit schemas for the file layouts of a text corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas are stated, never inferred.
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PADS = "mode string, id int, title string, section string, subtopic string, raag string, taal string, form string, headings array<string>, verses array<string>, footnotes array<struct<marker:string,lines:array<string>>>, footnote_refs array<struct<owner_id:int,note_index:int>>, search_number int, has_search_number boolean"
SECTIONS = "name string, start_id int, end_id int, parent string"
OCR_WORDS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
SPANS = f"page int, raw string, text string, bbox {BOX}, baseline double, font string, font_size double"
ASSETS = "id int, file string, original_file string, bytes long, duration double, sha256 string"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def proof_pages(spark: SparkSession, glob: str, page_schema: str) -> DataFrame:
    """The pages of all files {pages: [...]} that a glob names, with their file and place in it (file, page_no); files that
    can't be parsed are left out."""
    d = spark.read.schema(f"pages array<struct<{page_schema}>>, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(glob)
    return d.filter("_corrupt is null").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.posexplode("pages").alias("page_no", "p")).select("file", "page_no", "p.*")


def keyed_chunks(spark: SparkSession, glob: str, value_schema: str) -> DataFrame:
    """key, value of files that hold one object by key; a key in two files fails."""
    d = spark.read.text(glob, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "value"))
    d = d.groupBy("key").agg(F.count("*").alias("_n"), F.first("value").alias("value"))
    twice = F.raise_error(F.concat(F.lit("a key in two files: "), F.col("key"))).cast("string")
    return d.select(F.when(F.col("_n") > 1, twice).otherwise(F.col("key")).alias("key"), "value")


def ocr_words(spark: SparkSession, glob: str) -> DataFrame:
    """Word rows of recognition tables; the page is the number in the file's name. Quotes are ordinary characters."""
    d = spark.read.csv(glob, sep="\t", header=True, quote="", schema=OCR_WORDS)
    page = F.regexp_extract("_metadata.file_path", r"(\d+)\.tsv$", 1).cast("int")
    return d.withColumn("page", page).filter((F.col("level") == 5) & (F.trim("text") != ""))


def sectioned(spark: SparkSession, path: str, heading: str = r"## +(\d+) +· +(.+)") -> DataFrame:
    """number, title, block_no, line_no, text of a text file with headings (a number and, if the pattern has it, a title); blank lines part blocks."""
    groups = heading.count("(") - heading.count("(?")
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.explode(F.split(F.replace(F.col("value"), F.lit("\r\n"), F.lit("\n")), rf"(?m)^(?={heading}\s*$)")).alias("part"))
    head = rf"(?m)\A{heading}\s*$"
    d = parts.filter(F.col("part").rlike(head)).select(F.regexp_extract("part", head, 1).cast("int").alias("number"), (F.regexp_extract("part", head, 2) if groups > 1 else F.lit(None).cast("string")).alias("title"), F.regexp_replace("part", r"\A[^\n]*\n?", "").alias("body"))
    blocks = F.filter(F.split("body", r"\n[ \t]*\n\s*"), lambda b: F.trim(F.regexp_replace(b, r"\s+", "")) != "")
    d = d.select("number", "title", F.posexplode(blocks).alias("block_no", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    return d.select("number", "title", "block_no", F.posexplode(lines).alias("line_no", "text"))


def body_spans(spans: DataFrame, size: float = 12.0, slack: float = 0.2) -> DataFrame:
    """Spans of lines (page, baseline) that are set in one font size throughout, in reading order."""
    ok = F.abs(F.col("font_size") - size) < slack
    bad = spans.filter(~F.coalesce(ok, F.lit(False))).select("page", "baseline").distinct()
    return spans.join(bad, ["page", "baseline"], "left_anti").orderBy("page", "bbox.y0", "bbox.x0")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of each file that isn't empty (Spark lists no empty ones)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def pages_to_do(listed: DataFrame, done: DataFrame, key: str = "page") -> DataFrame:
    """Pages without an output that isn't empty."""
    return listed.join(done.filter("length > 0").select(key), key, "left_anti")


BINARY = "path string, modificationTime timestamp, length long, content binary"


def page_of(path: Column) -> Column:
    """A file's name without its ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?\z", 1)


def ingest(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, most_files: int = 1000) -> None:
    """Turn each file of a folder into a row of `out` (page, text), once: a stream takes up the files that came since the last
    run, its checkpoint tells which. Pages whose output is missing or empty are done again after that. `work` gets page and
    content, and gives page and text; a batch that is run again writes the same."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", most_files).load(folder)

    def write(batch: DataFrame, n: int) -> None:
        work(batch.select(page_of(F.col("path")).alias("page"), "content")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    listed = spark.read.format("binaryFile").load(folder).select(page_of(F.col("path")).alias("page"), "content")
    if not listed.isEmpty():
        again = pages_to_do(listed, ingested(spark, out).withColumn("length", F.length("text")))
        work(again).write.mode("append").parquet(f"{out}/batch=-1")


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """page, text: of each page the longest output, as one that was empty was done again."""
    d = spark.read.schema("page string, text string, batch long").option("basePath", out).parquet(out)
    return d.groupBy("page").agg(F.max_by("text", F.coalesce(F.length("text"), F.lit(0))).alias("text"))
