"""Sections as id ranges, their bounds and tiling, and neighbours in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import carried

#: Ids of one bucket of the range join; a section is listed in each bucket that it reaches into.
BUCKET = 1000


def range_join(entries: DataFrame, sections: DataFrame, bucket: int = BUCKET, how: str = "left") -> DataFrame:
    """entries (id) with each section (name, start_id, end_id) that holds the id: an equi-join on id buckets, then the exact test."""
    s = sections.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_id") / bucket), F.floor(F.col("end_id") / bucket))))
    e = entries.withColumn("_b", F.floor(F.col("id") / bucket))
    return e.join(s, (e["_b"] == s["_b"]) & e["id"].between(s["start_id"], s["end_id"]), how).drop("_b")


def not_exactly_one(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """id, n: entries that lie in no section, or in several."""
    return range_join(entries.select("id"), sections).groupBy("id").agg(F.count("name").alias("n")).filter("n != 1")


def coverage_violations(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """id, kind, n: entries that don't lie in exactly one main section (kind "section"; parent is null), or, where that section
    has any subsections, not in exactly one of these ("subsection"). n is in how many they lie."""
    main, sub = sections.filter("parent is null"), sections.filter("parent is not null")
    held = range_join(entries.select("id"), main.select("name", "start_id", "end_id")).select("id", "name")
    n_main = held.groupBy("id").agg(F.count("name").alias("n"), F.min("name").alias("name"))
    wrong = n_main.filter("n != 1").select("id", F.lit("section").alias("kind"), "n")
    split = n_main.filter("n = 1").join(sub.select(F.col("parent").alias("name")).distinct(), "name", "left_semi").select("id", F.col("name").alias("_main"))
    inside = range_join(split, sub.select("name", "parent", "start_id", "end_id")).select("id", "_main", "parent")
    n_sub = inside.groupBy("id").agg(F.count_if(F.col("parent") == F.col("_main")).alias("n"))
    return wrong.unionByName(n_sub.filter("n != 1").select("id", F.lit("subsection").alias("kind"), "n"))


def tiling_gaps(sections: DataFrame, parent: str) -> DataFrame:
    """parent, name, end_id, next_start, gap: where a section doesn't start right after the one before (overlaps are negative)."""
    w = Window.partitionBy(parent).orderBy("start_id", "end_id")
    d = sections.withColumn("next_start", F.lead("start_id").over(w))
    return d.withColumn("gap", F.col("next_start") - F.col("end_id") - 1).filter("gap != 0").select(parent, "name", "end_id", "next_start", "gap")


def bounds(entries: DataFrame, section: str, pos: str, shown: str) -> DataFrame:
    """section, first_shown, last_shown: the number shown on the first and the last entry of each section."""
    return entries.groupBy(section).agg(F.min_by(shown, pos).alias("first_shown"), F.max_by(shown, pos).alias("last_shown"))


def headers(entries: DataFrame, mode: str, pos: str, label: str) -> DataFrame:
    """entries with show_header: whether the label differs from the entry before. A mode may be as large as the table."""
    d = carried(entries, [mode], [pos], F.struct(F.col(label).alias("label")), "_before")
    first = F.col("_before").isNull()
    return d.withColumn("show_header", F.col(label).isNotNull() & (first | ~F.col(label).eqNullSafe(F.col("_before.label")))).drop("_before")


def neighbours(entries: DataFrame, mode: str, pos: str, key: str) -> DataFrame:
    """entries with the keys of the previous and the next entry; the ends meet. A mode may be as large as the table."""
    d = carried(entries, [mode], [pos], F.struct(F.col(key).alias("key"), F.col(pos).alias("pos")), "_prev")
    # whom each entry is the next of
    back = d.filter("_prev is not null").select(F.col(mode).alias("_m"), F.col(key).alias("_next"), F.col("_prev.pos").alias("_of"))
    ends = entries.groupBy(mode).agg(F.max_by(key, pos).alias("_end"), F.min_by(key, pos).alias("_start"))
    d = d.join(back.withColumn("_there", F.lit(True)), F.col(mode).eqNullSafe(F.col("_m")) & (F.col(pos) == F.col("_of")), "left").drop("_m", "_of")
    d = d.join(ends.withColumnRenamed(mode, "_m"), F.col(mode).eqNullSafe(F.col("_m")), "left")
    return d.withColumns({"prev_key": F.when(F.col("_prev").isNull(), F.col("_end")).otherwise(F.col("_prev.key")), "next_key": F.when(F.col("_there"), F.col("_next")).otherwise(F.col("_start"))}).drop("_prev", "_next", "_there", "_m", "_end", "_start")


def numeric_order(key: str) -> list:
    """Sort keys for names with numbers: the name before the number, then the number's value."""
    return [F.regexp_extract(key, r"^(.*?)(\d*)$", 1), F.regexp_extract(key, r"(\d*)$", 1).try_cast("long"), F.col(key)]
