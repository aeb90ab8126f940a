"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Lines with a word are numbered and hashed (128 bits). Two kinds of window are laid over a document: the shortest run of
lines from each line on with at least `min_words` words, and the shortest one up to each line. What is in a window
depends on its lines alone, so a passage of `min_words` words or more that stands in two places has the same windows
in both. Of each window the line with the smallest hash is selected: these minima are the fingerprints. Any two equal
windows select the same line, so positions are joined on fingerprints that were selected in two places, and only
windows over those are compared as a whole. A match is then as long as its overlapping windows reach: those up to a
line extend it to the right, and those from a line on extend it to the left. Every run that stands earlier in the
corpus (by document id, then line) is deleted; the earliest one stays.

Repeated lines of less than `min_words` words in a row stay, wherever they stand. Blank lines between two deleted
lines of a run go with them.

Counts are summed before shuffles and the earliest place is a minimum, so a very frequent passage costs no task more
than another. The earliest places are written before windows are joined to them: few of them are broadcast, many are
an ordinary equi-join, whose hot keys adaptive execution splits.

Defined results: a null or empty text stays as it is; documents are never dropped, a document of which all is repeated
keeps an empty text; rows with the same id and text are one document and get the same text; a null id comes after all
ids; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, small_enough, staged

MIN_WORDS = 50
SPACE = r"\x20\x09-\x0D"

#: Deleted runs may be broadcast up to so many documents and runs.
BROADCAST_DOCS, BROADCAST_RUNS = 100_000, 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, th (hash of the text), line, h1, h2, words for each line with a word."""
    d = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("t"))
    d = d.select("id", "th", F.posexplode(lines_of(F.col("t"))).alias("line", "x"))
    d = d.select("id", "th", "line", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"), F.regexp_count("x", F.lit(f"[^{SPACE}]+")).cast("long").alias("words"))
    return d.filter("words > 0")


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """id, th, first and last line, w1 and w2 (hash of the lines), a1 and a2 (hash of the selected line), at (its place)."""
    by = Window.partitionBy("id", "th")
    # words before a line, and up to a line: a window is a range of either
    order = by.orderBy("line")
    d = lines.dropDuplicates(["id", "th", "line"]).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("before", F.col("upto") - F.col("words"))
    kinds = []
    for name, frame in (("on", by.orderBy("before").rangeBetween(0, min_words - 1)), ("back", by.orderBy("upto").rangeBetween(1 - min_words, 0))):
        hashes = F.collect_list(F.struct("h1", "h2")).over(frame)
        least = F.min(F.struct("h1", "h2", "line")).over(frame)
        kinds.append(F.struct(F.min("line").over(frame).alias("first"), F.max("line").over(frame).alias("last"), F.sum("words").over(frame).alias("n"), F.xxhash64(hashes).alias("w1"), F.xxhash64(F.lit(1), hashes).alias("w2"), least.alias("least")).alias(name))
    d = d.select("id", "th", *kinds).select("id", "th", F.inline(F.array("on", "back")))
    return d.filter(F.col("n") >= min_words).select("id", "th", "first", "last", "w1", "w2", F.col("least.h1").alias("a1"), F.col("least.h2").alias("a2"), F.col("least.line").alias("at"))


def _place(line: str) -> Column:
    """A position of the corpus that sorts: null ids last."""
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("th").alias("th"), F.col(line).alias("line"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, th, runs: for each document with a repeated run, the array of the windows (first and last line) that stand earlier."""
    windows = staged(_windows(_numbered(docs, doc_id, text), min_words), "line-windows")
    twice = lambda c: (F.min(c) != F.max(c)).alias("twice")
    joined = windows.groupBy("a1", "a2").agg(twice(_place("at"))).filter("twice").drop("twice")
    found = windows.join(small_enough(staged(joined, "line-fingerprints")), ["a1", "a2"], "left_semi")
    first = found.groupBy("w1", "w2").agg(F.min(_place("first")).alias("earliest"), twice(_place("first"))).filter("twice").drop("twice")
    # written first: a join to an aggregate on its own key could not split a very frequent passage
    later = found.join(small_enough(staged(first, "line-passages")), ["w1", "w2"]).filter(_place("first") != F.col("earliest"))
    return later.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """`docs` with the text column without its repeated runs; `removed` names a column for the number of deleted lines."""
    runs = staged(repeated_runs(docs, min_words, doc_id, text), "line-runs")
    key, rid, gone = fresh(docs, "line_key", "line_runs", "line_gone")
    size = runs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("runs")).first()
    runs = runs.select(F.struct(F.col("id").alias("id"), F.col("th").alias("th")).alias(key), F.col("runs").alias(rid))
    if size["docs"] <= BROADCAST_DOCS and size["runs"] <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    d = docs.withColumn(key, F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th")))
    d = d.join(runs, key, "left")
    flagged = F.transform(lines_of(F.col(text)), lambda x, i: F.struct(x.alias("x"), F.exists(F.col(rid), lambda r: (r["first"] <= i) & (i <= r["last"])).alias("gone")))
    d = d.withColumn(gone, F.when(F.col(rid).isNotNull(), flagged))
    kept = F.array_join(F.transform(F.filter(F.col(gone), lambda v: ~v["gone"]), lambda v: v["x"]), "\n")
    out = {text: F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)}
    if removed:
        out[removed] = F.coalesce(F.size(F.filter(F.col(gone), lambda v: v["gone"])), F.lit(0)).cast("long")
    return d.withColumns(out).select(*docs.columns, *([removed] if removed else []))
