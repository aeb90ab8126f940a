"""Lines on pages: boxes, gaps, medians and running positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_boxes(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, x0, y0, x1, y1, text, confidence: words (left, top, width, height, conf, text) as lines; halves round to even."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda w: w["text"]), " ")
    return words.groupBy(*keys).agg(F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"), text.alias("text"), F.bround(F.avg("conf"), 1).alias("confidence"))


def page_bounds(lines: DataFrame, entry: str, page: str) -> DataFrame:
    """entry, left, right, span per page, and the widest span of the entry's pages (1 at least)."""
    d = lines.groupBy(entry, page).agg(F.min("x0").alias("left"), F.max("x1").alias("right"))
    return d.withColumn("widest", F.greatest(F.lit(1.0), F.max(F.col("right") - F.col("left")).over(Window.partitionBy(entry))))


def upper_median(x: str, default: float) -> Column:
    """The upper of the two middle values of a group; the default for a group without values."""
    s = F.sort_array(F.collect_list(x))
    return F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(default))


def gaps(lines: DataFrame, entry: str, page: str, order: str, y: str) -> DataFrame:
    """lines with gap: the distance from the line before on the same page, if it is positive."""
    w = Window.partitionBy(entry).orderBy(order)
    gap = F.col(y) - F.lag(y).over(w)
    return lines.withColumn("gap", F.when((F.lag(page).over(w) == F.col(page)) & (gap > 0), gap))


def running_y(lines: DataFrame, entry: str, order: str, step: Column, top: float = 0.0) -> DataFrame:
    """lines with y: the sum of the steps up to them."""
    w = Window.partitionBy(entry).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("y", F.lit(top) + F.sum(step).over(w))


def layout_steps(lines: DataFrame, entry: str, page: str, order: str, y: str, role: str, stanza: str, leading: float, least: float, stanza_gap: float, role_gap: float) -> DataFrame:
    """lines with step: the source gap on the same page, `leading` across pages, at least `least`, more at a new role or stanza."""
    w = Window.partitionBy(entry).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    first = F.row_number().over(w) == 1
    gap = F.when(before(page) == F.col(page), F.greatest(F.col(y) - before(y), F.lit(least))).otherwise(F.lit(leading))
    more = F.when(before(role) != F.col(role), role_gap).when(before(stanza) != F.col(stanza), stanza_gap).otherwise(0.0)
    return lines.withColumn("step", F.when(first, 0.0).otherwise(gap + more))


def out_of_order(lines: DataFrame, entry: str, order: str, y: str) -> DataFrame:
    """Lines that don't stand below the line before them."""
    return lines.withColumn("_y", F.lag(y).over(Window.partitionBy(entry).orderBy(order))).filter(F.col(y) <= F.col("_y")).drop("_y")


def fit(width: Column, height: Column, max_width: Column, max_height: Column) -> Column:
    """The factor that fits a box into a slot and keeps its shape."""
    return F.least(max_width / width, max_height / height)


def text_scale(widths: DataFrame, entry: str, width: str, room: float) -> DataFrame:
    return widths.groupBy(entry).agg(F.least(F.lit(1.0), F.lit(room) / F.max(width)).alias("scale"))


def placement(lines: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """lines with inset, extent and centred (shares of the bounds' width)."""
    d = lines.join(bounds.select(*keys, "left", "right"), keys)
    width = F.greatest(F.col("right") - F.col("left"), F.lit(1.0))
    inset, extent = (F.col("x0") - F.col("left")) / width, (F.col("x1") - F.col("x0")) / width
    mid = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("left") + F.col("right")) / 2) / width
    return d.withColumns({"inset": inset, "extent": extent, "centred": (extent < 0.8) & (mid < 0.045)})


def low_confidence(words: Column, least: float = 65) -> Column:
    """Whether a word (with a field conf) of a line is doubtful."""
    return F.exists(words, lambda w: w["conf"] < least)


def fragment_rows(fragments: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, x0, y0, x1, y1 (the union of the fragments' boxes), gaps (between neighbours from left to right) and text."""
    d = fragments.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x0", "x1", F.trim(text).alias("t")))).alias("_f"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    pairs = F.zip_with(F.slice("_f", F.lit(2), F.size("_f")), F.slice("_f", F.lit(1), F.size("_f") - 1), lambda b, a: F.round(b["x0"] - a["x1"], 3))
    return d.select(*keys, "x0", "y0", "x1", "y1", pairs.alias("gaps"), F.array_join(F.transform("_f", lambda f: f["t"]), " ").alias("text"))


# The common width of pages, and which measures follow it.
PAGE_WIDTH = 288
MEASURES = ["x", "y", "width", "height", "fontSize", "length", "fitWidth", "textWidth"]


def at_common_width(items: DataFrame, width: str) -> DataFrame:
    """items with those of their columns that are measures scaled to pages of the common width."""
    return items.withColumns({c: F.col(c) * (PAGE_WIDTH / F.col(width)) for c in items.columns if c in MEASURES})
