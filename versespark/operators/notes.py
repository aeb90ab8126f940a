"""Notes: whose they are, who refers to them, and taking their lines out of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import carried, shared_out, tasks_for
from .search import small


def resolved_refs(pads: DataFrame, notes: DataFrame, refs: DataFrame) -> DataFrame:
    """id, owner_id, note_index, marker: the notes that an entry refers to, or its own if it refers to none. References to
    notes that don't exist are dropped. Tables are dealt to tasks whose share doesn't grow with them."""
    tasks = tasks_for(pads, notes, refs)
    keys = ["owner_id", "note_index"]
    # Spark joins by owner_id alone where note_index is a constant, and by both else: one side is dealt for either
    named = shared_out(refs, keys[:1], tasks).join(shared_out(notes, keys, tasks), keys).select("id", "owner_id", "note_index", "marker")
    own = shared_out(pads.select("id"), ["id"], tasks).join(shared_out(refs.select("id"), ["id"], tasks), "id", "left_anti")
    own = own.join(shared_out(notes, ["owner_id"], tasks), F.col("id") == F.col("owner_id"))
    return named.unionByName(own.select("id", "owner_id", "note_index", "marker"))


def shared_with(resolved: DataFrame) -> DataFrame:
    """owner_id, note_index, ids: who shares a note, in order."""
    return resolved.groupBy("owner_id", "note_index").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def refs_per_target(notes: DataFrame) -> DataFrame:
    """id, refs (owner_id, note_index, marker in order): notes turned round to the entries that they are for; the owner by default."""
    to = F.coalesce(F.expr("nullif(target_ids, array())"), F.array("owner_id"))
    d = notes.select(F.explode(to).alias("id"), F.struct("owner_id", "note_index", "marker").alias("ref"))
    return d.groupBy("id").agg(F.array_sort(F.collect_list("ref")).alias("refs"))


def owner_asof(spans: DataFrame, intervals: DataFrame, key: str, at: str, start: str, owner: str, end: str | None = None, manual: DataFrame | None = None) -> DataFrame:
    """spans with the owner whose interval started last at or before the span, within the same key. Starts and spans are
    merged in order, so each is read once, and a key with very many of them is scanned in several tasks. An interval that has
    ended (end < at) gives no owner. A `manual` table (key, owner) wins over what is found."""
    iv = F.struct(F.col(owner).alias("o"), (F.col(end) if end else F.lit(None).cast("string")).alias("e"))
    a = intervals.select(F.col(key).alias("_key"), F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(owner).alias("_o"), iv.alias("_iv"), F.lit(None).alias("_row"))
    b = spans.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_o"), F.lit(None).alias("_iv"), F.struct(*spans.columns).alias("_row"))
    d = carried(a.unionByName(b), ["_key"], ["_at", "_kind", "_o"], F.col("_iv"), "_last", own=True).filter("_kind = 1")
    ended = F.coalesce(F.col("_last.e") < F.col("_at"), F.lit(False)) if end else F.lit(False)
    d = d.select("_row.*", F.when(~ended, F.col("_last.o")).alias("owner"))
    if manual is None:
        return d
    m = small(manual.select(F.col(key).alias("_key"), F.col(owner).alias("_manual")))
    return d.join(m, F.col(key) == F.col("_key"), "left").withColumn("owner", F.coalesce("_manual", "owner")).drop("_key", "_manual")


def ranked_occurrences(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """lines with occurrence (from 1) and occurrences of their keys."""
    w = Window.partitionBy(*keys)
    return lines.withColumns({"occurrence": F.row_number().over(w.orderBy(order)), "occurrences": F.count("*").over(w)})


def matched_occurrences(canonical: DataFrame, physical: DataFrame, keys: list[str], order: str) -> DataFrame:
    """canonical with status: "matched" (with the physical line) if both sides have the same number of lines of the key,
    "ambiguous" if the numbers differ, "unmatched" if there is none."""
    a = ranked_occurrences(canonical, keys, order)
    b = ranked_occurrences(physical, keys, order).select(*keys, "occurrence", F.col("occurrences").alias("found"), F.col(order).alias("physical"))
    n = b.select(*keys, "found").distinct()
    d = a.join(n, keys, "left").join(b.select(*keys, "occurrence", "physical"), [*keys, "occurrence"], "left")
    status = F.when(F.col("found").isNull(), "unmatched").when(F.col("found") == F.col("occurrences"), "matched").otherwise("ambiguous")
    return d.withColumns({"status": status, "physical": F.when(status == "matched", F.col("physical"))}).drop("found")


def multiset_removal(lines: DataFrame, removed: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Lines without the first occurrences of the removed ones; and those to be removed that weren't there."""
    a = ranked_occurrences(lines, keys, order).drop("occurrences")
    b = ranked_occurrences(removed, keys, order).drop("occurrences")
    on = [*keys, "occurrence"]
    return a.join(b.select(on), on, "left_anti").drop("occurrence"), b.join(a.select(on), on, "left_anti").drop("occurrence")


def note_groups(spans: DataFrame, page: str, order: str, key: str) -> DataFrame:
    """spans with group_no: consecutive spans with one key are a group; a span without a key carries on the key before it on its page."""
    w = Window.partitionBy(page).orderBy(order)
    d = spans.withColumn("_key", F.last(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_new", (~F.col("_key").eqNullSafe(F.lag("_key").over(w))).cast("int"))
    return d.withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_key", "_new")


def interval_removal(lines: DataFrame, spans: DataFrame, pads: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Lines (id, text) without those of note spans (page, y, text) that stand within their entry's interval (id, start_page,
    start_y, end_page, end_y), each span taking the first equal line; and the spans that found none. Entries meet spans on
    the pages that they cover."""
    at = pads.select("id", "start_page", "start_y", "end_page", "end_y", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    inside = ((F.col("start_page") < F.col("page")) | (F.col("start_y") <= F.col("y"))) & ((F.col("end_page") > F.col("page")) | (F.col("y") < F.col("end_y")))
    mine = spans.join(at, "page").filter(inside).select("id", "page", "y", "text")
    mine = mine.withColumn("_place", F.struct("page", "y"))
    a = ranked_occurrences(lines, ["id", "text"], order).drop("occurrences")
    b = ranked_occurrences(mine, ["id", "text"], "_place").drop("occurrences", "_place")
    on = ["id", "text", "occurrence"]
    return a.join(b.select(on), on, "left_anti").drop("occurrence"), b.join(a.select(on), on, "left_anti").drop("occurrence")


def group_summaries(spans: DataFrame, keys: list[str], order: str, text: str, page: str, targets: DataFrame | None = None, named: dict[int, str] | None = None) -> DataFrame:
    """keys, marker, lines, pages and target_ids of note groups: the marker is the number that opens the first line, else a
    star, or what `named` gives a group that stands on one page; targets (page, target_ids; few) are by the first page."""
    from ..functions.text import DIGITS
    
    first = F.struct(order, F.col(text).alias("t"))
    d = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(first)).alias("_l"), F.array_sort(F.collect_set(page)).alias("pages"))
    d = d.withColumn("lines", F.transform("_l", lambda x: x["t"]))
    number = F.regexp_extract(F.translate(F.get("lines", F.lit(0)), DIGITS, "0123456789"), r"^(\d+)[.\-]", 1)
    marker = F.when(number != "", F.coalesce(F.nullif(F.ltrim(number, F.lit("0")), F.lit("")), F.lit("0"))).otherwise("*")
    for p, name in (named or {}).items():
        marker = F.when((F.size("pages") == 1) & (F.get("pages", F.lit(0)) == p), name).otherwise(marker)
    d = d.withColumns({"marker": marker, "_page": F.get("pages", F.lit(0))})
    if targets is None:
        return d.select(*keys, "marker", "lines", "pages")
    d = d.join(small(targets.select(F.col("page").alias("_page"), "target_ids")), "_page", "left")
    return d.select(*keys, "marker", "lines", "pages", "target_ids")


def audit_totals(pads: DataFrame, notes: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: how many entries and notes there are, and lines by status (matched_occurrences)."""
    n = {f"n_{x}": F.count_if(F.col("status") == x) for x in ("matched", "unmatched", "ambiguous")}
    counts = matched.agg(*[v.alias(k) for k, v in n.items()])
    for name, d in (("n_pads", pads), ("n_notes", notes)):
        counts = counts.withColumn(name, F.lit(d.count()))
    return counts.select("n_pads", "n_notes", *n)
