"""Assembly of lines into entries and stanzas, and the edits that they take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import shared_out, tasks_for


def marker_segments(lines: DataFrame, part: str, order: str, is_marker: Column) -> DataFrame:
    """lines with segment: how many markers stand up to the line; 0 before the first, which belongs to no entry."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("segment", F.sum(is_marker.cast("int")).over(w))


def breaks_after(lines: DataFrame, part: str, order: str, ends: Column) -> DataFrame:
    """lines with stanza (from 1): a line that ends one is its last."""
    w = Window.partitionBy(part).orderBy(order)
    d = lines.withColumn("_end", F.coalesce(ends, F.lit(False)).cast("int"))
    return d.withColumn("stanza", (F.coalesce(F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int")).drop("_end")


def ends_stanza(text: Column, with_number: bool = True) -> Column:
    """Whether a line ends with a double danda, or one with a star, or (in unreviewed text) with a number behind it."""
    return text.rlike(r"॥(?:\*|[०-९0-9]+)?\z" if with_number else r"॥\*?\z")


def regroup_by_counts(lines: DataFrame, counts: DataFrame, part: str, order: str) -> DataFrame:
    """lines with the group (group_no, and other columns of `counts`) that a list of counts (part, group_no, n) puts them in:
    cumulative counts are ranges of lines. Counts that don't add up to the part's lines fail; a part without counts keeps
    its lines in no group."""
    w = Window.partitionBy(part)
    upto = counts.withColumn("_to", F.sum("n").over(w.orderBy("group_no").rowsBetween(Window.unboundedPreceding, 0)))
    upto = upto.withColumns({"_from": F.col("_to") - F.col("n"), "_total": F.sum("n").over(w)}).drop("n").withColumnRenamed(part, "_part")
    d = lines.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    totals = counts.groupBy(F.col(part).alias("_whole")).agg(F.sum("n").alias("_sum"))
    d = d.join(totals, F.col(part) == F.col("_whole"), "left")
    off = F.raise_error(F.concat(F.lit("counts don't add up to the lines of "), F.col(part).cast("string"))).cast("bigint")
    d = d.withColumn("_i", F.when(F.col("_sum") != F.col("_n"), off).otherwise(F.col("_i")))
    return d.join(upto, (F.col(part) == F.col("_part")) & (F.col("_i") >= F.col("_from")) & (F.col("_i") < F.col("_to")), "left").drop("_i", "_n", "_sum", "_whole", "_from", "_to", "_total", "_part")


def located_blocks(lines: DataFrame, regions: DataFrame, part: str, order: str) -> DataFrame:
    """lines with the region (region_no and its other columns) that holds them: regions (part, region_no, n_lines) take
    consecutive lines, and must take all of them."""
    counts = regions.withColumnsRenamed({"region_no": "group_no", "n_lines": "n"})
    return regroup_by_counts(lines, counts, part, order).withColumnRenamed("group_no", "region_no")


def paired_lines(lines: DataFrame, part: str, order: str, text: str, pairs: Column | None = None) -> DataFrame:
    """part, pair_no, text, source_lines (places in the part, from 0): lines two by two where `pairs` holds for their part (all
    by default), else one by one; a line that ends with a hyphen joins the next without a blank."""
    w = Window.partitionBy(part).orderBy(order)
    i = F.row_number().over(w) - 1
    d = lines.withColumn("_i", i).withColumn("pair_no", F.floor(F.col("_i") / (F.when(pairs, 2).otherwise(1) if pairs is not None else F.lit(2))).cast("long"))
    d = d.groupBy(part, "pair_no").agg(F.sort_array(F.collect_list(F.struct("_i", F.col(text).alias("t")))).alias("x"))
    a, b = F.get("x", F.lit(0))["t"], F.get("x", F.lit(1))["t"]
    joined = F.concat(a, F.when(b.isNull(), "").otherwise(F.concat(F.when(a.endswith("-"), "").otherwise(" "), b)))
    return d.select(part, "pair_no", joined.alias("text"), F.transform("x", lambda v: v["_i"]).alias("source_lines"))


def corrected(lines: DataFrame, corrections: DataFrame, keys: list[str], text: str) -> DataFrame:
    """lines with corrections (keys, before, after) applied; a null `after` deletes the line. A correction whose `before` isn't what stands there fails."""
    c = corrections.select(*keys, "before", "after", F.lit(True).alias("_hit"))
    d = lines.join(c, keys, "left")
    checked = F.when(F.col("_hit") & ~F.col("before").eqNullSafe(F.col(text)), F.raise_error(F.concat(F.lit("correction doesn't fit: "), F.col(text))).cast("string")).otherwise(F.when(F.col("_hit"), F.col("after")).otherwise(F.col(text)))
    return d.filter(F.col("_hit").isNull() | F.col("after").isNotNull()).withColumn(text, checked).drop("before", "after", "_hit")


def overridden(rows: DataFrame, overrides: DataFrame, key: str, columns: list[str], when: Column) -> DataFrame:
    """rows with the given columns of their override where `when` holds for it."""
    o = overrides.filter(when).select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    d = rows.join(o, key, "left")
    return d.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_hit", *[f"_{c}" for c in columns])


def boxes_overridden(rows: DataFrame, overrides: DataFrame, keys: list[str], box: str, text: str) -> DataFrame:
    """rows with the box of their override (keys, text, box, reason) and its reason as box_reason; an override for another text
    than the row has fails."""
    o = overrides.select(*keys, F.col(text).alias("_text"), F.col(box).alias("_box"), F.col("reason").alias("box_reason"), F.lit(True).alias("_hit"))
    d = rows.join(o, keys, "left")
    off = F.raise_error(F.concat(F.lit("override for another text: "), F.coalesce(text, F.lit("null"))))
    own = F.when(F.col("_hit") & ~F.col("_text").eqNullSafe(F.col(text)), off.cast(rows.schema[box].dataType)).when(F.col("_hit"), F.col("_box")).otherwise(F.col(box))
    return d.withColumn(box, own).drop("_text", "_box", "_hit")


def lost(decisions: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions that no row bears out: must be empty."""
    return decisions.join(rows.select(keys), keys, "left_anti")


# A number in brackets, and how the heading of a raag opens.
BRACKETED_NUMBER = r"^[\[(][०-९0-9]+[\])]\z"
RAAG_OPENER = "(राग "


def peeled_headings(lines: DataFrame, part: str, order: str, text: str, known: Column | None = None) -> DataFrame:
    """lines with role: "number", "heading" or "verse".

    What leads a part is peeled off: numbers in brackets, and headings (in parentheses, or with the opener of a raag). Of what
    is left, the first line is a heading together with the second if that is in parentheses and the first has no danda; or
    alone if it is a `known` heading of the source, short and unpunctuated, and the second ends with a danda."""
    c, w = F.col(text), Window.partitionBy(part).orderBy(order)
    enclosed = c.startswith("(") & c.endswith(")")
    number = c.rlike(BRACKETED_NUMBER)
    led = number | enclosed | c.startswith(RAAG_OPENER)
    d = lines.withColumn("_rest", F.sum((~led).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = (F.col("_rest") == 1) & (F.coalesce(F.lag("_rest").over(w), F.lit(0)) == 0)
    after = F.lead(c).over(w)
    both = first & after.startswith("(") & after.endswith(")") & ~c.rlike("[।॥]")
    alone = first & ~both & (known if known is not None else F.lit(False)) & (F.length(c) < 55) & ~c.rlike("[।॥!?]") & after.rlike(r"[।॥]\z")
    d = d.withColumns({"_both": F.coalesce(both, F.lit(False)), "_alone": F.coalesce(alone, F.lit(False))})
    heading = F.col("_both") | F.col("_alone") | F.coalesce(F.lag("_both").over(w), F.lit(False))
    role = F.when(F.col("_rest") == 0, F.when(number, "number").otherwise("heading")).when(heading, "heading").otherwise("verse")
    return d.withColumn("role", role).drop("_rest", "_both", "_alone")


def music(headings: Column) -> dict[str, Column]:
    """raag, taal and form that headings name: what is in the first parentheses with a raag is cut once at a dash into raag and
    taal; the first other parentheses name the form."""
    inner = lambda h: F.substring(h, F.lit(2), F.length(h) - 2)
    enclosed = F.filter(headings, lambda h: h.startswith("(") & h.endswith(")"))
    raag = inner(F.get(F.filter(enclosed, lambda h: h.startswith(RAAG_OPENER)), F.lit(0)))
    parts = F.split(raag, "[—–-]", 2)
    name = F.trim(F.regexp_replace(F.get(parts, F.lit(0)), "^राग ", ""))
    beat = F.trim(F.replace(F.get(parts, F.lit(1)), F.lit("ताल"), F.lit("")))
    return {"raag": name, "taal": beat, "form": inner(F.get(F.filter(enclosed, lambda h: ~h.startswith(RAAG_OPENER)), F.lit(0)))}


def title_of(headings: Column, verses: Column, old: Column) -> Column:
    plain = F.filter(headings, lambda h: ~h.rlike(r"^\s*\("))
    return F.coalesce(F.get(plain, F.lit(0)), F.get(verses, F.lit(0)), old)


def terminal_danda(text: Column) -> Column:
    """The last line of a stanza with one double danda at its end."""
    return F.concat(F.regexp_replace(F.rtrim(text), r"[।॥!]+\z", ""), F.lit("॥"))


def numbered(lines: DataFrame, part: str, order: str, stanza: str, text: str, star_after: Column | None = None, closing: Column | None = None) -> DataFrame:
    """lines where the double danda that ends a stanza is followed by the stanza's number. With `star_after` (a stanza of the
    part; null: none), all other stars at line ends go and that stanza's end gets one before its danda; a `closing` part's
    last line keeps none. Lines are dealt by part once, for both orders, to tasks whose share doesn't grow with the table."""
    from ..functions.text import devanagari_number

    lines = shared_out(lines, [part], tasks_for(lines))
    c = F.col(text)
    last = F.lead(order).over(Window.partitionBy(part, stanza).orderBy(order)).isNull()
    number = F.concat(F.lit("॥"), devanagari_number(F.col(stanza)), F.lit("॥"))
    star = F.coalesce(F.col(stanza) == star_after, F.lit(False)) if star_after is not None else F.lit(False)
    bare = F.when(star_after.isNotNull(), F.regexp_replace(c, r"\*\z", "")).otherwise(c) if star_after is not None else c
    ended = F.when(bare.rlike(r"॥\z"), F.concat(F.when(star, F.regexp_replace(bare, r"॥\z", "*")).otherwise(F.regexp_replace(bare, r"॥\z", "")), number))
    ended = ended.when(bare.rlike(r"॥\*\z"), F.concat(F.regexp_replace(bare, r"॥\*\z", ""), number, F.lit("*"))).otherwise(F.when(star, F.concat(bare, F.lit("*"))).otherwise(bare))
    d = lines.withColumn(text, F.when(last, ended).otherwise(bare))
    if closing is not None:
        end = F.lead(order).over(Window.partitionBy(part).orderBy(order)).isNull()
        d = d.withColumn(text, F.when(closing & end, F.regexp_replace(text, r"\*\z", "")).otherwise(F.col(text)))
    return d


def last_star_only(lines: DataFrame, part: str, order: str, text: str, applies: Column | None = None, word: Column | None = None) -> DataFrame:
    """lines where only one of a part's starred ones keeps its stars: the last, or the first that has `word` (null: the last;
    if no starred line has it, none does). `applies` says for which parts, as those with one note (all by default); a part
    with a single starred line stays as it is."""
    star, c = F.contains(text, F.lit("*")), F.col(text)
    w = Window.partitionBy(part)
    keep = F.max(F.when(star, F.col(order))).over(w)
    if word is not None:
        keep = F.when(word.isNull(), keep).otherwise(F.min(F.when(star & F.contains(c, word), F.col(order))).over(w))
    d = lines.withColumns({"_keep": keep, "_stars": F.count_if(star).over(w), "_applies": applies if applies is not None else F.lit(True)})
    stays = ~F.col("_applies") | (F.col("_stars") < 2) | F.col("_keep").eqNullSafe(F.col(order))
    return d.withColumn(text, F.when(stays, c).otherwise(F.replace(c, F.lit("*"), F.lit("")))).drop("_keep", "_stars", "_applies")


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, old_*, new_*: rows whose columns differ, or that are on one side only."""
    a = old.select(key, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(1).alias("_o"))
    b = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(1).alias("_n"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return a.join(b, key, "full").filter(~same | F.col("_o").isNull() | F.col("_n").isNull()).drop("_o", "_n")
