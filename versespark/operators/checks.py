"""Integrity checks: each gives the rows that break a rule, so an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .patterns import terms_found
from .search import small


def not_covered(ids: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """key, side: whole numbers from first to last that are missing, and ids beyond them."""
    want = ids.sparkSession.range(first, last + 1).select(F.col("id").alias(key))
    have = ids.select(F.col(key).cast("long")).distinct()
    return want.join(have, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(have.join(want, key, "left_anti").withColumn("side", F.lit("extra")))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: how many rows break each rule (a null counts as broken), in one pass."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.inline(pairs))


def required_terms(texts: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """accepted, rejected, has_accepted, has_rejected for a dictionary of readings over all texts, which are read once for
    all of them."""
    asked = terms.select("accepted", "rejected").distinct()
    both = asked.select(F.explode(F.array("accepted", "rejected")).alias("term"))
    found = staged(terms_found(texts, text, both, "term"), "terms-found").withColumn("_there", F.lit(True))
    for side in ("accepted", "rejected"):
        asked = asked.join(found.select(F.col("term").alias(side), F.col("_there").alias(f"has_{side}")), side, "left")
    has = [F.coalesce(f"has_{side}", F.lit(False)).alias(f"has_{side}") for side in ("accepted", "rejected")]
    return asked.select("accepted", "rejected", *has)


def checksum_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest rows (file, bytes, sha256) whose file (path, length, content) is missing, of another size or of another content."""
    f = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("found"))
    d = manifest.join(f, "file", "left")
    why = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size").when(F.col("found") != F.col("sha256"), "content")
    return d.withColumn("why", why).filter("why is not null").select("file", "why")


def available(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """manifest with available: whether the listing (file, size) has the file in its full size."""
    return manifest.join(listing, "file", "left").withColumn("available", F.coalesce(F.col("size") == F.col("bytes"), F.lit(False))).drop("size")


def canonical_hash(headings: Column, verses: Column) -> Column:
    """sha256 of {"headings": [...], "verses": [...]} with a blank after each comma and colon."""
    item = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]\z", "$1")
    items = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, item), ", "), F.lit("]"))
    return F.sha2(F.concat(F.lit('{"headings": '), items(headings), F.lit(', "verses": '), items(verses), F.lit("}")), 256)


def length_limits(texts: DataFrame, kind: str, text: str, limits: DataFrame) -> DataFrame:
    """texts longer, trimmed, than the limit (kind, most) of their kind."""
    return texts.join(small(limits), kind).filter(F.length(F.trim(text)) > F.col("most"))


def all_empty(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violations for several check results."""
    parts = [d.agg(F.count("*").alias("violations")).select(F.lit(n).alias("check"), "violations") for n, d in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def unlike_stanzas(pads: DataFrame) -> DataFrame:
    """Entries whose stanzas (array of arrays of lines) aren't their verses, in order."""
    return pads.filter(~F.flatten("stanzas").eqNullSafe(F.col("verses")))


def unlike_markers(refs: DataFrame, notes: DataFrame) -> DataFrame:
    """References (id, owner_id, note_index, marker) to a note with another marker."""
    d = refs.join(notes.select("owner_id", "note_index", F.col("marker").alias("note_marker")), ["owner_id", "note_index"])
    return d.filter(~F.col("marker").eqNullSafe(F.col("note_marker")))
