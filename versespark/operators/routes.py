"""Routes and bookmarks: from paths and keys to entries that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import small


def routes(paths: DataFrame, path: str, slugs: DataFrame, entries: DataFrame, fixed: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """paths with mode and id: /slug/number, a trailing slash allowed; a slug may be an alias of a mode (slug, mode), which are
    few; fixed paths lead to one entry. Both are null where no such entry exists."""
    clean = F.regexp_replace(F.coalesce(path, F.lit("")), "^#", "")
    shape = r"^/([^/]+)/(\d+)/?\z"
    d = paths.withColumns({"_slug": F.regexp_extract(clean, shape, 1), "_id": F.regexp_extract(clean, shape, 2).try_cast("long")})
    d = d.join(small(slugs.select(F.col("slug").alias("_slug"), F.col("mode").alias("_mode"))), "_slug", "left").withColumn("_mode", F.coalesce("_mode", F.nullif("_slug", F.lit(""))))
    for p, (mode, i) in (fixed or {}).items():
        hit = clean.isin(p, p + "/")
        d = d.withColumns({"_mode": F.when(hit, mode).otherwise(F.col("_mode")), "_id": F.when(hit, i).otherwise(F.col("_id"))})
    e = entries.select(F.col("mode").alias("_mode"), F.col("id").cast("long").alias("_id"), F.lit(True).alias("_there")).distinct()
    d = d.join(e, ["_mode", "_id"], "left")
    return d.select(*paths.columns, F.when(F.col("_there"), F.col("_mode")).alias("mode"), F.when(F.col("_there"), F.col("_id")).alias("id"))


def bookmarks(keys: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    """keys with mode, id and title of the entry that "mode:id" names; nulls if the digits aren't strict or no entry is there."""
    shape = r"(?s)^([^:]+):(\d+)\z"
    d = keys.withColumns({"_mode": F.regexp_extract(key, shape, 1), "_id": F.regexp_extract(key, shape, 2).try_cast("long")})
    e = entries.select(F.col("mode").alias("_mode"), F.col("id").cast("long").alias("_id"), F.col("title").alias("_title"), F.lit(True).alias("_there"))
    d = d.join(e, ["_mode", "_id"], "left")
    there = F.coalesce("_there", F.lit(False))
    return d.select(*keys.columns, F.when(there, F.col("_mode")).alias("mode"), F.when(there, F.col("_id")).alias("id"), F.col("_title").alias("title"))


def toggled(stored: Column, key: Column) -> Column:
    """A list of keys without the key if it has it, else with it at the end."""
    return F.when(F.array_contains(stored, key), F.array_remove(stored, key)).otherwise(F.array_append(stored, key))


def route_path(mode: Column, entry: Column, slugs: dict[str, str], single: tuple[str, ...] = ()) -> Column:
    """The path of an entry; collections of a single entry have no number in it."""
    slug = F.coalesce(*[F.when(mode == m, s) for m, s in slugs.items()], mode)
    return F.when(mode.isin(*single), F.concat(F.lit("/"), slug)).otherwise(F.concat(F.lit("/"), slug, F.lit("/"), entry.cast("string"))) if single else F.concat(F.lit("/"), slug, F.lit("/"), entry.cast("string"))


def share_footer(site: str, path: Column, apps: dict[str, str]) -> Column:
    """An entry's link, and where the apps are."""
    lines = "\n".join(f"{name} - {site}{at}" for name, at in apps.items())
    return F.concat(F.lit(site), path, F.lit(f"\n\nDownload App:\n{lines}"))


def copied_text(text: Column, footer: Column) -> Column:
    return F.concat(text, F.lit("\n\n"), footer)


def current_first(groups: DataFrame, mode: str, order: str, current: Column) -> DataFrame:
    """groups with group_pos (from 1) within their query: the current collection, then the others in their order."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy((F.col(mode) != current).cast("int"), order)
    return groups.withColumn("group_pos", F.row_number().over(w))
