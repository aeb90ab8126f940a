"""From a collection's own shape to entries that all operators share, and the roles of rows and segments of lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed
from .search import small

PAD_COLUMNS = ["mode", "id", "title", "section", "subtopic", "raag", "taal", "form", "headings", "verses", "notes", "search_number"]


def canonical(entries: DataFrame, mode: str, sections: DataFrame | None = None) -> DataFrame:
    """Entries of blocks (sequence, title, section_id, blocks) as pads: the verses are the lines of all blocks. Sections
    (section_id, name) of a collection are few."""
    d = entries.withColumns({"mode": F.lit(mode), "id": F.col("sequence"), "verses": F.flatten("blocks"), "stanzas": F.col("blocks")})
    if sections is not None:
        d = d.join(small(sections.select("section_id", F.col("name").alias("section"))), "section_id", "left")
    return d


def search_documents(pads: DataFrame, collection: bool) -> DataFrame:
    """The text columns of a search, nothing else. The number that is searched is the entry's own, even if that is null; else
    the printed one; else the id, but not in a collection."""
    have = set(pads.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    own = F.coalesce(col("has_search_number").cast("boolean"), F.lit("search_number" in have and "has_search_number" not in have))
    fallback = F.coalesce(col("printed_number").cast("long"), F.lit(None).cast("long") if collection else F.col("id").cast("long"))
    number = F.when(own, col("search_number").cast("long")).otherwise(fallback)
    lists = {c: F.coalesce(col(c).cast("array<string>"), F.array().cast("array<string>")) for c in ("headings", "verses", "notes")}
    texts = {c: col(c).cast("string") for c in ("mode", "title", "section", "subtopic", "raag", "taal", "form")}
    return pads.select("id", *[v.alias(k) for k, v in (texts | lists).items()], number.alias("search_number")).select(PAD_COLUMNS)


def other_edition(pads: DataFrame, items: DataFrame, columns: list[str], mode: str) -> DataFrame:
    """Entries of another edition: the base entry (base_id) with the item's id and its own columns."""
    own = items.select("base_id", F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    d = pads.join(own, pads["id"] == own["base_id"]).drop("base_id")
    return d.withColumns({"mode": F.lit(mode), "id": F.col("_id"), **{c: F.col(f"_{c}") for c in columns}}).drop("_id", *[f"_{c}" for c in columns])


def one_space(collections: list[DataFrame]) -> DataFrame:
    """All collections in one table; the mode tells them apart."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), collections)


def without(nested: Column, *fields: str) -> Column:
    """An array of structs without some of their fields."""
    return F.transform(nested, lambda x: x.dropFields(*fields))


def row_roles(rows: DataFrame, page: str, y: str, text: str, zones: DataFrame, markers: list[tuple[int, str]] = ()) -> DataFrame:
    """rows with role and reason: in a zone (page, y0, y1; few) that belongs to a section heading: excluded; a short bracketed
    text or a listed (page, text): marker; a number in parentheses at the top: excluded; else body."""
    z = small(zones.groupBy(F.col("page").alias("_p")).agg(F.collect_list(F.struct("y0", "y1")).alias("_z")))
    d = rows.join(z, F.col(page) == F.col("_p"), "left")
    inside = F.coalesce(F.exists("_z", lambda v: (v["y0"] <= F.col(y)) & (F.col(y) < v["y1"])), F.lit(False))
    marker = (F.length(text) < 18) & F.col(text).rlike(r"[\[\]]")
    for p, t in markers:
        marker = marker | ((F.col(page) == p) & (F.col(text) == t))
    number = (F.col(y) < 140) & (F.length(text) < 14) & F.col(text).rlike(r"^\([०-९0-9]+\)\z")
    role = F.when(inside, "excluded").when(marker, "marker").when(number, "excluded").otherwise("body")
    reason = F.when(inside, "section heading or decoration").when(~marker & number, "printed page number")
    return d.withColumns({"role": role, "reason": reason}).drop("_p", "_z")


def note_lines(rows: DataFrame, page: str, y: str, is_marker: Column, limits: DataFrame) -> DataFrame:
    """rows with is_note: below the page's limit (page, note_y; few) or, without one, at or below the first marker of the page."""
    d = rows.join(small(limits.select(F.col("page").alias("_p"), "note_y")), F.col(page) == F.col("_p"), "left")
    first = F.min(F.when(is_marker, F.col(y))).over(Window.partitionBy(page))
    return d.withColumn("is_note", F.coalesce(F.col(y) >= F.coalesce("note_y", first), F.lit(False))).drop("_p", "note_y")


def segment_texts(lines: DataFrame, text: str, fragments: str, out: str = "segments") -> DataFrame:
    """lines with the accepted text cut where the printed fragments (array of strings) end, counted without blanks. Where the
    letters don't add up, or a cut would fall within a word, the whole text is one segment."""
    sizes = F.transform(fragments, lambda f: F.length(squeezed(f)))
    ends = F.transform(F.sequence(F.lit(1), F.size(fragments)), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    letters = F.filter(F.transform(F.split(text, ""), lambda ch, i: F.struct(ch.alias("ch"), i.alias("i"))), lambda x: F.trim(x["ch"]) != "")
    d = lines.withColumns({"_l": letters, "_e": F.when(F.size(fragments) > 0, ends)})
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(F.col("_l"), F.get(F.col("_e"), k - 1))["i"])
    cut = F.transform("_e", lambda e, k: F.substring(F.col(text), start(k) + 1, F.coalesce(start(k + 1), F.length(text)) - start(k)))
    whole = F.array(F.col(text))
    fits = (F.get("_e", F.size("_e") - 1) == F.size("_l")) & F.forall(F.slice("_e", F.lit(1), F.greatest(F.size("_e") - 1, F.lit(0))), lambda e: F.get(F.col("_l"), e)["i"] > F.get(F.col("_l"), e - 1)["i"] + 1)
    return d.withColumn(out, F.when(F.coalesce(fits, F.lit(False)), cut).otherwise(whole)).drop("_l", "_e")


def merged_segments(lines: DataFrame, text: str, fragments: str, out: str = "segments", shown: str | None = None) -> DataFrame:
    """lines with the accepted text cut where printed fragments end, as segments (text, x0, y0, x1, y1). Fragments (of the
    same fields) are counted without blanks, and blanks stay with what stands before them. A fragment that begins within a
    word is merged with the one before it, from whose left edge to its own right one the segment reaches. Where the letters
    aren't the fragments' own, the whole text is one segment without a box. `shown` may end otherwise than the text does:
    then the last segment says so."""
    box = ("x0", "y0", "x1", "y1")
    sizes = F.transform(fragments, lambda f: F.length(squeezed(f["text"])))
    ends = F.transform(F.sequence(F.lit(1), F.size(fragments)), lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x))
    letters = F.filter(F.transform(F.split(text, ""), lambda ch, i: F.struct(ch.alias("ch"), i.alias("i"))), lambda x: F.trim(x["ch"]) != "")
    same = squeezed(F.array_join(F.transform(fragments, lambda f: f["text"]), "")) == squeezed(F.col(text))
    d = lines.withColumns({"_l": letters, "_e": F.when(same & (F.size(fragments) > 0), ends), "_f": F.col(fragments)})
    start = lambda k: F.when(k == 0, 0).otherwise(F.coalesce(F.get(F.col("_l"), F.get(F.col("_e"), k - 1))["i"], F.length(text)))
    piece = lambda f, k: F.struct(F.substring(F.col(text), start(k) + 1, start(k + 1) - start(k)).alias("text"), *[f[c].cast("double").alias(c) for c in box])
    pieces = F.transform("_f", piece)
    empty = F.array().cast("array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(F.concat(last["text"], x["text"]).alias("text"), last["x0"].alias("x0"), F.least(last["y0"], x["y0"]).alias("y0"), x["x1"].alias("x1"), F.greatest(last["y1"], x["y1"]).alias("y1"))
        within = (F.size(done) > 0) & ~last["text"].rlike(r"\s\z")
        return F.when(within, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    whole = lambda t: F.array(F.struct(F.col(t).alias("text"), *[F.lit(None).cast("double").alias(c) for c in box]))
    d = d.withColumn(out, F.when(F.col("_e").isNotNull(), F.aggregate(pieces, empty, step)).otherwise(whole(text)))
    if shown is not None:
        before = F.array_join(F.transform(F.slice(out, F.lit(1), F.size(out) - 1), lambda x: x["text"]), "")
        last = F.get(F.col(out), F.size(out) - 1)
        ends_so = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(last.withField("text", F.substring(F.col(shown), F.length(before) + 1, F.length(shown)))))
        d = d.withColumn(out, F.when(F.col(shown) == F.col(text), F.col(out)).when(F.startswith(F.col(shown), before), ends_so).otherwise(whole(shown)))
    return d.drop("_l", "_e", "_f")


def replaced_across(segments: Column, change) -> Column:
    """Segments of a line after a change of the whole line that keeps its length: cut again at the same places. A change
    that doesn't keep it has no places to cut at, and fails."""
    sizes = F.transform(segments, lambda s: F.length(s))
    before = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x)
    line = F.array_join(segments, "")
    off = F.raise_error(F.concat(F.lit("the change doesn't keep the length of: "), line))
    new = F.when(F.length(change(line)) == F.length(line), change(line)).otherwise(off.cast("string"))
    return F.transform(segments, lambda s, k: F.substring(new, before(k) + 1, F.length(s)))


def split_at(text: Column, word: Column) -> Column:
    """The text before a word and from it on; a text without the word is an error."""
    at = F.locate(word, text) if isinstance(word, str) else F.instr(text, word)
    return F.when(at > 0, F.array(F.rtrim(F.substring(text, F.lit(1), at - 1)), F.substring(text, at, F.length(text)))).otherwise(F.raise_error(F.concat(F.lit("no such word in: "), text)).cast("array<string>"))


def numbered_stanzas(lines: DataFrame, part: str, order: str, stanza: str, text: str) -> DataFrame:
    """lines where the last of each stanza ends with the stanza's number in Devanagari digits."""
    from ..functions.text import devanagari_number

    last = F.lead(order).over(Window.partitionBy(part, stanza).orderBy(order)).isNull()
    return lines.withColumn(text, F.when(last, F.concat(F.regexp_replace(F.rtrim(text), r"[।॥!]+\z", ""), F.lit("॥"), devanagari_number(F.col(stanza)), F.lit("॥"))).otherwise(F.col(text)))


def source_pages(lines: DataFrame, notes: DataFrame, refs: DataFrame) -> DataFrame:
    """id, pages: where an entry is printed: its lines, its own notes, and the notes that it refers to."""
    own = lines.select("id", F.col("page"))
    mine = notes.select(F.col("owner_id").alias("id"), F.explode("source_pages").alias("page"))
    theirs = refs.join(notes, ["owner_id", "note_index"]).select("id", F.explode("source_pages").alias("page"))
    return own.unionByName(mine).unionByName(theirs).groupBy("id").agg(F.array_sort(F.collect_set("page")).alias("pages"))


@dataclass(frozen=True)
class Collection:
    """What differs between collections: how entries are read, the page and the path of an entry, and the number that is shown."""

    mode: str
    pads: Callable[[], DataFrame]
    page: Callable[[DataFrame], DataFrame]
    route: Callable[[Column], Column]
    number: Callable[[DataFrame], Column]


class Collections:
    """Collections by mode."""

    def __init__(self, *collections: Collection):
        self.by_mode = {c.mode: c for c in collections}
        if len(self.by_mode) < len(collections):
            raise ValueError("two collections of one mode")

    def entries(self) -> DataFrame:
        """All entries with mode, page columns, route and display_number, each by its collection's functions."""
        parts = []
        for c in self.by_mode.values():
            d = c.page(c.pads().withColumn("mode", F.lit(c.mode)))
            parts.append(d.withColumns({"route": c.route(F.col("id")), "display_number": c.number(d).cast("string")}))
        return one_space(parts)
