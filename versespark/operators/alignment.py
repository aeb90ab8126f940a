"""Matching of recognised lines: overlaps, similarity, alignment in order, and clustering of rows.

Overlaps and nearest rows are joins within a page. What is sequential by nature streams through tasks in order with a few
lines of state, or is cut where the order starts anew: at gaps of a page, or at lines that pair off beyond dispute.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similar import best_ratios, ratio_over
from ..functions.text import ocr_normal
from ..sources.staging import staged
from .scan import tasks_for


# From how many letters on a row is compared, below what similarity it may be missing; costs of an alignment,
# the similarity that makes a pair reliable, and the heights of boxes that are believed.
MORE_LETTERS, MISSING = 10, 0.5
SKIP, UNMATCHED, SCALE, RELIABLE = 0.55, 0.8, 1.3, 0.62
HEIGHTS = (8, 100)

#: Lines of a block: blocks of rows meet blocks of proof lines.
BLOCK = 64
#: Letters of the blocks that are compared together, and distinct texts that are one task's share.
LETTERS, TEXTS = 200_000, 25_000
#: From how many pages on the same blocks are dealt to several tasks, and to how many.
COPIES, WAYS = 1_000, 64
#: A pair of equal lines out of order is a matter of dispute if it crosses at most so many others.
CROSSED = 3
#: Rows that a task gives back at once.
BATCH = 10_000


def ratio(a: str, b: str) -> float:
    """The share of characters that two texts have in common blocks (longest first); the order of the texts matters."""
    return ratio_over(a, b)


def in_blocks(texts: DataFrame, page: str, text: str, block: str, size: int = BLOCK) -> DataFrame:
    """page, the number of a block, and the texts of the block: the distinct texts of a page, so many to a block."""
    place = F.row_number().over(Window.partitionBy(page).orderBy(text)) - 1
    return texts.withColumn(block, F.floor(place / size).cast("int")).groupBy(page, block).agg(F.sort_array(F.collect_list(text)).alias(text))


def best_similarity(rows: DataFrame, proofs: DataFrame, page: str, key: str, text: str, least: float = MISSING, normal: bool = False) -> DataFrame:
    """The rows with enough letters, with the best similarity of their normal form to a proof line of their page (0 if it has
    none) and whether they may be missing there. Texts that are `normal` already (of normal_lines, and staged) are taken as
    they are.

    The distinct texts of a page are gathered once, and rows that equal a proof line are done. The other texts of a page, and
    its proof lines, are put in blocks; each block of rows meets each block of proof lines of its page, so that a page of very
    many lines is dealt over tasks, and a task compares the pairs of many blocks together. Blocks that say the same as others
    of another page are compared once."""
    form = lambda d: d.withColumn("_n", F.col(text) if normal else ocr_normal(F.col(text), True))
    d, p = form(rows).filter(F.length("_n") > MORE_LETTERS), form(proofs).filter("_n != ''")
    d = d if normal else staged(d, "similar-rows")
    kinds = lambda x, row: x.select(F.col(page).alias("_page"), "_n", F.lit(row).alias("_row"), F.lit(not row).alias("_proof"))
    texts = kinds(d, True).unionByName(kinds(p, False)).filter("_page is not null").groupBy("_page", "_n")
    texts = staged(texts.agg(F.max("_row").alias("_row"), F.max("_proof").alias("_proof")), "similar-texts")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, at, letters = [], [], 0  # different blocks, and the pages of each

        def frame() -> pd.DataFrame:
            found = [(k, n, b) for (r, _), pages, best in zip(groups, at, best_ratios(groups), strict=True) for k in pages for n, b in zip(r, best, strict=True)]
            return pd.DataFrame(found, columns=["_page", "_n", "_b"])

        for batch in batches:
            for k, r, q in zip(batch["_page"], batch["_n"], batch["_proof"], strict=True):
                if letters >= LETTERS:
                    yield frame()
                    groups, at, letters = [], [], 0
                blocks = list(r), list(q)
                letters += sum(map(len, r))
                if groups and blocks == groups[-1]:
                    at[-1].append(k)
                else:
                    groups.append(blocks)
                    at.append([k])
                    letters += sum(map(len, q))
        if groups:
            yield frame()

    x, q = texts.filter("_row and not _proof").select("_page", "_n"), texts.filter("_proof").select("_page", F.col("_n").alias("_proof"))
    pairs = in_blocks(x, "_page", "_n", "_i").join(in_blocks(q, "_page", "_proof", "_j"), "_page")
    # dealt by what the blocks say, as their work is far more than their bytes, so that copies follow on each other; those
    # of very many pages by pages too
    pairs = pairs.withColumn("_same", F.xxhash64("_n", "_proof"))
    often = pairs.groupBy("_same").agg(F.count("*").alias("_often")).filter(F.col("_often") > COPIES)
    pairs = pairs.join(F.broadcast(often), "_same", "left").withColumn("_way", F.when(F.col("_often").isNotNull(), F.pmod(F.xxhash64("_page"), F.lit(WAYS))))
    tasks = max(4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // TEXTS))
    kind = texts.schema["_page"].dataType.simpleString()
    found = pairs.repartition(tasks, "_same", "_way").sortWithinPartitions("_same").mapInPandas(lambda batches: compared(batches), f"_page {kind}, _n string, _b double")
    found = found.groupBy("_page", "_n").agg(F.max("_b").alias("_b")).unionByName(texts.filter("_row and _proof").select("_page", "_n", F.lit(1.0).alias("_b")))
    found = found.withColumnsRenamed({"_page": "_p", "_n": "_m"})
    d = d.join(found, (F.col(page) == F.col("_p")) & (F.col("_n") == F.col("_m")), "left").withColumn("best", F.coalesce("_b", F.lit(0.0)))
    return d.withColumn("missing", F.col("best") < least).drop("_n", "_p", "_m", "_b")


def coverage(best: DataFrame, page: str, key: str, most: int = 2) -> DataFrame:
    """page, rows, missing rows in order, and whether there are suspiciously many."""
    d = best.groupBy(page).agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.when(F.col("missing"), F.col(key)))).alias("missing_rows"))
    return d.withColumn("suspect", F.size("missing_rows") > most)


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """a (y0, y1) with alternate: the texts of b that overlap it vertically, in order, and agrees: whether both say the same."""
    other = b.select(*keys, F.col("y0").alias("_y0"), F.col("y1").alias("_y1"), F.struct(F.col(order).alias("o"), F.col(text).alias("t")).alias("_alt"))
    hit = (F.least("y1", "_y1") - F.greatest("y0", "_y0")) > 0
    own = [c for c in a.columns if c not in keys]
    d = a.join(other, keys, "left").withColumn("_alt", F.when(hit, F.col("_alt")))
    d = d.groupBy(*keys, *own).agg(F.sort_array(F.collect_list("_alt")).alias("_alts"))
    d = d.withColumn("alternate", F.array_join(F.transform("_alts", lambda x: x["t"]), " ")).drop("_alts")
    return d.withColumn("agrees", ocr_normal(F.col(text)) == ocr_normal(F.col("alternate")))


def in_region(rows: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """rows (x0, x1, top, baseline) in a region (rx0, rx1, ry0, ry1) of their page."""
    d = rows.join(regions, page)
    return d.filter((F.col("baseline") >= F.col("ry0")) & (F.col("top") < F.col("ry1") - 0.01) & (F.col("x1") > F.col("rx0")) & (F.col("x0") < F.col("rx1")))


def unique_lower(satellites: DataFrame, bodies: DataFrame, page: str, key: str, near: float = 0.7, far: float = 6.5, slack: float = 10.0, font: float = 14.0) -> DataFrame:
    """satellites with the one body row (key as body_key) that stands more than `near` and at most `far` below and reaches around them; none if several do."""
    b = bodies.filter(F.col("font") >= font).select(page, F.col(key).alias("body_key"), F.col("baseline").alias("_b"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    down = F.col("_b") - F.col("baseline")
    d = satellites.join(b, page).filter((down > near) & (down <= far) & (F.col("_x0") - slack <= F.col("x0")) & (F.col("_x1") + slack >= F.col("x1")))
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy(page, key)))
    return d.filter("_n = 1").drop("_b", "_x0", "_x1", "_n")


def believed_box(box: Column, reliable: Column, height: Column) -> Column:
    """The box of an aligned row if the pair is reliable and its height is one of a line."""
    return F.when(reliable & height.between(*HEIGHTS), box)


def anchored_rows(fragments: DataFrame, page: str, y: str, order: str, tolerance: float = 0.7) -> DataFrame:
    """fragments with row_no: a fragment more than `tolerance` off the first one of the row opens a new row.

    Fragments stream through a task in order, and only the first one of a row is kept, so a page may be as long as it likes.
    Fragments without y stand at the end, in the last row of their page."""

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, anchor, n = None, None, 0
        for p in batches:
            rows = []
            for key, v in zip(p["_page"], p[y], strict=True):
                if key != at:
                    at, anchor, n = key, v, 1
                elif v is not None and abs(anchor - v) > tolerance:
                    anchor, n = v, n + 1
                rows.append(n)
            yield p.drop(columns="_page").assign(row_no=pd.array(rows, "int32"))

    keyed = fragments.withColumn("_page", F.coalesce(F.col(page).cast("string"), F.lit("\0null")))
    schema = fragments.withColumn("row_no", F.lit(0)).schema
    dealt = keyed.repartition(tasks_for(fragments), "_page").sortWithinPartitions("_page", F.asc_nulls_last(y), order)
    return dealt.mapInPandas(lambda batches: cluster(batches), schema)


def rejoined_rows(rows: DataFrame, page: str, reach: int = 4) -> DataFrame:
    """rows (order, x0, y0, x1, y1, text) with line_no: columns of one printed line, joined to the latest of the last few
    lines that they overlap by more than half of the lower height; much higher rows and short bracketed ones stay alone.

    Rows stream through a task in order, and only the last few lines are kept, so a page may be as long as it likes."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, lines = None, 0, []  # the page, its lines so far, and of the last ones: number, y0, y1, alone
        for p in batches:
            out = []
            for key, y0, y1, text in zip(p["_page"], p["y0"], p["y1"], p["text"], strict=True):
                if key != at:
                    at, n, lines = key, 0, []
                alone = len(text or "") < 18 and ("[" in (text or "") or "]" in (text or ""))
                for line in reversed(lines):
                    low, high = sorted((line[2] - line[1], y1 - y0))
                    if not alone and not line[3] and high < 2 * low and min(line[2], y1) - max(line[1], y0) > low / 2:
                        line[1:3] = min(line[1], y0), max(line[2], y1)
                        break
                else:
                    line = [n, y0, y1, alone]
                    lines = [*lines[1 - reach :], line] if reach > 1 else [line]
                    n += 1
                out.append(line[0])
            yield p.drop(columns="_page").assign(line_no=pd.array(out, "int32"))

    keyed = rows.withColumn("_page", F.coalesce(F.col(page).cast("string"), F.lit("\0null")))
    schema = rows.withColumn("line_no", F.lit(0)).schema
    return keyed.repartition("_page").sortWithinPartitions("_page", "order").mapInPandas(lambda batches: join(batches), schema)


def align_in_order(wanted: list[str], found: list[str], skip: float = SKIP, unmatched: float = UNMATCHED, scale: float = SCALE) -> list[tuple[int, float] | None]:
    """For each wanted text the place of the found one that it is, and their similarity, so that the order holds and the
    total cost is least: of a skipped found text, of an unmatched wanted one, and of the dissimilarity of a pair. Of equal
    costs, a pair comes before an unmatched text and that before a skipped one.

    States (texts behind us on both sides) are taken up in the order of the least total that they allow, as the surplus of
    one side must be skipped or stay unmatched. Texts are compared when the bound by their lengths has its turn, so
    alignments that are nearly right compare little more than their own pairs."""
    n, m = len(wanted), len(found)
    known: dict[tuple[str, str], float] = {}

    def alike(a: str, b: str) -> float:
        if a == b:
            return 1.0
        if (a, b) not in known:
            known[a, b] = ratio(a, b)
        return known[a, b]

    def bound(a: str, b: str) -> float:
        return 1.0 if a == b else 2 * min(len(a), len(b)) / max(len(a) + len(b), 1)

    def least(so_far: float, i: int, j: int) -> float:
        """The least total of a state; rounded, so that ties are ties."""
        more = (m - j) - (n - i)
        return round(so_far + (more * skip if more > 0 else -more * unmatched), 9)

    cost: dict[tuple[int, int], float] = {}
    best = float("inf")
    # least total; whether a pair has still to be compared; of ties, later states first; the cost so far; the state
    queue = [(least(0.0, 0, 0), False, 0, 0.0, 0, 0)]
    while queue:
        total, open_, _, so_far, i, j = heappop(queue)
        if total > best + 1e-9:
            break
        if open_:  # the pair that leads here, from (i - 1, j - 1); texts that differ seldom reach their bound
            if total < best - 1e-9:
                so_far = cost[i - 1, j - 1] + (1 - alike(wanted[i - 1], found[j - 1])) * scale
                heappush(queue, (least(so_far, i, j), False, -i - j, so_far, i, j))
            continue
        if so_far >= cost.get((i, j), float("inf")):
            continue
        cost[i, j] = so_far
        if (i, j) == (n, m):
            best = min(best, so_far)
        if i < n and j < m:
            low = so_far + (1 - bound(wanted[i], found[j])) * scale
            heappush(queue, (least(low, i + 1, j + 1), wanted[i] != found[j], -i - j - 2, low, i + 1, j + 1))
        if i < n:
            heappush(queue, (least(so_far + unmatched, i + 1, j), False, -i - j - 1, so_far + unmatched, i + 1, j))
        if j < m:
            heappush(queue, (least(so_far + skip, i, j + 1), False, -i - j - 1, so_far + skip, i, j + 1))
    out: list[tuple[int, float] | None] = [None] * n
    far = float("inf")
    i, j = n, m
    while i and j:
        pair = cost.get((i - 1, j - 1), far)
        if pair < far:
            pair += (1 - alike(wanted[i - 1], found[j - 1])) * scale if pair + (1 - bound(wanted[i - 1], found[j - 1])) * scale <= cost[i, j] + 1e-9 else far
        alone, left = cost.get((i - 1, j), far) + unmatched, cost.get((i, j - 1), far) + skip
        if pair <= min(alone, left) + 1e-12:
            i, j = i - 1, j - 1
            out[i] = (j, alike(wanted[i], found[j]))
        elif alone <= left + 1e-12:
            i -= 1
        else:
            j -= 1
    return out


def longest_rising(values: list[int]) -> list[int]:
    """The places of a longest strictly rising subsequence."""
    tails: list[int] = []  # the smallest value that ends a subsequence of each length
    at: list[int] = []
    before: list[int] = []
    for k, v in enumerate(values):
        n = bisect_left(tails, v)
        before.append(at[n - 1] if n else -1)
        tails[n : n + 1], at[n : n + 1] = [v], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def undisputed(pairs: list[tuple[int, int]], few: int = CROSSED) -> list[int]:
    """The places of pairs (sorted by their first number) that a longest rising chain holds, less those that are crossed by a
    pair outside of it which crosses no more than `few` - there, either may be the right one - and less those whose
    neighbours aren't pairs too, on either side: a line alone may be out of place."""
    chain = longest_rising([j for _, j in pairs])
    lines, sources = [pairs[k][0] for k in chain], [pairs[k][1] for k in chain]
    inside, disputed = set(chain), set()
    for k, (i, j) in enumerate(pairs):
        if k not in inside:
            low, high = sorted((bisect_left(lines, i), bisect_left(sources, j)))
            if high - low <= few:
                disputed.update(range(low, high))
    kept = [k for n, k in enumerate(chain) if n not in disputed]
    there = {pairs[k] for k in kept}
    return [k for k in kept if {(pairs[k][0] - 1, pairs[k][1] - 1), (pairs[k][0] + 1, pairs[k][1] + 1)} & there]


def runs(batches: Iterator[pd.DataFrame], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """The keys (the first columns) of sorted rows, each with its rows. Only the rows of one key are held."""
    rows = (row for p in batches for row in zip(*[p[c].tolist() for c in p.columns], strict=True))
    for key, group in groupby(rows, key=lambda row: row[:keys]):
        yield key, list(group)


def sides(corrected: DataFrame, source: DataFrame) -> DataFrame:
    """The lines of both with _side: 0 for corrected ones, 1 for those of the source."""
    return corrected.withColumn("_side", F.lit(0)).unionByName(source.withColumn("_side", F.lit(1)))


def anchors(corrected: DataFrame, source: DataFrame, page: str) -> DataFrame:
    """page, line, source_line: lines that are equal and stand once on either side of their page, as far as their order is
    that of the source (a longest rising subsequence) beyond dispute. Only pairs of numbers go to a page's task, no texts."""
    of = lambda side: F.when(F.col("_side") == side, F.col("line"))
    texts = sides(corrected, source).filter((F.col("text") != "") & F.col(page).isNotNull()).groupBy(page, "text")
    texts = texts.agg(F.min(of(0)).alias("line"), F.min(of(1)).alias("source_line"), F.count(of(0)).alias("_n"), F.count(of(1)).alias("_m"))
    pairs = texts.filter("_n = 1 and _m = 1").select(page, "line", "source_line")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for _, rows in runs(batches, 1):
            out += [rows[k] for k in undisputed([row[1:] for row in rows])]
            if len(out) >= BATCH:
                yield pd.DataFrame(out, columns=[page, "line", "source_line"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[page, "line", "source_line"])

    return by_work(pairs, [page], "line").mapInPandas(lambda batches: chain(batches), pairs.schema)


def by_work(d: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """d dealt by keys, in order within them. The number of tasks is stated, as their work is far more than their bytes."""
    return d.repartition(4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *order)


def normal_lines(lines: DataFrame, page: str) -> DataFrame:
    """page, line, and the normal form of the text, which is empty for none."""
    return lines.select(page, F.col("line").cast("long").alias("line"), F.coalesce(ocr_normal(F.col("text"), True), F.lit("")).alias("text"))


def aligned_rows(corrected: DataFrame, source: DataFrame, page: str, reliable: float = RELIABLE, normal: bool = False) -> DataFrame:
    """page, line, source_line, score, reliable for the corrected lines (line, text) against the source's, page by page, by
    their normal forms. Lines that are `normal` already (of normal_lines, and staged) are taken as they are.

    Anchors pair off at once and cut a page into blocks. Blocks stream through tasks in order, those of both sides are
    aligned each on its own, so what a task holds is what lies between two anchors."""
    a, b = (corrected, source) if normal else (staged(normal_lines(corrected, page), "align-wanted"), staged(normal_lines(source, page), "align-source"))
    fixed = staged(anchors(a, b, page), "align-anchors")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []

        def frame() -> pd.DataFrame:
            at, line, source_line, score, sure = zip(*out, strict=True)
            return pd.DataFrame({page: at, "line": line, "source_line": pd.array(source_line, "Int64"), "score": score, "reliable": sure})

        for (at, _), rows in runs(batches, 2):
            wanted, found = ([row[3:] for row in rows if row[2] == side] for side in (0, 1))
            got = align_in_order([x[1] for x in wanted], [x[1] for x in found]) if wanted and found else [None] * len(wanted)
            out += [(at, x[0], None, None, False) if g is None else (at, x[0], found[g[0]][0], round(g[1], 3), g[1] >= reliable) for x, g in zip(wanted, got, strict=True)]
            if len(out) >= BATCH:
                yield frame()
                out = []
        if out:
            yield frame()

    # the lines between anchors, with the number of anchors of their page before them
    both = sides(a, b).withColumn("_mark", F.lit(0))
    marks = sides(fixed.select(page, "line"), fixed.select(page, F.col("source_line").alias("line"))).withColumns({"text": F.lit(None).cast("string"), "_mark": F.lit(1)})
    w = Window.partitionBy(page, "_side").orderBy("line", F.desc("_mark")).rowsBetween(Window.unboundedPreceding, 0)
    # an anchor's own line stands behind its mark, and is left out
    cut = both.filter(F.col(page).isNotNull()).unionByName(marks).withColumns({"_block": F.sum("_mark").over(w), "_own": F.max("_mark").over(Window.partitionBy(page, "_side", "line"))})
    cut = cut.filter((F.col("_mark") == 0) & (F.col("_own") == 0)).select(page, "_block", "_side", "line", "text")
    kind = a.schema[page].dataType.simpleString()
    between = by_work(cut, [page, "_block"], "_side", "line").mapInPandas(lambda batches: align(batches), f"{page} {kind}, line long, source_line long, score double, reliable boolean")
    paired = fixed.select(page, "line", "source_line", F.lit(1.0).alias("score"), F.lit(1.0 >= reliable).alias("reliable"))
    unplaced = a.filter(F.col(page).isNull()).select(page, "line", F.lit(None).cast("long").alias("source_line"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("reliable"))
    return paired.unionByName(between).unionByName(unplaced)
