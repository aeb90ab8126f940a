"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The cell table is raked: it is scaled to the target share of each
source, then of each language, then of each topic, again and again until all shares hold. A cell's weight is its raked
tokens over its own. Weights are calibrated to inclusion probabilities, weight times a factor and at most 1, so that the
expected tokens reach the budget, and each document is drawn by a hash of its id. A draw repeats exactly when a lost
task is run again.

Targets that contradict one another (a category that is only found with others of too small a share) can't all hold.
Raking ends after ROUNDS rounds then, with the last margin exact, and `converged` is false: a share was still off by
ERROR or more in the last round.

The number of cells is a product of category counts. Up to CELLS of them are raked on the driver, which holds three
numbers for each; larger tables are raked by the same steps as grouped aggregations.

Defined results: null categories are categories of their own; documents without tokens take the probability of their
cell, of 1 if its weight is undefined; targets are scaled to the categories that are there, and categories without a
target share what the others leave; rows with the same id are drawn alike, null ids by their text; an empty table stays
empty; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, small_enough, staged

MARGINS = ["source", "lang", "topic"]
#: Cells that are raked on the driver at most; rounds at most, and the largest error of a share that ends them.
CELLS, ROUNDS, ERROR = 100_000, 50, 1e-9
NULL = "\0null"
SPACE = r"\x20\x09-\x0D"


def tokens_of(text: Column) -> Column:
    """Words of a text, as the measure of its length."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def form_of(text: Column) -> Column:
    """The topic of documents that come without one: the form of their text. "list" has short lines, "data" many digits,
    "markup" many symbols; the rest is "prose". It is measured on the whole text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    per_cent = lambda chars: 100 * F.regexp_count(t, F.lit(chars))
    lines = F.regexp_count(t, F.lit("\n")) + 1
    return F.when(per_cent(r"[#*$%&|<>{}]") > 2 * n, "markup").when(per_cent("[0-9]") > 5 * n, "data").when(n < 60 * lines, "list").otherwise("prose")


def targets(cells: DataFrame, margin: str, given: dict[str, float]) -> DataFrame:
    """category, target (shares that sum to 1) of a margin, for the categories that are there."""
    spark = cells.sparkSession
    there = cells.groupBy(F.col(margin).alias("category")).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")
    named = spark.createDataFrame([(str(k), float(v)) for k, v in given.items()] or [("", 0.0)], "category string, share double").dropDuplicates(["category"])
    t = there.join(small_enough(named), "category", "left")
    sums = t.agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("given"), F.sum(F.when(F.col("share").isNull(), F.col("tokens"))).alias("others")).first()
    # the others share the rest by their tokens; if there are none, or no rest, what is given is scaled to 1
    rest = max(1 - sums["given"], 0.0)
    share = F.coalesce(F.col("share"), F.lit(rest) * F.col("tokens") / F.lit(sums["others"]))
    total = sums["given"] + rest if sums["others"] is not None else sums["given"]
    return t.select("category", (share / F.lit(total)).alias("target"))


def rake_rows(cells: list[tuple], want: list[dict[str, float]]) -> tuple[list[float], float]:
    """Raked tokens of the cells (one category for each margin, then tokens), on the driver, and the largest error of a share
    in the last round."""
    total = sum(c[-1] for c in cells)
    x = [float(c[-1]) for c in cells]
    worst = 0.0
    for _ in range(ROUNDS):
        worst = 0.0
        for m, shares in enumerate(want):
            sums: dict[str, float] = {}
            for c, v in zip(cells, x, strict=True):
                sums[c[m]] = sums.get(c[m], 0.0) + v
            for k, v in sums.items():
                worst = max(worst, abs(v / total - shares.get(k, 0.0)))
            scale = {k: shares.get(k, 0.0) * total / v if v else 0.0 for k, v in sums.items()}
            x = [v * scale[c[m]] for c, v in zip(cells, x, strict=True)]
        if worst < ERROR:
            break
    return x, worst


def rake_frame(cells: DataFrame, want: list[DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """The same as grouped aggregations: cells with a column `raked`."""
    total = cells.agg(F.sum("tokens")).first()[0]
    worst = 0.0
    d = cells.withColumn("raked", F.col("tokens").cast("double"))
    for _ in range(rounds):
        worst = 0.0
        for margin, t in zip(MARGINS, want, strict=True):
            sums = d.groupBy(margin).agg(F.sum("raked").alias("sum")).join(t.withColumnRenamed("category", margin), margin, "left").na.fill(0.0, ["target"])
            sums = staged(sums, "margin")
            worst = max(worst, sums.agg(F.max(F.abs(F.col("sum") / total - F.col("target")))).first()[0])
            scale = sums.select(margin, F.coalesce(F.try_divide(F.col("target") * F.lit(float(total)), "sum"), F.lit(0.0)).alias("scale"))
            d = d.join(small_enough(scale), margin).withColumn("raked", F.col("raked") * F.col("scale")).drop("scale")
        d = staged(d, "raked")
        if worst < ERROR:
            break
    return d, worst


def calibrated(cells: DataFrame, budget: float, steps: int = 60) -> DataFrame:
    """cells with `weight` and `probability`: weight times one factor, at most 1, so that expected tokens are `budget` of
    all tokens. The factor is found by bisection on aggregates of the cells."""
    d = cells.withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")))
    top = d.agg(F.sum("tokens").alias("tokens"), F.min(F.when(F.col("weight") > 0, F.col("weight"))).alias("least")).first()
    if not top["tokens"] or top["least"] is None:
        return d.withColumn("probability", F.lit(1.0))
    goal, low, high = budget * top["tokens"], 0.0, 1.0 / top["least"]
    few = d.filter("weight > 0").groupBy("weight").agg(F.sum("tokens").alias("tokens"))
    local = [(r["weight"], r["tokens"]) for r in few.limit(CELLS + 1).collect()]
    for _ in range(steps):
        c = (low + high) / 2
        got = sum(t * min(1.0, w * c) for w, t in sorted(local)) if len(local) <= CELLS else few.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * c))).first()[0]
        low, high = (c, high) if got < goal else (low, c)
    return d.withColumn("probability", F.coalesce(F.least(F.lit(1.0), F.col("weight") * high), F.lit(1.0)))


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: 48 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def cell_weights(docs: DataFrame, want: dict[str, dict[str, float]], budget: float, cols: dict[str, Column], tokens: Column) -> DataFrame:
    """source, lang, topic, tokens, raked, weight, probability and converged of each cell of `docs`."""
    named = {m: F.coalesce(cols[m].cast("string"), F.lit(NULL)).alias(m) for m in MARGINS}
    cells = staged(docs.select(*named.values(), tokens.alias("tokens")).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "cells")
    shares = [targets(cells, m, want.get(m, {})) for m in MARGINS]
    full = cells.filter("tokens > 0").orderBy(*MARGINS)
    rows = full.select(*MARGINS, "tokens").limit(CELLS + 1).collect()
    if len(rows) <= CELLS:
        wanted = [{r["category"]: r["target"] for r in s.collect()} for s in shares]
        raked, worst = rake_rows([tuple(r) for r in rows], wanted)
        spark: SparkSession = docs.sparkSession
        x = spark.createDataFrame([(*r[:3], v) for r, v in zip(rows, raked, strict=True)], "source string, lang string, topic string, raked double")
    else:
        x, worst = rake_frame(full.select(*MARGINS, "tokens"), [staged(s, "targets") for s in shares])
        x = x.drop("tokens")
    return calibrated(cells.join(small_enough(x), MARGINS, "left"), budget).withColumn("converged", F.lit(worst < ERROR))


def mix(docs: DataFrame, want: dict[str, dict[str, float]], budget: float = 0.5, doc_id: str = "doc_id", text: str = "text", source: Column | None = None, lang: Column | None = None, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """All rows of `docs` with a struct column `mix`: topic, tokens, weight, probability, converged and drawn. A column of
    that name in `docs` is replaced.

    `want` has the target shares of categories by margin ("source", "lang", "topic"); `budget` is the expected share of
    tokens that is drawn."""
    text_col = F.col(text)
    cols = {"source": source if source is not None else F.col("source"), "lang": lang if lang is not None else F.col("lang"), "topic": topic if topic is not None else form_of(text_col)}
    count = tokens if tokens is not None else tokens_of(text_col)
    cells = staged(cell_weights(docs, want, budget, cols, count), "cell-weights")
    (cell, w) = fresh(docs, "mix_cell", "mix_weights")
    weights = cells.select(F.struct(*MARGINS).alias(cell), F.struct("weight", "probability", "converged").alias(w))
    key = F.struct(*[F.coalesce(cols[m].cast("string"), F.lit(NULL)).alias(m) for m in MARGINS])
    d = docs.withColumn(cell, key).join(small_enough(weights), cell, "left")
    p = F.coalesce(F.col(w)["probability"], F.lit(1.0))
    drawn = uniform(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.coalesce(text_col, F.lit(""))))) < p
    return d.withColumn("mix", F.struct(F.col(cell)["topic"].alias("topic"), count.alias("tokens"), F.col(w)["weight"].alias("weight"), p.alias("probability"), F.col(w)["converged"].alias("converged"), drawn.alias("drawn"))).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "mix"], "mix")

