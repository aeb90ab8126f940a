"""Importance resampling towards a target distribution, on hashed n-gram counts.

A text is lower-cased (A-Z only), runs of separators become single spaces, and an overlapped regular expression between
two boundary look-arounds gives the span of every n-gram, one pattern for each length. A span's bytes are counted under
their CRC-32, modulo the number of buckets. Texts pass through Python once; their counts are written down, and all that
follows is done on them by built-in functions: the buckets' totals, their gains, the documents' weights and the draw.

A bucket's gain is the logarithm of how much likelier the target has it, in thousandths; a document's weight is the mean
gain of its features. The draw is without replacement: each document adds Gumbel noise, which follows from its id and the
seed alone, and the highest sums win. Sums are whole numbers within some 60,000 values, so a small table of counts by sum
tells where the draw ends and at which rank each sum begins; only rows of equal sums are put in order together.

Defined results: a null or empty text has no features and weight 0; repeated rows are weighed and drawn each, in any
order among themselves; a null id counts as an empty one in the noise and comes last in ties; an empty table gives an
empty result, and an empty target leaves the gains to the smoothing; other columns pass through, those that are named
like results are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, staged

#: Buckets, words of the longest n-gram, the words that a document needs to be drawn, the percent that is drawn, the seed.
BUCKETS, WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: UTF-8 bytes with A-Z in lower case, and a space for what separates words.
FLAT = bytes(c if chr(c).isdigit() or chr(c).islower() or c >= 0x80 else c + 32 if chr(c).isupper() else 0x20 for c in range(256))


def gram_patterns(longest: int) -> list[regex.Pattern]:
    """For each length the pattern of n-grams in a text whose words stand between single spaces."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(1, longest + 1)]


def collapsed(text: str | None) -> bytes:
    """The words of a text in lower case, between single spaces."""
    return b" ".join((text or "").encode().translate(FLAT).split())


def hashed_grams(flat: bytes, patterns: list[regex.Pattern]) -> list[int]:
    """The CRC-32 of each n-gram of a collapsed text, the shortest n-grams first."""
    return [zlib.crc32(m[0]) for p in patterns for m in p.finditer(flat, overlapped=True)]


def counts(texts: DataFrame, text: str = "text", longest: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """The rows of `texts` without the text, in a struct `row`, with n_words, n_features and their counts by bucket."""
    rest = [c for c in texts.columns if c != text]
    df = texts.select(F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("row"), F.col(f"`{text}`").alias("text"))
    patterns = gram_patterns(longest)

    @F.pandas_udf("n_words long, n_features long, buckets array<int>, times array<int>")
    def counted(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for t in batch:
            flat = collapsed(t)
            ids = np.array(hashed_grams(flat, patterns), np.uint32) % buckets
            kinds, times = np.unique(ids, return_counts=True)
            rows.append((flat.count(b" ") + 1 if flat else 0, len(ids), kinds, times))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "buckets", "times"])

    return df.select("row", counted("text").alias("c")).select("row", "c.*")


def totals(counted: DataFrame, name: str) -> DataFrame:
    """bucket and its count over all rows."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "times")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum(F.col("x.times").cast("long")).alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket. Both totals have at most `buckets` rows."""
    both = totals(raw, "s").join(totals(target, "t"), "bucket", "full").na.fill(0)
    found = staged(both, "bucket-totals")
    all_s, all_t = (x or 0 for x in found.agg(F.sum("s"), F.sum("t")).first())
    odds = (F.col("t") + 1).cast("double") * float(all_s + buckets) / ((F.col("s") + 1).cast("double") * float(all_t + buckets))
    gain = lambda x: F.floor(1000 * F.log(x)).alias("gain")
    none = found.sparkSession.range(1).select(gain(F.lit(float(all_s + buckets)) / float(all_t + buckets))).first()["gain"]
    out = [none] * buckets
    for r in found.select("bucket", gain(odds)).collect():
        out[r["bucket"]] = r["gain"]
    return out


def weight(gain: list[int]) -> Column:
    """The floored mean gain of a row of `counts`."""
    # one folded constant, however many buckets there are
    table = F.from_json(F.lit(str(gain)), "array<long>")
    total = F.aggregate(F.arrays_zip("buckets", "times"), F.lit(0).cast("long"), lambda a, x: a + F.get(table, x["buckets"]) * x["times"])
    return F.when(F.col("n_features") > 0, let(total, lambda s: F.floor((s - F.pmod(s, F.col("n_features"))) / F.col("n_features")))).otherwise(0).cast("long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the id and the seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, doc_id: str, n_words: str = "n_words", score: str = "score", least: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """`scored` with `rank`: 1, 2, 3... by falling score, ties by id, for the share that is drawn of rows with enough words."""
    fit, begins, within, ends = fresh(scored, "fit", "begins", "within", "ends")
    by_score = staged(scored.filter(F.col(n_words) >= least).groupBy(score).agg(F.count("*").alias(begins)), "draw-scores")
    draw = (by_score.agg(F.sum(begins)).first()[0] or 0) * percent // 100
    # one row for each score, whose values are bounded
    run = F.sum(begins).over(Window.orderBy(F.desc(score)))
    starts = by_score.select(score, F.col(begins).alias(ends), (run - F.col(begins)).alias(begins)).filter(F.col(begins) < draw)
    starts = staged(starts, "draw-starts")
    found = scored.withColumn(fit, F.col(n_words) >= least).join(F.broadcast(starts.withColumn(fit, F.lit(True))), [score, fit], "left")
    order = Window.partitionBy(score).orderBy(F.col(doc_id).asc_nulls_last())
    cols = [c for c in scored.columns if c != "rank"]
    inside = found.filter(F.col(begins).isNotNull()).withColumn(within, F.row_number().over(order) + F.col(begins))
    rank = lambda c: c.cast("long").alias("rank")
    outside = found.filter(F.col(begins).isNull()).select(*cols, rank(F.lit(None)))
    return inside.select(*cols, rank(F.when(F.col(within) <= draw, F.col(within)))).unionByName(outside)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = WORDS, buckets: int = BUCKETS, least: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """`docs` without the text, with n_words, n_features, weight, score and rank (null: not drawn). `target` has a column `text`.

    The drawn documents themselves are what a join of their ids with `docs` gives."""
    raw = staged(counts(docs, text, longest, buckets), "bucket-counts")
    gain = gains(raw, counts(target.select("text"), "text", longest, buckets), buckets)
    w = raw.select("row.*", F.struct("n_words", "n_features", weight(gain).alias("weight")).alias("__found"))
    keep = [c for c in docs.columns if c != text and c.lower() not in ("n_words", "n_features", "weight", "score", "rank")]
    cols = [F.col(f"`{c}`") for c in keep]
    scored = w.select(*cols, "__found.*", (F.col("__found.weight") + noise(F.col(doc_id), seed)).alias("score"))
    return drawn(staged(scored, "draw-weights"), doc_id, least=least, percent=percent)
