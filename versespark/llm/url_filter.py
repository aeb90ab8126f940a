"""URL filters: prefix rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table (host, path, blocked 0/1). All features, the fit and the scoring
are Spark ML transformers, so scoring is a narrow map over the pages.

Defined results: a null url or one without "://" has an empty host and path and is judged by the model on its lengthless
features (the intercept); repeated rows are judged each; other columns pass through. A labelled table without rows
allows everything; one with a single class gives that class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

#: Labelled URLs that a model is fitted on at most; those with the smallest hashes are taken.
TRAIN_ROWS = 20_000
NGRAM, BUCKETS = 3, 1 << 14


@dataclass(frozen=True)
class Rule:
    """`host` + `path` ("example.org/es/") and whether it blocks."""

    text: str
    block: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and whether it blocks; nulls if none fits. A rule fits its host and all subdomains."""
    name, block = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, block = F.when(fits, F.lit(r.text)).otherwise(name), F.when(fits, F.lit(r.block)).otherwise(block)
    return name, block


def _features(df: DataFrame, host: str, path: str, out: str) -> DataFrame:
    """Hashed n-gram counts of "^host/" and of the path, each with its own marks at both ends."""
    chars, grams = fresh(df, "url_chars", "url_grams")
    marked = F.concat(F.lit("^"), F.col(host), F.lit("|"), F.lower(F.col(path)), F.lit("$"))
    df = df.withColumn(chars, F.split(marked, ""))
    df = NGram(n=NGRAM, inputCol=chars, outputCol=grams).transform(df)
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol=grams, outputCol=out).transform(df).drop(chars, grams)


class UrlModel:
    """A fitted model, or a constant where the labels have fewer than two classes."""

    def __init__(self, model, constant: float):
        self.model, self.constant = model, constant

    def score(self, df: DataFrame, host: str, path: str, out: str) -> DataFrame:
        """`df` with the probability that a url is to be blocked."""
        if self.model is None:
            return df.withColumn(out, F.lit(self.constant))
        from pyspark.ml.functions import vector_to_array

        feats, raw, prob, pred = fresh(df, "url_features", "url_raw", "url_prob", "url_pred")
        m = self.model.copy().setFeaturesCol(feats).setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(pred)
        scored = m.transform(_features(df, host, path, feats))
        return scored.withColumn(out, vector_to_array(prob)[1]).drop(feats, raw, prob, pred)


def train(labelled: DataFrame, host: str = "host", path: str = "path", blocked: str = "blocked", rows: int = TRAIN_ROWS) -> UrlModel:
    """Fit on at most `rows` labelled urls. Distinct urls with nulls in no column count; the smallest hashes are taken."""
    few = labelled.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(blocked).cast("double").alias("label")).na.drop().distinct()
    few = staged(few.orderBy(F.xxhash64("host", "path", "label"), "host", "path", "label").limit(rows), "labelled-urls")
    classes = {r["label"]: r["count"] for r in few.groupBy("label").count().collect()}
    if len(classes) < 2:
        return UrlModel(None, next(iter(classes), 0.0))
    # the two classes weigh the same, else the more frequent one swamps unseen hosts
    total = sum(classes.values())
    weight = F.when(F.col("label") == 1.0, total / (2 * classes[1.0])).otherwise(total / (2 * classes[0.0]))
    data = _features(few, "host", "path", "features").withColumn("weight", weight)
    return UrlModel(LogisticRegression(regParam=0.01, maxIter=30, weightCol="weight").fit(data), 0.0)


def held_out_accuracy(labelled: DataFrame, folds: int = 4) -> float:
    """The share of labelled urls that are judged right by models fitted without any url of their host."""
    fold = F.pmod(F.xxhash64("host"), F.lit(folds))
    right = total = 0
    for k in range(folds):
        model = train(labelled.filter(fold != k))
        got = model.score(labelled.filter(fold == k), "host", "path", "score").agg(F.count("*").alias("n"), F.count_if((F.col("score") >= 0.5) == (F.col("blocked") == 1)).alias("right")).first()
        right, total = right + got["right"], total + got["n"]
    return right / max(total, 1)


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict; columns of those names in `pages` are replaced."""
    host, path = url_parts(F.col(url))
    df = pages.withColumns({"host": host, "path": path})
    block, score = fresh(df, "rule_blocks", "block_score")
    name, blocks = matched_rule(F.col("host"), F.col("path"), rules)
    df = model.score(df.withColumns({"rule": name, block: blocks}), "host", "path", score)
    verdict = F.when(F.coalesce(F.col(block), F.col(score) >= 0.5), "block").otherwise("allow")
    return df.withColumn("verdict", verdict).drop(block, score)

