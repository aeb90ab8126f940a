"""Approximate nearest neighbours by a permutation index.

Largest inner products become smallest angles: a vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest
norm, and a query gets 0. Pivots are a bounded sample of the vectors' directions. A vector is represented by its nearest
pivots in order. The index is dealt into shards of rows; a shard posts its vectors in one inverted file for each pivot,
with the pivot's place in the vector's order. A query walks the files of its own first pivots and adds up, for each vector
it meets, how much less than the greatest possible the footrule distance of the two orders is. The best `share` of a
shard's vectors by that distance, with all that tie with the last of them, are reranked by inner product, and the best k
of each shard are merged.

Queries and shards are both dealt in blocks, so a task holds a bounded number of each. Vectors that are equal have equal
orders and equal scores, so ties go to the smaller id whatever the shard.

A share of a tenth, with 1,024 pivots, 256 places of vectors and 32 of queries, finds over nine tenths of the true
neighbours of vectors without clusters, be their norms equal or not (tests compare with brute force). It doesn't depend
on the row count. More places of a query cost more and find less: its later pivots say little.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, as queries or
candidates; vectors of another length are another space, and are searched among themselves; ids that occur more than
once are candidates each, but never for a query of the same id; fewer candidates than k give what there is; a null id
takes no part; other columns of the table don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged

#: Pivots at most, places that are kept of a vector's order and of a query's, the share of a shard that is reranked.
PIVOTS, PLACES, ASKED, SHARE = 1024, 256, 32, 0.1
#: Rows of a shard, and queries of a block.
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def pivots_of(vectors: DataFrame, n: int = PIVOTS) -> dict[int, tuple[np.ndarray, float]]:
    """For each length of vectors the greatest norm, and at most `n` pivots: the vectors with the smallest hashes, each
    once. One pass counts, another takes the few rows whose hashes are small enough."""
    h = F.xxhash64("vec")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    sizes = vectors.groupBy("dim").agg(F.max(norm).alias("norm"), F.approx_count_distinct(h).alias("n")).collect()
    span = lambda r: int(-(1 << 63) + min(1.0, 4 * n / max(r["n"], 1)) * ((1 << 64) - 4096))
    upto = F.create_map(*[F.lit(x) for r in sizes for x in (r["dim"], span(r))])[F.col("dim")] if sizes else F.lit(0)
    w = Window.partitionBy("dim").orderBy("h")
    few = vectors.withColumn("h", h).filter(F.col("h") <= upto).groupBy("dim", "h").agg(F.min("vec").alias("vec"))
    few = few.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).orderBy("dim", "r").collect()
    out = {}
    for r in sizes:
        top = r["norm"]
        x = np.array([f["vec"] for f in few if f["dim"] == r["dim"]], float).reshape(-1, r["dim"])
        out[r["dim"]] = (lengthened(x, top) / top, top)
    return out


def lengthened(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that gives all of them the norm `top`."""
    rest = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0.0))
    return np.concatenate([x, rest[:, None]], 1)


def orders(x: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The numbers of the nearest pivots of each row, nearest first; ties go to the smaller number. Rows are rounded alike
    whatever block they are in."""
    sim = np.round(x @ pivots.T / np.linalg.norm(x, axis=1, keepdims=True), 9)
    # pivots that tie with the last place are sorted out by their number too
    last = -np.partition(-sim, min(places, sim.shape[1]) - 1, axis=1)[:, min(places, sim.shape[1]) - 1]
    out = np.empty((len(x), min(places, sim.shape[1])), np.int16)
    for i, row in enumerate(sim):
        near = np.flatnonzero(row >= last[i])
        out[i] = near[np.argsort(-row[near], kind="stable")][: out.shape[1]]
    return out


class InvertedFiles:
    """A shard: for each pivot the rows that have it among their nearest, and its place there."""

    def __init__(self, order: np.ndarray, n_pivots: int):
        self.n, self.places = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.at = (by // self.places).astype(np.int32), (by % self.places).astype(np.int32)
        self.ends = np.searchsorted(flat[by], np.arange(n_pivots + 1)).tolist()

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """For each row, places * shared pivots less the sum of the differences of their places: the footrule distance
        counts a missing pivot as one behind all places, so most agreement is least distance."""
        score = np.zeros(self.n, np.int32)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.ends[pivot], self.ends[pivot + 1]
            score[self.rows[a:b]] += self.places - np.abs(self.at[a:b] - place)
        return score


def _search(q: pd.DataFrame, x: pd.DataFrame, n_pivots: int, k: int, share: float) -> pd.DataFrame:
    """The best k rows of a shard for each query of a block."""
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    if not len(q) or not len(x):
        return empty
    vec, ids = np.array(x["vec"].tolist(), float), x["vec_id"].to_numpy()
    files = InvertedFiles(np.array(x["near"].tolist(), np.int64), n_pivots)
    take = min(len(x), max(4 * k, int(np.ceil(share * len(x)))))
    queries, found, scores = [], [], []
    for qid, qv, near in zip(q["vec_id"].tolist(), np.array(q["vec"].tolist(), float), q["near"], strict=True):
        agree = files.agreement(np.asarray(near, np.int64))
        agree[ids == qid] = -1
        least = max(np.partition(agree, len(agree) - take)[len(agree) - take], 0)
        c = np.flatnonzero(agree >= least)
        mine = vec[c]
        rough = mine @ qv
        if len(c) > k:  # what can be among the best k; the exact scores follow
            at = np.flatnonzero(rough >= np.partition(rough, len(c) - k)[len(c) - k] - 1e-9 * max(1.0, np.abs(rough).max()))
            c, mine = c[at], mine[at]
        score = (mine * qv).sum(1)
        best = np.lexsort((ids[c], -score))[:k]
        queries.append(np.full(len(best), qid))
        found.append(ids[c][best])
        scores.append(score[best])
    return pd.DataFrame({"query_id": np.concatenate(queries), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", pivots: int = PIVOTS, places: int = PLACES, asked_places: int = ASKED, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row for which `is_query` holds."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"), is_query.alias("is_query"))
    v = v.filter(usable(F.col("vec")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("vec"))
    bounded_batches(vectors.sparkSession, 5000)
    chosen = pivots_of(v, pivots)
    if not chosen:
        return v.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)

    def represent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                p, top = chosen[dim]
                x, asks = np.array(part["vec"].tolist(), float), part["is_query"].to_numpy(bool)
                near = list(orders(lengthened(x, top), p, places))
                asked: list = [None] * len(x)
                if asks.any():
                    flat = np.concatenate([x[asks], np.zeros((asks.sum(), 1))], 1)
                    for i, order in zip(np.flatnonzero(asks).tolist(), orders(flat, p, asked_places), strict=True):
                        asked[i] = order
                yield part.assign(near=near, asked=asked)

    index = staged(v.withColumn("is_query", F.coalesce("is_query", F.lit(False))).mapInPandas(represent, "vec_id long, vec array<double>, is_query boolean, dim int, near array<short>, asked array<short>"), "permutations")
    sizes = {r["dim"]: (r["n"], r["q"]) for r in index.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()}
    # a space's shards and blocks follow from its rows and queries
    shards = F.create_map(*[F.lit(x) for d, (n, _) in sizes.items() for x in (d, -(-n // SHARD_ROWS))])[F.col("dim")]
    blocks = F.create_map(*[F.lit(x) for d, (_, q) in sizes.items() for x in (d, max(1, -(-q // BLOCK_QUERIES)))])[F.col("dim")]
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys, cols = ["dim", "shard", "block"], ["dim", "shard", "block", "vec_id", "vec", "near"]
    rows = index.withColumn("shard", part(shards, 1)).withColumn("block", every(blocks)).select(cols)
    asked = index.filter("is_query").withColumn("near", F.col("asked")).withColumn("block", part(blocks, 2)).withColumn("shard", every(shards)).select([F.col(c).alias(c) for c in cols])
    n_pivots = {d: len(p) for d, (p, _) in chosen.items()}

    def search(key, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _search(q, x, n_pivots[key[0]], k, share)

    found = rows.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
