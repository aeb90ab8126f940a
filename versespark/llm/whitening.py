"""Embedding whitening: principal components by contour integration, and rows projected on them at unit variance.

Entries become whole numbers, floor(64 c) + 1,000,000, so that counts, sums and squared deviations are exact. The fit list
is each distinct vector once: one shuffle finds it, and it is written down. Its sums are added up in whole numbers, its
covariance in one more pass from rows that are centred first; a task sends one matrix of dimensions x dimensions, however
many rows it has. The driver solves that matrix for its greatest eigenvalues (feast), and a narrow pass projects all rows.
A third pass over the fit list measures how far the covariance of the whitened vectors is from the identity.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are dropped; vectors of another
length are another space, with a fit of its own; entries beyond +-2^47 count as that; repeated rows are returned each and
fitted once; a null id is kept; a deviation too large for a long is null; components without variance are left out (as
1 / sqrt(0) is undefined), so a space of one distinct vector gives no rows; an empty table gives an empty result; columns
other than the id and the vector don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import feast
from .common import staged

COMPONENTS = 16
UNIT, ZERO, MOST = 64, 1_000_000, float(1 << 47)
LONG = 1 << 63


def whole(v: Column) -> Column:
    """A vector's entries as whole numbers."""
    within = lambda c: F.least(F.greatest(c.cast("double"), F.lit(-MOST)), F.lit(MOST))
    return F.transform(v, lambda c: F.floor(UNIT * within(c)).cast("long") + ZERO)


def whole_rows(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """vec_id, dim, x: the rows that take part."""
    v = F.col(f"`{vec}`")
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    good = vectors.filter(v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, finite), F.lit(False)))
    return good.select(F.col(f"`{vec_id}`").alias("vec_id"), F.size(v).alias("dim"), whole(v).alias("x"))


@dataclass(frozen=True)
class Space:
    """The fit of the vectors of one length: n distinct vectors with sums S, and the components as columns of `to`."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    to: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n for rows of whole numbers."""
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.to / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
        far = max(int(np.abs(x).max()) * self.n, max(map(abs, self.sums))) * 2
        if far * far * len(self.sums) < LONG:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [d if d < LONG else None for d in exact]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding: whole parts of the means are taken off before."""
    floors = np.array([s // n for s in sums], np.int64)
    return (x - floors) - np.array([s % n for s in sums], float) / n


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def per_dim(fit: DataFrame, n_values, schema: str) -> DataFrame:
    """For each length of vectors, the sums over all rows of what `n_values(dim, rows)` gives as a matrix: dim, i, values.
    Sums are made within a task first."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                m = n_values(dim, stacked(part["x"]))
                sums[dim] = sums[dim] + m if dim in sums else m
        for dim, m in sums.items():
            yield pd.DataFrame({"dim": dim, "i": np.arange(len(m)), "m": list(m)})

    # no more matrices than tasks that run at once, however large the table
    spark = fit.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = fit.select("dim", "x").coalesce(tasks).mapInPandas(summed, f"dim int, i int, m array<{schema}>")
    entries = parts.select("dim", "i", F.posexplode("m").alias("j", "m"))
    return entries.groupBy("dim", "i", "j").agg(F.sum("m").alias("m"))


def matrices(sums: DataFrame) -> dict[int, np.ndarray]:
    """The result of per_dim on the driver: as many entries as the lengths of vectors squared, whatever the rows."""
    got = sums.toPandas()
    out = {}
    for dim, part in got.groupby("dim"):
        m = np.zeros((part["i"].max() + 1, part["j"].max() + 1), part["m"].dtype)
        m[part["i"], part["j"]] = part["m"]
        out[int(dim)] = m
    return out


def fit_spaces(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """The fit of each length of vectors, from its distinct vectors."""
    # a sum in two halves of the number, so that neither overflows: x = high * 2^24 + low
    halves = lambda _, x: np.stack([(x >> 24).sum(0), (x & 0xFFFFFF).sum(0)])
    n = {r["dim"]: r["count"] for r in fit.groupBy("dim").count().collect()}
    sums = {d: [int(h) * (1 << 24) + int(low) for h, low in zip(*m.tolist(), strict=True)] for d, m in matrices(per_dim(fit, halves, "long")).items()}

    def products(dim: int, x: np.ndarray) -> np.ndarray:
        c = centred(x, n[dim], sums[dim])
        return c.T @ c

    out = {}
    for dim, m in matrices(per_dim(fit, products, "double")).items():
        v = m / n[dim]
        e, u = feast.greatest(v, components)
        there = e > np.finfo(float).eps * dim * max(e.max(initial=0.0), 0.0)
        out[dim] = Space(n[dim], sums[dim], e[there], u[:, there], float(np.trace(v)))
    return out


def checked(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, Space]:
    """`spaces` with the largest entry of the whitened fit list's covariance less the identity. Components without any
    variance have no entries, and their error is 0."""

    def moments(dim: int, x: np.ndarray) -> np.ndarray:
        w = spaces[dim].whitened(x)
        return np.concatenate([w.T @ w, w.sum(0, keepdims=True)])

    found = matrices(per_dim(fit, moments, "double")) if any(len(s.eigenvalues) for s in spaces.values()) else {}
    out = {}
    for dim, s in spaces.items():
        error, k = 0.0, len(s.eigenvalues)
        if k:
            mean = found[dim][k] / s.n
            error = float(np.abs(found[dim][:k] / s.n - np.outer(mean, mean) - np.eye(k)).max())
        out[dim] = Space(s.n, s.sums, s.eigenvalues, s.to, s.trace, error)
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """For each row that takes part: vec_id, dim, n, deviation, identity_error and parallel arrays `whitened` and `explained`,
    one entry for each component, the first with the greatest variance."""
    rows = whole_rows(vectors, vec_id, vec)
    fit = staged(rows.select("dim", "x").distinct(), "fit-list")
    spaces = checked(fit, fit_spaces(fit, components))
    @F.pandas_udf("n long, deviation long, identity_error double, whitened array<double>, explained array<double>")
    def project(x: pd.Series) -> pd.DataFrame:
        out = [pd.DataFrame({"n": [], "deviation": [], "identity_error": [], "whitened": [], "explained": []})]
        for dim, part in x.groupby(x.str.len()):
            s, m = spaces[dim], stacked(part)
            share = s.eigenvalues / s.trace if len(s.eigenvalues) else s.eigenvalues
            deviation = pd.array(s.deviation(m), "Int64")
            out.append(pd.DataFrame({"n": s.n, "deviation": deviation, "identity_error": s.identity_error, "whitened": list(s.whitened(m)), "explained": [share] * len(m)}, part.index))
        return pd.concat(out[1:] or out).loc[x.index]

    return rows.select("vec_id", "dim", project("x").alias("f")).select("vec_id", "dim", "f.*")


def by_component(whitened: DataFrame) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    d = whitened.select("vec_id", "n", "deviation", "identity_error", pairs)
    return d.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
