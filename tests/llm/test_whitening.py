"""Whitening against a dense eigensolver, and the contour integration against matrices that are hard for it."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from versespark.llm import feast, whitening
from versespark.llm import queries as corpus_queries

SCHEMA = "vec_id long, embedding array<float>"


def brute_force(rows):
    """(vec_id, component) -> n, deviation, whitened, explained for vectors of one length."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array(fit, float) - np.array(sums) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    k = int((e > 1e-12 * max(e.max(), 0)).sum())
    w = (np.array(x, float) - np.array(sums) / n) @ u[:, :k] / np.sqrt(e[:k])
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return n, dev, w, e[:k] / np.trace(v)


def compare(got, rows):
    n, dev, w, explained = brute_force(rows)
    mine = collections.defaultdict(list)
    for r in got:
        mine[r["vec_id"], r["component"]].append(r)
        assert r["n"] == n and r["identity_error"] < 1e-6 and r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    assert len(got) == len(rows) * w.shape[1]
    for c in range(w.shape[1]):
        a = np.array([mine[i, c + 1][0]["whitened"] for i, _ in rows])
        assert min(np.abs(a - w[:, c]).max(), np.abs(a + w[:, c]).max()) < 1e-7
        assert all(mine[i, c + 1][0]["deviation"] == d for (i, _), d in zip(rows, dev, strict=True))


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 20)) * np.exp(rng.normal(size=20))).astype("float32")
    x[40:140] = x[40]  # a third of the rows are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    short = [(1000 + i, v[:3].tolist()) for i, v in enumerate(x[:30])]
    bad = [(2000, None), (2001, []), (2002, [float("nan")] * 20), (2003, [float("inf")] + [1.0] * 19), (2004, [None] + [1.0] * 19), (2005, [1.0, 2.0])]
    d = spark.createDataFrame(rows + short + bad, SCHEMA).withColumns({c: F.lit(1) for c in ("x", "dim", "n", "whitened")}).repartition(5)
    got = whitening.by_component(whitening.whiten(d)).collect()
    compare([r for r in got if r["vec_id"] < 1000], rows)
    compare([r for r in got if r["vec_id"] >= 1000], short)  # one distinct vector of two entries gives no rows
    assert whitening.whiten(d.filter("vec_id = 2001")).count() == 0 and whitening.whiten(d.filter("false")).count() == 0
    twice = d.filter("vec_id < 1000").unionByName(d.filter("vec_id < 5")).withColumn("vec_id", F.when(F.col("vec_id") != 7, F.col("vec_id")))
    again = whitening.by_component(whitening.whiten(twice)).collect()
    assert len(again) == 305 * 16 and {r["n"] for r in again} == {201} and sum(r["vec_id"] is None for r in again) == 16


def test_large_entries(spark):
    rows = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [0.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {0: None, 1: None, 2: (3 * 320 - 384) ** 2}


def test_op11(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r["embedding"] is not None]
    compare(corpus_queries.op11_whitening(spark, folder).collect(), rows)


def spectra():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    yield np.diag([5.0] * 10 + [3.0] * 10 + [0.0] * 20)
    for e in (np.linspace(1, 0, 40), 10.0 ** -np.arange(40), np.ones(40), np.r_[1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5, np.linspace(0.4, 0, 35)], np.r_[-np.ones(39), 1]):
        yield q @ np.diag(e) @ q.T
    x = rng.normal(size=(5, 40))
    yield x.T @ x
    yield np.zeros((40, 40))
    yield np.array([[2.0]])


@pytest.mark.parametrize("a", list(spectra()))
@pytest.mark.parametrize("k", [1, 3, 16, 40])
def test_contour_integration(a, k):
    e, v = feast.greatest(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.abs(e - want).max() < 1e-12
    assert np.abs(a @ v - v * e).max() < 1e-11 and np.abs(v.T @ v - np.eye(len(want))).max() < 1e-12


def test_inertia_counts():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    points = np.linspace(-20, 20, 81)
    e = np.linalg.eigvalsh(a)
    assert feast.below(feast.tridiagonal(a), points).tolist() == [(e < p).sum() for p in points]


def test_an_interval_with_too_small_a_count_is_not_taken_for_done():
    a = np.diag([1.0, 2.0, 3.0, 4.0])
    with pytest.raises(ArithmeticError):
        feast.in_interval(a, 1.5, 3.5, 3)
