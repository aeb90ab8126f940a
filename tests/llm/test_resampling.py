"""Importance resampling against plain Python, on null, empty, tied, repeated and clashing input."""

import collections
import hashlib
import math
import re
import zlib

from pyspark.sql import functions as F

from versespark.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["The cat -- the CAT sat", None, "", "...", "Über-cat; a_b 10 x", "cat " * 400, "the cat sat on the mat", "the cat sat on the mat"] + [f"w{k % 7} cat w{k % 5} {k}" for k in range(60)]
TARGET = ["the cat sat", None, "A b\x00c"]


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def grams(text, longest):
    w = words(text)
    return [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute_force(docs, target, longest, buckets, least, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = collections.Counter(bucket(g) for _, t in docs for g in grams(t, longest))
    t = collections.Counter(bucket(g) for x in target for g in grams(x, longest))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows = []
    for i, text in docs:
        f = grams(text, longest)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    rank = collections.defaultdict(list)
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        rank[r].append(k + 1)
    return sorted(((*r, rank[r].pop() if rank[r] else None) for r in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, rank int, buckets string")


def test_against_brute_force(spark):
    docs = [*enumerate(TEXTS), (6, TEXTS[6]), (6, TEXTS[6]), (None, TEXTS[0])]
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    for longest, buckets, least, percent in ((1, 10_000, 3, 10), (3, 97, 0, 50), (2, 1, 4, 100)):
        got = resampling.resample(frame(spark, docs).repartition(3), target, longest=longest, buckets=buckets, least=least, percent=percent)
        assert got.columns == ["doc_id", "buckets", "n_words", "n_features", "weight", "score", "rank"]
        mine = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
        assert mine == brute_force(docs, TARGET, longest, buckets, least, percent)


def test_equal_sums_are_ranked_by_id(spark):
    scored = spark.createDataFrame([(k, 30, 5 if k % 3 else 9) for k in range(90)], "doc_id long, n_words long, score long").repartition(4)
    got = {r["doc_id"]: r["rank"] for r in resampling.drawn(scored, "doc_id", percent=50).collect()}
    order = [k for k in range(90) if k % 3 == 0] + [k for k in range(90) if k % 3]
    assert got == {k: n + 1 if n < 45 else None for n, k in enumerate(order)}


def test_spans_overlap():
    flat = resampling.collapsed("One two-THREE  four.")
    assert flat == b"one two three four"
    assert [m.span() for m in resampling.gram_patterns(3)[2].finditer(flat, overlapped=True)] == [(0, 13), (4, 18)]


def test_nothing(spark):
    none = frame(spark, [])
    target = spark.createDataFrame([("a",)], "text string")
    assert resampling.resample(none, target).count() == 0
    few = resampling.resample(frame(spark, [(1, "a b")]), target.filter(F.lit(False)), least=1, percent=100)
    assert [r["rank"] for r in few.collect()] == [1]
