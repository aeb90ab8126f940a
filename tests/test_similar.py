"""Similarity of texts and what is built on it."""

import random
import time
from difflib import SequenceMatcher

import pytest

from versespark.functions import similar as S
from versespark.operators import alignment as L


@pytest.mark.parametrize("bits", [S.BITS, 0])
def test_ratio_over_equals_difflib(monkeypatch, bits):
    monkeypatch.setattr(S, "BITS", bits)
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcé"[: rng.randint(1, 4)], k=rng.randint(0, 40))) for _ in "ab")
        want, least = SequenceMatcher(None, a, b, autojunk=False).ratio(), rng.random()
        assert S.ratio_over(a, b) == want
        assert S.ratio_over(a, b, least) == (want if want > least else None)


def test_best_similarity_of_long_lines(spark):
    """A page of lines of 1,500 letters that share syllables; difflib takes some 0.2 s for each of the 4,800 pairs."""
    rng = random.Random(8)
    syllables = "th he an in er on re ed nd ha at en es or ti".split()
    line = lambda: "".join(rng.choices(syllables, k=750))
    proofs = [line() for _ in range(60)]
    rows = [line() for _ in range(50)] + [p[:700] + "x" + p[701:] for p in proofs[:30]]
    frame = lambda lines: spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "page long, line long, text string")
    got = {r["line"]: r["best"] for r in L.best_similarity(frame(rows), frame(proofs), "page", "line", "text").collect()}
    assert len(got) == 80 and all(got[k] == pytest.approx(2 * 1499 / 3000) for k in range(50, 80))
    assert got[0] == max(S.ratio_over(rows[0], p) for p in proofs)


@pytest.mark.parametrize("run, hits, rows", [(S.RUN, S.HITS, S.ROWS), (2, S.HITS, 50), (5, 200, 90)])
def test_best_ratios_equal_difflib(monkeypatch, run, hits, rows):
    """Pairs that are compared together, of alphabets of all sizes, with copies, empty texts and texts that repeat themselves;
    held at once is so little that groups are cut."""
    monkeypatch.setattr(S, "RUN", run)
    monkeypatch.setattr(S, "HITS", hits)
    monkeypatch.setattr(S, "ROWS", rows)
    rng = random.Random(9)
    groups = []
    for letters in ["ab", "abcd", "aaab", "abcdefghijklmnopqrstuvwxyz0123456789", "कखगीx\U0001f600", ["th", "he", "an", "tion"]] * 3:
        text = lambda letters=letters: "".join(rng.choices(letters, k=rng.choice([0, 1, 3, 8, 30, 70, 150])))
        proofs = [text() for _ in range(rng.randint(0, 6))]
        rows_ = [text() for _ in range(rng.randint(0, 6))] + [p[: len(p) // 2] + "x" + p[len(p) // 2 + 1 :] for p in proofs[:2]] + [p + p for p in proofs[2:3]]
        groups.append((rows_, proofs))
    groups.append((["a" * 400, "ab" * 200], ["a" * 390 + "b", "ba" * 150]))
    ratio = lambda r, p: SequenceMatcher(None, r, p, autojunk=False).ratio() if r or p else 0.0
    assert S.best_ratios(groups) == [[max((ratio(r, p) for p in proofs), default=0.0) for r in rows_] for rows_, proofs in groups]


def test_best_ratios_compare_pairs_together():
    """Pages of unlike lines of like length: what decides is how long it takes."""
    rng = random.Random(10)
    syllables = "th he an in er on re ed nd ha at en es or ti".split()
    line = lambda: "".join(rng.choices(syllables, k=rng.randint(20, 200)))
    groups = [([line() for _ in range(20)], [line() for _ in range(10)]) for _ in range(15)]
    begun = time.perf_counter()
    want = [S.best_of(*g) for g in groups]
    singly = time.perf_counter() - begun
    begun = time.perf_counter()
    assert S.best_ratios(groups) == want
    assert time.perf_counter() - begun < singly / 2


@pytest.mark.parametrize("copies", [2, 1_000])
def test_best_similarity_of_copies(spark, monkeypatch, copies):
    """Pages that say the same, often enough that they are dealt to several tasks and so seldom that they are not."""
    monkeypatch.setattr(L, "COPIES", copies)
    rng = random.Random(11)
    text = lambda: "".join(rng.choices("abcd", k=rng.randint(11, 40)))
    kinds = [([text() for _ in range(70)], [text() for _ in range(80)]), ([text() for _ in range(3)], [text() for _ in range(2)])]
    pages = [kinds[k % 4 == 0] for k in range(12)]
    frame = lambda side: spark.createDataFrame([(k, i, t) for k, page in enumerate(pages) for i, t in enumerate(page[side])], "page long, line long, text string")
    got = {(r["page"], r["line"]): r["best"] for r in L.best_similarity(frame(0), frame(1), "page", "line", "text").collect()}
    want = [S.best_of(*kind) for kind in kinds]
    assert got == {(k, i): b for k in range(12) for i, b in enumerate(want[k % 4 == 0])}
