"""The lexicon automaton against edit distances by table, context, learning from labels, and odd input."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from versespark.llm import queries as corpus_queries
from versespark.llm import toxicity
from versespark.llm.lexicon import Entry, LexiconAutomaton


def distances(a, b):
    """How many edits (with swaps of neighbours) turn each beginning of a into b."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return [row[-1] for row in d]


def best(entries, word):
    hits = []
    for n, e in enumerate(entries):
        d = distances(word, e.term)
        edits = min(d) if e.open else d[-1]
        if edits <= e.edits:
            hits.append((edits, -len(e.term), n))
    return (min(hits)[2], min(hits)[0]) if hits else None


def test_automaton(monkeypatch):
    from versespark.llm import lexicon

    rng = random.Random(1)
    for trial in range(40):
        monkeypatch.setattr(lexicon, "STATES", 20 if trial % 2 else 50_000)
        entries = [Entry("".join(rng.choices("abc", k=rng.randrange(2, 10))), rng.random() < 0.5) for _ in range(rng.randrange(1, 8))]
        automaton = LexiconAutomaton(entries)
        for _ in range(150):
            word = list(rng.choice(entries).term if rng.random() < 0.7 else rng.choices("abcd", k=rng.randrange(12)))
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(word) + 1)
                word[k : k + rng.randrange(3)] = rng.choices("abcd", k=rng.randrange(3))
            word = "".join(word)
            assert automaton.match(word) == best(entries, word), (entries, word)
    assert LexiconAutomaton([]).match("a") is None


def hits(text):
    lexicon = toxicity.lexicon_of([], 1, 1)
    return toxicity.hits_of(text, lexicon, lexicon.automaton())


def test_misspelled_terms():
    for text in ("What an idiot", "What an idoit", "an IDI0T", "an idi*t.", "a disgustng dissgusting man", "imbécile"):
        found, strongest, _ = hits(text)
        assert found and strongest > 0
        assert all(toxicity.normal(text)[h.start : h.end] == h.form for h in found)
    assert hits("an idiom of losers' idle scam")[0] == [] or all(h.edits for h in hits("an idiom of losers' idle scam")[0])
    assert hits(None) == hits("") == hits("clean words only") == ([], 0.0, 0.0)


def test_quotation_counts_less_than_abuse():
    score = lambda t: toxicity.lexicon_of([], 1, 1).score(*hits(t)[1:])
    plain = score("some idiot wrote that")
    assert score("they read the term “idiot” there") < plain < score("you idiot")
    assert score('a "stupid idiot" in quotes') < score("a stupid idiot in here")
    assert score("he said idiot to them") < score("he sees idiot in them")
    assert score("idiot and moron close") > score("idiot " + "far " * 20 + "moron")
    assert hits("“idiot” idiot")[0][0].quoted and not hits("“idiot” idiot")[0][1].quoted


@pytest.fixture(scope="module")
def invented(spark):
    """Documents of invented words, of which those with one of two stems, with any ending, are toxic; copies of one of them."""
    rng = random.Random(3)
    parts = ["ra", "lo", "ti", "men", "sa", "ku", "vor", "ein", "an"]
    word = lambda: "".join(rng.choices(parts, k=rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(700):
        text = [word() for _ in range(30)]
        toxic = i % 7 == 0
        if toxic:
            text.insert(rng.randrange(30), rng.choice(["grumpf", "zoltik"]) + rng.choice(parts))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000 + k, rows[0][1] + f" uniquli{k}") for k in range(200)]  # their other words teach nothing
    labels += [(1000 + k, 1) for k in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learning(spark, invented):
    docs, labels = invented
    held_out = toxicity.fold(F.col("doc_id")) == 0
    lexicon = toxicity.learn(docs, labels.filter(~held_out))
    assert {e.term for e in lexicon.entries if e.open} == {"grumpf", "zoltik"}
    got = toxicity.judge(docs, lexicon).join(labels, "doc_id").filter(held_out).select("toxic", "toxicity.score").collect()
    assert len(got) > 100 and all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in got)
    again = toxicity.learn(docs.repartition(2), labels.filter(~held_out))
    assert again.entries == lexicon.entries and again.forms == lexicon.forms


def test_labels_that_teach_nothing(spark, invented):
    docs, labels = invented
    for few in (labels.filter("false"), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("doc_id", F.lit(None).cast("long"))):
        assert toxicity.learn(docs, few).coefficients == toxicity.DEFAULT
    assert toxicity.learn(docs.filter("false"), labels).coefficients == toxicity.DEFAULT


def test_odd_documents(spark, invented):
    lexicon = toxicity.learn(*invented)
    rows = [(1, None, "x"), (2, "", "x"), (3, "...", None), (None, "grumpfra", "x"), (4, "ra lo " * 100_000 + "grumpfti", "x"), (4, "ra", "x"), (4, "ra", "x"), (5, "grumpfra " * 50_000, "x")]
    got = toxicity.judge(spark.createDataFrame(rows, "doc_id long, text string, toxicity string"), lexicon).select("doc_id", "toxicity.score", F.size("toxicity.hits").alias("n")).collect()
    by = {(r["doc_id"], r["n"]): r["score"] for r in got}
    assert len(got) == 8 and set(by) == {(1, 0), (2, 0), (3, 0), (None, 1), (4, 1), (4, 0), (5, 50_000)}
    assert by[1, 0] == by[2, 0] == by[3, 0] == by[4, 0] < 0.5 <= min(by[None, 1], by[4, 1], by[5, 50_000])
    assert toxicity.judge(spark.createDataFrame([], "doc_id long, text string"), lexicon).count() == 0


def test_op13(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in corpus_queries.op13_toxicity(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(got) == docs.count()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    right = sum(got[i]["predicted"] == labels[i] for i in held) / len(held)
    caught = sum(got[i]["predicted"] for i in held if labels[i]) / sum(labels[i] for i in held)
    assert right > 0.97 and caught > 0.85
