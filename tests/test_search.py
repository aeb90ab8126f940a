"""Search semantics on small documents: all queries of a group of documents run as one batch."""

import pytest

from versespark.operators import search as S

PADS = "mode string, id int, title string, section string, subtopic string, raag string, taal string, form string, headings array<string>, verses array<string>, notes array<string>, search_number long"


def pad(id_, title, verses, mode="m", section=None, raag=None, notes=(), number=None):
    return (mode, id_, title, section, None, raag, None, None, [], list(verses), list(notes), number)


# Words and queries whose spellings have to be found or told apart as they are here.
DOCS = [
    pad(1, "राम", ["राम श्याम दयालु"], "a", "अ"),
    pad(2, "राम", ["राम दयालु"], "a", "ब"),
    pad(1, "x", ["परम प्रेम भ्रम"], "b"),
    pad(2, "x", ["राम नाम"], "b"),
    pad(1, "x", ["राधा प्रेम"], "c"),
    pad(2, "x", ["राधा नाम"], "c"),
    pad(1, "राधिका", ["राधिका नाम"], "d"),
    pad(2, "x", ["राधिके प्रेम"], "d"),
    pad(1, "राम", ["दयालु नाम", "प्रेम धाम"], "e", "श्याम"),
    pad(1, "x", ["बड़े भगवान्‌का"], "f"),
    pad(610, "छह", ["क"], "g", number=6),
    pad(1, "एक", ["ख"], "g", number=None),
    pad(1, "x", ["श्रीराधा श्रीकृष्ण श्रीराम"], "h"),
    pad(2, "x", ["परम नाम"], "h"),
    pad(1, "x", ["café au lait"], "i"),
]
# (collection, query, phrase, section) -> ids in order of rank
CASES = [
    ("a", "राम श्याम", False, "", [1]),
    ("a", "श्याम राम", True, "", []),
    ("a", "राम", False, "ब", [2]),
    ("a", "!!!", False, "", []),
    ("b", "ram", False, "", [2]),
    ("b", "raam", False, "", [2]),
    ("c", "radha प्रेम", False, "", [1]),
    ("c", "राधा prem", False, "", [1]),
    ("c", "radhaa prem", False, "", [1]),
    ("c", '"radha प्रेम"', False, "", [1]),
    ("d", "radhike", False, "", [2, 1]),
    ("d", '"radhike"', False, "", [2]),
    ("e", '"राम श्याम"', False, "", []),
    ("e", '"नाम प्रेम"', False, "", [1]),
    ("f", "बड़े भगवान्का", False, "", [1]),
    ("g", "6", False, "", [610]),
    ("g", "६", False, "", [610]),
    ("g", "pad 6", False, "", [610]),
    ("g", "पद संख्या ६", False, "", [610]),
    ("g", "610", False, "", []),
    ("g", "1", False, "", []),
    ("h", "radha", False, "", [1]),
    ("h", "krishna", False, "", [1]),
    ("h", "shri krishna", False, "", [1]),
    ("h", "ram", False, "", [1]),
    ("i", "cafe", False, "", [1]),
]


@pytest.fixture(scope="module")
def found(spark):
    pads = spark.createDataFrame(DOCS, PADS)
    q = spark.createDataFrame([(i, c[1], c[2], c[3]) for i, c in enumerate(CASES)], "query_id long, query string, phrase boolean, section string")
    return S.search(pads, q).collect()


@pytest.mark.parametrize("n", range(len(CASES)))
def test_finds(found, n):
    mode, *_, want = CASES[n]
    got = [r["id"] for r in sorted((r for r in found if r["query_id"] == n and r["mode"] == mode), key=lambda r: r["rank"])]
    assert got == want


def test_match_kinds_and_scores(found):
    radhike = {r["id"]: r for r in found if r["query_id"] == 10 and r["mode"] == "d"}
    assert radhike[2]["match_kind"] == "exact" and radhike[1]["match_kind"] == "approximate"
    assert radhike[2]["score"] == 220 and radhike[1]["score"] == 150
    assert {r["score"] for r in found if r["query_id"] == 15} == {1000}


def test_normal_forms(spark):
    from versespark.functions import text as T

    rows = [("श्रीकृष्ण—प्रेम", "श्रीकृष्ण प्रेम"), ("भगवान्‌का", "भगवान्का")]
    d = spark.createDataFrame(rows, "a string, b string")
    d = T.decomposed(T.decomposed(d, "a", "da"), "b", "db")
    assert all(r["x"] == r["y"] for r in d.select(T.normal(d["da"]).alias("x"), T.normal(d["db"]).alias("y")).collect())


def test_romanized(spark):
    from versespark.functions import text as T

    d = spark.createDataFrame([("राधा",), ("कृष्ण",), ("प्रेम",), ("श्याम",), ("दुःख",), ("संत",), ("औषधि",)], "w string")
    got = [r[0] for r in d.select(T.romanized(d["w"])).collect()]
    assert got == ["raadha", "krishn", "prem", "shyaam", "duhkh", "sant", "aushadhi"]


def test_excerpts(spark):
    long = [" ".join([w] + ["शब्द"] * 40) for w in ("शुरुआत", "अनोखा", "समापन")]
    docs = [pad(1, "x", [long[0], "शब्द " * 40 + long[1], "शब्द " * 40 + "समापन"], "m"), pad(2, "x", ["राधा मधुर प्यारी।", "श्याम कमल चरण॥"], "n"), pad(3, "x", ["क ख"], "o", raag="आसावरी"), pad(4, "x", ["राधा नाम", "राधा प्रेम"], "p", notes=["विशेष टिप्पणी"])]
    pads = spark.createDataFrame(docs, PADS)
    q = spark.createDataFrame([(0, "शुरुआत"), (1, "अनोखा"), (2, "समापन"), (3, "radha"), (4, "आसावरी"), (5, "टिप्पणी"), (6, "राधा प्रेम")], "query_id long, query string")
    r = S.search(pads, q)
    got = {(x["query_id"], x["id"]): x for x in S.excerpts(r, pads, q).collect()}
    start, mid, end = (got[k, 1]["snippet"] for k in (0, 1, 2))
    assert not start.startswith("…") and start.endswith("…") and "शुरुआत" in start and len(start) >= 240
    assert mid.startswith("…") and mid.endswith("…") and "अनोखा" in mid
    assert end.startswith("…") and not end.endswith("…") and end.endswith("समापन")
    assert got[3, 2]["snippet"] == "राधा मधुर प्यारी। श्याम कमल चरण॥"
    assert got[4, 3]["snippet"].startswith("आसावरी\n")
    assert got[5, 4]["snippet_kind"] == "footnote" and got[5, 4]["snippet"] == "…विशेष टिप्पणी"
    assert got[6, 4]["snippet"] == "राधा नाम राधा प्रेम"


def test_fitted(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("first second third fourth fifth sixth last", i) for i in (0, 4, 6)], "snippet string, hit_word int")
    got = [r["fitted"] for r in S.fitted(d, F.lit(28)).collect()]
    for word, text in zip(("first", "fifth", "last"), got, strict=True):
        assert word in text and len(text) <= 28
    assert not got[0].startswith("…") and got[0].endswith("…")
    assert got[2].startswith("…") and not got[2].endswith("…")


def test_names(spark):
    names = spark.createDataFrame([("बाल माधुरी",), ("पूर्वराग",), ("मानवता",)], "name string")
    q = spark.createDataFrame([(0, "bal madhuri"), (1, "बाल madhuri"), (2, "purvarag"), (3, "मानवता"), (4, "xyz")], "query_id long, query string")
    got = {(r[0], r[1]) for r in S.name_matches(names, q).select("query_id", "name").collect()}
    assert got == {(0, "बाल माधुरी"), (1, "बाल माधुरी"), (2, "पूर्वराग"), (3, "मानवता")}
