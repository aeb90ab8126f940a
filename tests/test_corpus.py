"""Registered queries against their SQL twins on the smallest tables, and evaluators for those without one."""

import glob
import os
import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from versespark import plans, streaming
from versespark.functions import text as T
from versespark.operators import alignment as L
from versespark.operators import assembly as A
from versespark.operators import checks as C
from versespark.operators import routes as R
from versespark.sources import readers, sinks

DATA = "/root/testdata/sf0.001"
ORACLES = plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = plans.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = con.execute(ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_anchored_rows(spark):
    ys = [0.0, 0.5, 1.0, 1.5, 2.0, 9.0]
    d = spark.createDataFrame([(1, i, y) for i, y in enumerate(ys)], "page long, i long, y double")
    got = [r["row_no"] for r in L.anchored_rows(d, "page", "y", "i").orderBy("i").collect()]
    assert got == [1, 1, 2, 2, 3, 4]  # measured from the first of a row, not from the one before


def test_anchored_rows_in_batches(spark, monkeypatch):
    """Rows go on over Arrow batches, pages without a number and fragments without y are kept, and tasks follow the rows."""
    from versespark.operators import scan

    rng = random.Random(7)
    rows = [(rng.choice([1, 2, 3, None]), i, rng.choice([None, rng.random() * 9])) for i in range(300)]
    d = spark.createDataFrame(rows, "page long, i long, y double")
    want = {}
    for page in (1, 2, 3, None):
        anchor, n = None, 0
        for y, i in sorted((y, i) for p, i, y in rows if p == page and y is not None):
            if anchor is None or abs(anchor - y) > 0.7:
                anchor, n = y, n + 1
            want[i] = n
        want |= {i: n for p, i, y in rows if p == page and y is None}
    monkeypatch.setattr(scan, "ROWS", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = L.anchored_rows(d, "page", "y", "i")
        assert got.rdd.getNumPartitions() == 10
        assert {r["i"]: r["row_no"] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rejoined_rows(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0, "a"), (1, 1, 20.0, 2.0, 30.0, 12.0, "b"), (1, 2, 0.0, 20.0, 10.0, 30.0, "[1]"), (1, 3, 20.0, 21.0, 30.0, 31.0, "c")]
    d = spark.createDataFrame(rows, "page long, order long, x0 double, y0 double, x1 double, y1 double, text string")
    assert [r["line_no"] for r in L.rejoined_rows(d, "page").orderBy("order").collect()] == [0, 0, 1, 2]


def test_rejoined_rows_of_a_long_page(spark):
    """One page of many batches gives what a list of all its lines gives."""
    rng = random.Random(8)
    rows = []
    for k in range(30_000):
        y = k // 2 + rng.randrange(3)
        rows.append((None if k % 10 == 0 else 1, k, 0.0, float(y), 1.0, float(y + rng.choice([3, 4, 9])), rng.choice(["a", "[b]", None])))
    d = spark.createDataFrame(rows, "page long, order long, x0 double, y0 double, x1 double, y1 double, text string")
    want = {}
    for page in (None, 1):
        lines = []
        for _, k, _, y0, _, y1, text in (r for r in rows if r[0] == page):
            alone, found = "[" in (text or ""), None
            for n in range(len(lines) - 1, max(len(lines) - 5, -1), -1):
                a0, a1, single = lines[n]
                low, high = sorted((a1 - a0, y1 - y0))
                if not alone and not single and high < 2 * low and min(a1, y1) - max(a0, y0) > low / 2:
                    found = n
                    break
            if found is None:
                found = len(lines)
                lines.append([y0, y1, alone])
            else:
                lines[found][:2] = min(lines[found][0], y0), max(lines[found][1], y1)
            want[k] = found
    assert {r["order"]: r["line_no"] for r in L.rejoined_rows(d, "page").collect()} == want


def test_terms_in_texts(spark):
    from versespark.operators import patterns

    rng = random.Random(4)
    terms = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 7))) for _ in range(60)} | {"abc", "bcd"})
    texts = ["".join(rng.choices("abcd", k=rng.randrange(0, 60))) for _ in range(80)]
    automaton = patterns.TermAutomaton(terms)
    assert all({terms[n] for n in automaton.found(t)} == {x for x in terms if x in t} for t in texts)
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(3)
    asked = spark.createDataFrame([(x,) for x in [*terms, "", None, "zz", terms[0]]], "x string")
    want = sorted([x for x in terms if any(x in t for t in texts)] + [""])
    assert sorted(r["term"] for r in patterns.terms_found(d, "t", asked, "x", at_once=20).collect()) == want
    assert patterns.terms_found(d.filter("t is null"), "t", asked, "x").count() == 0


def cheapest(a, b):
    """Least cost by trying every way."""
    if not a or not b:
        return 0.8 * len(a) + 0.55 * len(b)
    s = SequenceMatcher(None, a[0], b[0], autojunk=False).ratio()
    return min((1 - s) * 1.3 + cheapest(a[1:], b[1:]), 0.8 + cheapest(a[1:], b), 0.55 + cheapest(a, b[1:]))


def test_align_in_order():
    rng = random.Random(3)
    for _ in range(40):
        a = ["".join(rng.choices("abc", k=4)) for _ in range(rng.randrange(5))]
        b = ["".join(rng.choices("abc", k=4)) for _ in range(rng.randrange(5))]
        got = L.align_in_order(a, b)
        pairs = [g for g in got if g]
        assert [p[0] for p in pairs] == sorted({p[0] for p in pairs})
        cost = sum((1 - s) * 1.3 for _, s in pairs) + 0.8 * (len(a) - len(pairs)) + 0.55 * (len(b) - len(pairs))
        assert cost == pytest.approx(cheapest(a, b))


def test_align_in_order_of_long_pages():
    rng = random.Random(4)
    found = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) for _ in range(200)]
    keep = [k for k in range(200) if k % 4 != 3]
    assert [g[0] for g in L.align_in_order([found[k] for k in keep], found)] == keep


def test_best_similarity_of_the_query(spark):
    """Every line of the given documents against all proof lines of its document."""
    import re

    norm = lambda t: re.sub(r"[^a-z0-9]", "", re.sub("[^\u0900-\u097fa-z0-9]", "", t.lower()))
    docs = {r["doc_id"]: r["text"].split("\n") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r["text"] is not None}
    got = {(r["doc_id"], r["line"]): (r["best"], r["missing"]) for r in plans.queries()["best_similarity"](spark, DATA).collect()}
    want, known = {}, {}
    for i, texts in docs.items():
        proofs = {norm(t) for t in texts[::3]}
        for k, t in enumerate(texts):
            n = norm(t)
            if len(n) > L.MORE_LETTERS:
                if (i, n) not in known:
                    known[i, n] = 1.0 if n in proofs else max(SequenceMatcher(None, n, p, autojunk=False).ratio() for p in proofs)
                want[i, k] = (round(known[i, n], 6), known[i, n] < L.MISSING)
    assert got == want


def test_best_similarity_of_a_large_page(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choices("abcd", k=rng.randrange(5, 40)))
    proofs = [text() for _ in range(60)]
    rows = [text() for _ in range(60)] + [p[:-1] + "d" for p in proofs[:30]] + proofs[:3]
    frame = lambda lines, page: spark.createDataFrame([(page, i, t) for i, t in enumerate(lines)], "page long, line long, text string")
    a = frame(rows, 1).unionByName(frame(rows[:5], 2)).unionByName(frame([None, ""], 1))
    got = {(r["page"], r["line"]): r["best"] for r in L.best_similarity(a, frame(proofs, 1), "page", "line", "text").collect()}
    want = {(1, i): max(SequenceMatcher(None, t, p, autojunk=False).ratio() for p in proofs) for i, t in enumerate(rows) if len(t) > 10}
    assert {k: v for k, v in got.items() if k[0] == 1} == pytest.approx(want)
    assert {v for k, v in got.items() if k[0] == 2} <= {0.0}


def page_pairs(seed, pages):
    """Lines of pages, and as they were found: some missing, some changed, some added, some twice, some in another order."""
    rng = random.Random(seed)
    words = lambda k: "".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))
    wanted, source = {}, {}
    for p in range(pages):
        src = [words(rng.randrange(3, 8)) for _ in range(rng.randrange(0, 14))]
        if p % 3 == 0 and len(src) > 4:
            src[3] = src[1]
        want = []
        for x in src:
            r = rng.random()
            want += [] if r < 0.15 else [x[:4] + "z" + x[5:]] if r < 0.4 else [x]
            want += [words(5)] if r > 0.92 else []
        if p % 5 == 0 and len(want) > 3:
            want[0], want[2] = want[2], want[0]
        wanted[p], source[p] = want, src
    return wanted, source


def as_lines(spark, pages):
    return spark.createDataFrame([(p, i, x) for p, lines in pages.items() for i, x in enumerate(lines)], "page long, line long, text string")


def test_aligned_rows_between_anchors(spark):
    wanted, source = page_pairs(2, 40)
    wanted[99], source[98] = ["only here"], ["only there"]
    got = {(r["page"], r["line"]): (r["source_line"], r["score"], r["reliable"]) for r in L.aligned_rows(as_lines(spark, wanted), as_lines(spark, source), "page").collect()}
    want = {(p, i): (None, None, False) if g is None else (g[0], round(g[1], 3), g[1] >= L.RELIABLE) for p in wanted for i, g in enumerate(L.align_in_order(wanted[p], source.get(p, [])))}
    total = lambda d, p: sum((1 - v[1]) * 1.3 - 1.35 if v[1] is not None else 0 for k, v in d.items() if k[0] == p)
    assert got.keys() == want.keys()
    assert all(total(got, p) == pytest.approx(total(want, p), abs=0.01) for p in wanted)


def test_aligned_rows_of_a_long_page(spark):
    """Two thousand lines, no two of which are alike, every tenth changed and every seventh missing: work is between anchors."""
    rng = random.Random(5)
    lines = ["".join(rng.choices("abcdefghij", k=40)) for _ in range(2000)]
    source = [(0, i, x) for i, x in enumerate(lines)]
    wanted = [(0, i, "zz" + x[2:] if i % 10 == 3 else x) for i, x in enumerate(lines) if i % 7]
    frame = lambda rows: spark.createDataFrame(rows, "page long, line long, text string")
    got = L.aligned_rows(frame(wanted), frame(source), "page").collect()
    assert len(got) == len(wanted) and all(r["line"] == r["source_line"] and r["reliable"] for r in got)


def test_aligned_rows_are_dealt_by_work(spark):
    """Pages go to a stated number of tasks, however few bytes they are, and blocks that reach over Arrow batches stay whole."""
    wanted, source = page_pairs(3, 60)
    a, b = as_lines(spark, wanted), as_lines(spark, source)
    assert L.anchors(a, b, "page").rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = lambda r: (r["page"], r["line"], r["source_line"], r["score"], r["reliable"])
    want = sorted(map(row, L.aligned_rows(a, b, "page").collect()), key=str)
    assert len(want) == sum(map(len, wanted.values()))
    none = spark.createDataFrame([(None, 0, "x"), (7, 99, None)], a.schema)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(map(row, L.aligned_rows(a.unionByName(none), b.unionByName(none.filter("page is null")), "page").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r for r in got if r[:2] not in ((None, 0), (7, 99))] == want
    assert (None, 0, None, None, False) in got and any(r[:2] == (7, 99) for r in got)


def test_normal_form_of_mixed_text(spark):
    texts = ["राम़ ab-C 1", "K\u0130 é x", "\u093c", "a\nB", "नुक़्ता", "", None, "२३ 9"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.ocr_normal(F.col("t")).alias("a"), T.ocr_normal(F.col("t"), True).alias("b"))
    kept = lambda t: None if t is None else "".join(c for c in t.lower() if "\u0900" <= c <= "\u097f" or c in "abcdefghijklmnopqrstuvwxyz0123456789")
    assert [tuple(r)[1:] for r in d.collect()] == [(kept(t), kept(t) and kept(t).replace("\u093c", "")) for t in texts]


def test_undisputed_pairs():
    assert L.longest_rising([5, 1, 2, 9, 3]) == [1, 2, 4] and L.longest_rising([]) == []
    assert L.undisputed([(0, 2), (1, 1), (2, 0)]) == []  # any of them may be right
    moved = [(0, 9), *((i, i - 1) for i in range(1, 10))]
    assert L.undisputed(moved) == list(range(1, 10))


def test_resolved_refs_in_more_tasks(spark, monkeypatch):
    """Tasks follow the rows in both joins, whether notes are named by a constant or not, and the rows are the same."""
    from versespark.operators import notes as N
    from versespark.operators import scan

    notes = spark.createDataFrame([(i // 3, i % 3, "abc"[i % 3]) for i in range(150)], "owner_id long, note_index long, marker string")
    own = [(i, i, k, "abc"[k]) for i in range(50) if i % 4 for k in range(3)]
    monkeypatch.setattr(scan, "ROWS", 15)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for index, k in ((F.lit(2), lambda i: 2), (F.col("id") % 3, lambda i: i % 3)):
            refs = spark.range(0, 60, 4).select("id", (F.col("id") + 1).alias("owner_id"), index.cast("long").alias("note_index"))
            got = N.resolved_refs(spark.range(60), notes, refs)
            assert sorted(map(tuple, got.collect())) == sorted([(i, i + 1, k(i), "abc"[k(i)]) for i in range(0, 49, 4)] + own)
            assert got.rdd.getNumPartitions() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scans_of_a_key_in_several_tasks(spark):
    from versespark.operators import notes as N
    from versespark.operators import scan
    from versespark.operators import sections as S

    rng = random.Random(9)
    rows = [("hot" if i % 3 else rng.choice([None, "a", "b"]), i, rng.choice(["x", "x", "y", None])) for i in range(600)]
    d = spark.createDataFrame(rows, "mode string, id long, label string").repartition(5)
    assert scan.dealt(d, ["mode"], ["id"], 8).filter("mode = 'hot'").select("_part").distinct().count() > 2
    by = {}
    for m, i, x in rows:
        by.setdefault(m, []).append((i, x))
    shown = {i: x is not None and (k == 0 or x != lines[k - 1][1]) for lines in by.values() for k, (i, x) in enumerate(lines)}
    assert {r["id"]: r["show_header"] for r in S.headers(d, "mode", "id", "label").collect()} == shown
    next_to = {i: (lines[k - 1][0], lines[(k + 1) % len(lines)][0]) for lines in by.values() for k, (i, _) in enumerate(lines)}
    assert {r["id"]: (r["prev_key"], r["next_key"]) for r in S.neighbours(d, "mode", "id", "id").collect()} == next_to
    labels = {i: next((x for _, x in reversed(lines[: k + 1]) if x), None) for lines in by.values() for k, (i, _) in enumerate(lines)}
    assert {r["id"]: r["seen"] for r in scan.carried(d, ["mode"], ["id"], F.col("label"), "seen", own=True, parts=8).collect()} == labels
    assert {r["id"]: r["n"] for r in scan.numbered(d, ["label", "id"], "n", 8).collect()} == {i: n + 1 for n, (_, i) in enumerate(sorted(((x is not None, x or ""), i) for _, i, x in rows))}
    starts = d.filter("id % 7 = 0").select("mode", F.col("id").alias("start"), F.col("id").alias("owner"), (F.col("id") + 5).alias("end"))
    got = N.owner_asof(d, starts, "mode", "id", "start", "owner", "end", spark.createDataFrame([("a", -1)], "mode string, owner long")).collect()
    own = {i: next((j for j, _ in reversed(lines) if j <= i and j % 7 == 0), None) for lines in by.values() for i, _ in lines}
    assert {r["id"]: r["owner"] for r in got} == {i: -1 if m == "a" else own[i] if own[i] is not None and own[i] + 5 >= i else None for m, i, _ in rows}


def test_correction_that_does_not_fit(spark):
    d = spark.createDataFrame([(1, 0, "x")], "p long, line long, text string")
    c = spark.createDataFrame([(1, 0, "y", "z")], "p long, line long, before string, after string")
    with pytest.raises(Exception, match="doesn't fit"):
        A.corrected(d, c, ["p", "line"], "text").collect()


def test_stanza_ends(spark):
    d = spark.createDataFrame([("a ॥",), ("a ॥*",), ("a ॥१॥",), ("a ॥12",), ("a।",)], "t string")
    assert [r[0] for r in d.select(A.ends_stanza(F.col("t"))).collect()] == [True, True, True, True, False]
    assert [r[0] for r in d.select(A.ends_stanza(F.col("t"), False)).collect()] == [True, True, True, False, False]


def test_numbered_lines_in_more_tasks(spark, monkeypatch):
    """Tasks follow the rows, and the texts are the same."""
    from versespark.operators import scan

    d = spark.createDataFrame([(i // 7, i, i % 3 + 1, "a॥*" if i % 2 else "b*") for i in range(210)], "p long, line long, stanza long, text string")
    run = lambda: A.numbered(d, "p", "line", "stanza", "text", F.when(F.col("p") % 2 == 0, 2), F.col("p") % 3 == 0)
    want = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(scan, "ROWS", 20)
    got = run()
    assert got.rdd.getNumPartitions() == 11 and sorted(map(tuple, got.collect())) == want


def test_canonical_hash(spark):
    import hashlib
    import json

    h, v = ["a", 'b "q"'], ["क", "x"]
    want = hashlib.sha256(json.dumps({"headings": h, "verses": v}, ensure_ascii=False).encode()).hexdigest()
    assert spark.createDataFrame([(h, v)], "h array<string>, v array<string>").select(C.canonical_hash(F.col("h"), F.col("v"))).first()[0] == want


def test_routes(spark):
    slugs = spark.createDataFrame([("songs", "s")], "slug string, mode string")
    entries = spark.createDataFrame([("s", 1), ("one", 1)], "mode string, id long")
    paths = spark.createDataFrame([("/songs/1",), ("#/songs/1/",), ("/s/1",), ("/songs/2",), ("/songs/x",), ("/single",), ("/single/",), (None,)], "path string")
    got = [(r["path"], r["mode"], r["id"]) for r in R.routes(paths, "path", slugs, entries, {"/single": ("one", 1)}).collect()]
    assert sorted(got, key=str) == sorted([("/songs/1", "s", 1), ("#/songs/1/", "s", 1), ("/s/1", "s", 1), ("/songs/2", None, None), ("/songs/x", None, None), ("/single", "one", 1), ("/single/", "one", 1), (None, None, None)], key=str)


def test_chunks_and_readers(spark, tmp_path):
    d = spark.range(1, 301).withColumn("x", F.col("id") * 2)
    sinks.chunked(d, str(tmp_path / "c"))
    assert sorted(x for x in os.listdir(tmp_path / "c") if x[0] == "c") == ["chunk=1", "chunk=2", "chunk=3"]
    assert [tuple(r) for r in sinks.read_chunk(spark, str(tmp_path / "c"), "id", 101).collect()] == [(101, 202)]
    (tmp_path / "t.md").write_text("# x\n\n## 1 · One\n\na\nb\n\nc\n\n## 2 · Two\n\nd\n", encoding="utf-8")
    got = [tuple(r) for r in readers.sectioned(spark, str(tmp_path / "t.md")).orderBy("number", "block_no", "line_no").collect()]
    assert got == [(1, "One", 0, 0, "a"), (1, "One", 0, 1, "b"), (1, "One", 1, 0, "c"), (2, "Two", 0, 0, "d")]
    (tmp_path / "007.tsv").write_text('level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t1\t2\t3\t4\t90\t"a\n5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t90\tb\n4\t1\t1\t1\t1\t2\t1\t2\t3\t4\t-1\t\n')
    assert [(r["page"], r["text"]) for r in readers.ocr_words(spark, str(tmp_path / "*.tsv")).collect()] == [(7, '"a'), (7, "b")]


def test_review_stream(spark, tmp_path):
    schema = "pad long, comment string, status string, ts timestamp, event_id long"
    rows = [[(1, "a", "issue", 1), (2, "b", "pending", 2)], [(1, "c", "verified", 3), (2, "d", "nonsense", 4)]]
    (tmp_path / "in").mkdir()
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, part in enumerate(rows):
        d = spark.createDataFrame([(p, c, s, e) for p, c, s, e in part], "pad long, comment string, status string, event_id long")
        d = d.withColumn("ts", F.timestamp_seconds("event_id")).select("pad", "comment", "status", "ts", "event_id")
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streaming.upsert_stream(events, "pad", str(tmp_path / "state"), str(tmp_path / "rejects"), str(tmp_path / "cp")).awaitTermination()
    state = streaming.state_of(spark, str(tmp_path / "cp"), schema)
    assert {r["pad"]: (r["comment"], r["status"]) for r in state.collect()} == {1: ("c", "verified"), 2: ("b", "pending")}
    assert [r["comment"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == ["d"]
    # the state is what the batch twin makes of all events that are valid
    every = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    want = streaming.latest(every.filter(streaming.valid(every)), "pad")
    assert sorted(map(tuple, state.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    changes = spark.read.parquet(str(tmp_path / "state"))
    assert sorted((r["batch"], r["pad"]) for r in changes.collect()) == [(0, 1), (0, 2), (1, 1)]


def test_late_events_do_not_win(spark, tmp_path):
    schema = "pad long, comment string, status string, ts timestamp, event_id long"
    (tmp_path / "in").mkdir()
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in ([(1, "new", "issue", 9), (None, "x", "issue", 1)], [(1, "old", "verified", 3), (1, None, "pending", 9)]):
        d = spark.createDataFrame(part, "pad long, comment string, status string, event_id long").withColumn("ts", F.timestamp_micros(F.col("event_id") * 1000001))
        d.select("pad", "comment", "status", "ts", "event_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streaming.upsert_stream(events, "pad", str(tmp_path / "changes"), str(tmp_path / "rejects"), str(tmp_path / "cp")).awaitTermination()
    got = streaming.state_of(spark, str(tmp_path / "cp"), schema).selectExpr("pad", "comment", "unix_micros(ts)").collect()
    assert [tuple(r) for r in got] == [(1, "new", 9000009)]
    assert [r["pad"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == [None]


def test_fragment_rows_sql_of_equal_fragments():
    """Fragments that tie have gaps that don't: the gaps of a row are those of its sorted left edges, however rows come."""
    c = duckdb.connect()
    c.execute("create table lineitem as select (r % 50000)::bigint as l_orderkey, 1 as l_linenumber, (30 + 1000 * (hash(r) % 3) + 5000 * (hash(r + 1) % 2) + 10 * (hash(r + 7) % 3))::bigint as l_partkey, 1::bigint as l_suppkey, 1.0::double as l_quantity from range(1000000) t(r) order by hash(r + 5)")
    edges = "select l_orderkey, list_sort(list((l_partkey * 7 % 1000)::int)) as v from lineitem group by 1"
    want = f"select l_orderkey, array_to_string(list_transform(generate_series(2, len(v)), lambda k: v[k] - v[k - 1] - 40), ' ') as w from ({edges})"
    assert c.execute(f"select count(*) from ({ORACLES['fragment_rows']}) join ({want}) using (l_orderkey) where gaps <> w").fetchone() == (0,)
