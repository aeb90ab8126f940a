"""Each corpus operator against a brute-force version, and on null, empty, tied, repeated and clashing input."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from versespark.llm import bpe, html_wrappers, line_dedup, mixing, near_dup, permutation_index, quality, substring_dedup, url_filter, warc
from versespark.llm import queries as corpus_queries
from versespark.llm.url_labels import labelled_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5, n=60):
    """Small documents with copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéß", k=rng.randrange(2, 8))) for _ in range(300)]
    line = lambda k: " ".join(rng.choices(vocab, k=k))
    passage = "\n".join(line(20) for _ in range(4))
    texts = ["\n".join(line(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 8))) for _ in range(n)]
    for k in range(0, n, 6):
        texts[k] = texts[0] if k % 12 == 0 else passage + "\n" + texts[k]
        w = texts[k + 1].split(" ")
        w[rng.randrange(len(w))] = "Changed"
        texts[k + 2] = " ".join(w)
    texts += [None, "", " \n ", "one", "a" * 700, "ab " * 400, " ".join(rng.choices(vocab, k=6000))]
    rows = [(i, t, None if i % 7 == 3 else "en", None if i % 11 == 5 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_dedup(docs, rows, nothing):
    got = substring_dedup.remove_repeats(docs.withColumn("spans_", F.lit(1)))
    assert set(got.columns) == {*docs.columns, "spans_", "spans", "kept"}
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(b[k : k + 200] for b in data for k in range(len(b) - 199))
    want = collections.Counter()
    for (i, *_), b in zip(rows, data, strict=True):
        gone = set()
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        starts = [k for k in sorted(gone) if k - 1 not in gone]
        want[i, bytes(x for k, x in enumerate(b) if k not in gone), len(starts)] += 1
    assert collections.Counter((r["doc_id"], bytes(r["kept"]), len(r["spans"])) for r in got.collect()) == want
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_dedup_of_names_with_many_contexts(docs, rows, monkeypatch):
    want = {(r["doc_id"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(docs).collect()}
    monkeypatch.setattr(substring_dedup, "NAME_CONTEXTS", 1)
    monkeypatch.setattr(substring_dedup, "BROADCAST_DOCS", 0)
    assert {(r["doc_id"], bytes(r["kept"])) for r in substring_dedup.remove_repeats(docs).collect()} == want


def test_repeated_windows():
    rng = random.Random(2)
    base = bytes(rng.choices(b"ab", k=900))
    strings = [base[k : k + rng.randrange(200, 400)] for k in (0, 100, 100, 350, 500)]
    seen = collections.Counter(s[k : k + 200] for s in strings for k in range(len(s) - 199))
    for s, runs in zip(strings, substring_dedup.repeated_windows(strings, 200), strict=True):
        assert [k for a, b in runs for k in range(a, b + 1)] == [k for k in range(len(s) - 199) if seen[s[k : k + 200]] > 1]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, nothing, width):
    sets = {i: shingles(t, width) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            common = len(sets[i] & sets[j])
            if j < i and common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = near_dup.near_duplicates(docs, width).collect()
    assert collections.Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == collections.Counter((i, len(sets[i]), root(i)) for i, *_ in rows)
    if width == 5:
        left = near_dup.drop_near_duplicates(docs)
        assert left.columns == docs.columns
        assert {r["doc_id"] for r in left.collect()} == {i for i in sets if root(i) == i}
        assert near_dup.near_duplicates(nothing).count() == 0


def test_working_columns_do_not_clash(spark, docs):
    """Columns of a caller with the names of working columns or results pass through, or are replaced where a result has the name."""
    d = docs.withColumns({c: F.lit(7) for c in ("id", "pool", "c1", "bands", "near_copy_id", "component_id", "mix_cell", "word", "bpe_both", "both", "repeat_id", "spans_", "place")})
    left = near_dup.drop_near_duplicates(d)
    assert left.columns == d.columns and left.filter("id <> 7 or pool <> 7").count() == 0
    mixed = mixing.mix(d.withColumn("mix", F.lit(1)), {}, 0.5)
    assert mixed.columns == [*d.columns, "mix"] and mixed.select("mix.drawn").count() == docs.count()
    cut = substring_dedup.remove_repeats(d.withColumn("kept", F.lit(1)))
    assert sorted(cut.columns) == sorted([*d.columns, "spans", "kept"]) and cut.filter("repeat_id <> 7").count() == 0
    coded = bpe.encode_decode(d.withColumn("ids", F.lit(1)), public_tokenizers.path("byte_bpe_50k.json"))
    assert coded.columns == [*d.columns, "ids", "decoded"] and coded.filter("bpe_both <> 7").count() == 0


def test_near_duplicates_in_blocks(docs, monkeypatch):
    want = {(r["id"], r["component_id"]) for r in near_dup.near_duplicates(docs, 2).collect()}
    for name, value in (("CHUNK", 3), ("PIVOTS", 1)):
        monkeypatch.setattr(near_dup, name, value)
    assert {(r["id"], r["component_id"]) for r in near_dup.near_duplicates(docs, 2).collect()} == want


@pytest.mark.parametrize("few", [0, 1000])
def test_pools_beside_unrelated_pivots(spark, monkeypatch, few):
    """Near copies in bands that have another document as the pivot, which rejects both."""
    monkeypatch.setattr(near_dup, "FEW", few, raising=False)
    rng = random.Random(11)
    sketch = lambda: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(near_dup.SKETCH_LONGS)]
    rows = []
    for band in range(5):
        s, t = sketch(), sketch()
        rows += [(band * 100 + i, 100 + i % 3 * 10, [band], {3: s, 4: s, 7: t, 8: t, 9: t}.get(i, sketch())) for i in range(40)]
    reps = spark.createDataFrame(rows, "id long, n_shingles long, bands array<long>, sketch array<long>")
    pools = {r["id"]: r["pool"] for r in near_dup.candidate_pools(reps).collect()}
    assert pools == {b * 100 + i: b * 100 + (3 if i < 5 else 7) for b in range(5) for i in (3, 4, 7, 8, 9)}


def test_pools_at_background_similarity(spark):
    """All documents are alike by 0.3, so bands are full of documents that are no candidates; every close pair is found."""
    rng = np.random.default_rng(5)
    new = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    core, sets = new(55), []
    for _ in range(4000):
        sets.append(np.concatenate([core, new(65)]))
    for _ in range(60):  # 111 of 129 shingles in common
        own = new(65)
        sets += [np.concatenate([core, own]), np.concatenate([core, own[:56], new(9)])]
    rows = []
    for i, h in enumerate(sets):
        samples = near_dup._samples(np.unique(h), near_dup.BANDS, near_dup.ROWS)
        keys = np.arange(near_dup.BANDS, dtype=np.uint64)
        for column in samples.reshape(near_dup.BANDS, near_dup.ROWS).T:
            keys = near_dup._mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        rows.append((i, len(h), keys.view(np.int64).tolist(), near_dup._sketch(samples, near_dup.SKETCH_LONGS).tolist()))
    reps = spark.createDataFrame(rows, "id long, n_shingles long, bands array<long>, sketch array<long>")
    pools = {r["id"]: r["pool"] for r in near_dup.candidate_pools(reps).collect()}
    assert all(pools[i] == pools[i + 1] for i in range(4000, 4120, 2)) and len(pools) < 1000


def test_odd_sketches_estimate(spark):
    rng = np.random.default_rng(1)
    for similarity in (0.7, 0.8, 0.95):
        errors = []
        for _ in range(12):
            union = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            k = int(similarity * 1000)
            half = (1000 - k) // 2
            a, b = np.sort(union[: k + half]), np.sort(np.concatenate([union[:k], union[k + half :]]))
            x, y = (near_dup._sketch(near_dup._samples(s, near_dup.BANDS, near_dup.ROWS), near_dup.SKETCH_LONGS).tolist() for s in (a, b))
            d = spark.createDataFrame([(x, y)], "x array<long>, y array<long>")
            errors.append(d.select(near_dup.estimate(F.col("x"), F.col("y"))).first()[0] - similarity)
        assert abs(np.mean(errors)) < 0.05 and np.max(np.abs(errors)) < near_dup.MARGIN


def test_line_dedup(docs, rows, nothing):
    found, first = [], {}
    order = sorted({(i, t) for i, t, *_ in rows}, key=lambda x: x[0])
    for i, t in order:
        lines = t.split("\n") if t is not None else []
        nb = [(k, x, len(WORD.findall(x))) for k, x in enumerate(lines) if WORD.search(x)]
        windows = set()
        for a in range(len(nb)):
            for step in (1, -1):
                n = 0
                for b in range(a, len(nb) if step > 0 else -1, step):
                    n += nb[b][2]
                    if n >= 50:
                        windows.add((min(a, b), max(a, b)))
                        break
        found.append((i, t, lines, nb, sorted(windows)))
        for a, b in sorted(windows):
            first.setdefault(tuple(x[1] for x in nb[a : b + 1]), (i, a))
    want = {}
    for i, t, lines, nb, windows in found:
        gone = {k for a, b in windows if first[tuple(x[1] for x in nb[a : b + 1])] != (i, a) for k in range(nb[a][0], nb[b][0] + 1)}
        want[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    got = line_dedup.dedup_lines(docs.withColumn("id", F.lit("clash")).withColumn("line", F.lit(0)))
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter((i, want[i]) for i, *_ in rows)
    assert sum(want[i] != t for i, t, *_ in rows) > 3
    assert line_dedup.dedup_lines(nothing).count() == 0


def base_of(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    rep = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_quality(spark, docs, rows, nothing, monkeypatch):
    got = quality.judge(docs).collect()
    want = collections.Counter((i, *base_of(t)) for i, t, *_ in rows)
    assert collections.Counter((r["row"]["doc_id"], *[r[m] for m in quality.MEASURES]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    monkeypatch.setattr(quality, "FEW", 0)  # the way for texts with many repeated windows
    assert collections.Counter((r["row"]["doc_id"], *[r[m] for m in quality.MEASURES]) for r in quality.judge(docs).collect()) == want
    assert quality.passed(nothing).count() == 0 and quality.passed(docs).columns == docs.columns


def test_quality_adapts_to_groups(spark):
    """Documents full of symbols are ordinary in one source, and outliers in another."""
    rng = random.Random(1)
    text = lambda share: " ".join("#*" if rng.random() < share else "".join(rng.choices("abcdefgh", k=5)) for _ in range(120))
    rows = [(i, text(0.0), "en", "prose") for i in range(300)] + [(1000 + i, text(0.4), "en", "code") for i in range(300)] + [(5000, text(0.4), "en", "prose")]
    got = {r["row"]["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(5000) and all(got.values())


def test_quality_blends_small_groups(spark):
    """A group's own documents count from the first on: the more there are, the less those of its language do."""
    rng = random.Random(2)
    text = lambda share: " ".join("#*" if rng.random() < share else "".join(rng.choices("abcdefgh", k=5)) for _ in range(120))
    for n, fine in ((8, False), (60, True)):
        rows = [(i, text(0.0), "en", "prose") for i in range(200)] + [(1000 + i, text(0.4), "en", "code") for i in range(n)] + [(2000, text(0.0), None, "other")]
        got = {r["row"]["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        assert all(got[i] for i in (*range(200), 2000)) and [got[1000 + i] for i in range(n)] == [fine] * n


def test_quality_sees_lines_that_are_often_repeated(spark):
    rng = random.Random(3)
    line = lambda k: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(k))
    clean = [(i, "\n".join(line(12) for _ in range(12)), "en", "s") for i in range(40)]
    bad = line(2)
    rows = [*clean, (99, "\n".join([*[line(30) for _ in range(6)], *[bad] * 6]), "en", "s")]
    got = {r["row"]["doc_id"]: (r["kept"], r["base_failed"]) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got.pop(99) == (False, False) and all(k for k, _ in got.values())


def test_sketch_merges(spark):
    d = spark.range(5000).select((F.col("id") * 37 % 10007).alias("x"))
    b = d.select("x", quality.bucket(F.col("x")).alias("b")).collect()
    assert all(r["b"] <= r["x"] and r["x"] - r["b"] <= r["x"] / 32 for r in b)


def test_bpe_equals_library(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    more = ["<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "  \n\n\t x  ", "I'll we've 'S", "日本語 ünï ½ ²", "\x1c\x1d x\x85y\u00a0z\u2028", "e\u0301\u0300 👩‍👩‍👧", "x" * 3000, "\u200b\ufeff", "१२३ abc123"]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(more, 100_000)), "doc_id long, text string")).withColumn("ids_", F.lit(0))
    got = bpe.encode_decode(d, path)
    assert got.columns == [*d.columns, "ids", "decoded"]
    for r in got.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids, r["text"]
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_bpe_on_random_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, v = Tokenizer.from_file(path), bpe.vocabulary(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
    def check(text):
        packed = v.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert v.decode(packed) == text

    check()


RULES = [url_filter.Rule("org/", False), url_filter.Rule("example.org/es/", True), url_filter.Rule("com/de/", True)]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y", "https://example.org/en", "http://badorg/x", "http://x.com/de/", "http://x.com/de", "http://org", "ftp://h/p#f", "a://b://c/d"]
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(d, RULES, url_filter.UrlModel(None, 0.0)).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(len(urls))] == [("", "")] * 3 + [("a.example.org", "/es/x"), ("example.org", "/en"), ("badorg", "/x"), ("x.com", "/de/"), ("x.com", "/de"), ("org", ""), ("h", "/p"), ("b:", "//c/d")]
    assert [got[i]["rule"] for i in range(len(urls))] == [None] * 3 + ["example.org/es/", "org/", None, "com/de/", None, None, None, None]
    assert [got[i]["verdict"] for i in (3, 4, 6, 0)] == ["block", "allow", "block", "allow"]


def test_url_model_on_held_out_hosts(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choices("bcdfglmnprst", k=4)) + "a" + "".join(rng.choices("bcdfglmnprst", k=2))
    rows = []
    for _ in range(600):
        bad = rng.random() < 0.4
        host = f"{rng.choice(['cheap-pills', 'casino-win', 'hot-loans']) if bad else name()}{rng.randrange(99)}.{rng.choice(['com', 'net'])}"
        rows.append((host, f"/{name()}/{rng.randrange(999)}", int(bad)))
    d = spark.createDataFrame(rows, "host string, path string, blocked int")
    model = url_filter.train(d.limit(400))
    got = model.score(d, "host", "path", "p").collect()[400:]
    assert np.mean([(r["p"] >= 0.5) == bool(r["blocked"]) for r in got]) > 0.95
    assert url_filter.train(d.filter("false")).constant == 0.0


def test_url_model_of_the_shipped_table(spark):
    labelled = labelled_urls(spark)
    assert labelled.count() == labelled.distinct().count() <= 200
    assert url_filter.held_out_accuracy(labelled) > 0.85


def test_long_pages_in_archives(spark, tmp_path, monkeypatch):
    """Files are bounded by bytes: long pages share theirs with fewer others."""
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 8)
    monkeypatch.setattr(warc, "FILE_BYTES", 8000)
    rows = [(i, "http://x.y/", "x" * n) for i, n in enumerate([10, 900, 1001, 1500, 2500, 7000, 9000, 30000, 0] * 4)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w")).select("page_id", "payload_bytes", "file").collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(i, len(h)) for i, _, h in rows]
    sizes = collections.defaultdict(list)
    for r in got:
        sizes[r["file"]].append(r["payload_bytes"])
    assert all(sum(v) <= 8000 or len(v) == 1 for v in sizes.values())


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>x</p>", "", None, "a\r\n\r\nWARC/1.1\r\n\r\n", "é" * 3000, "<p>x</p>", "", "<p>x</p>"]
    rows = [(i, None if i == 4 else f"http://{'ab'[i % 2]}.example.com/p q%20/{i}\n", h, "clash") for i, h in enumerate(html)]
    rows += [rows[3], (None, "http://c.d/", "<p>x</p>", "clash")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    warc.write_warc(d, str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), payloads=True).collect()
    keeper = {}
    for i, _, h, _ in rows:
        if i is not None:
            keeper[h or ""] = max(i, keeper.get(h or "", -1))
    want = collections.Counter()
    for i, u, h, _ in rows:
        p = (h or "").encode()
        to = None if keeper[h or ""] == i else keeper[h or ""]
        want[i, u, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to, p if to is None else None] += 1
    cols = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collections.Counter((*[r[c] for c in cols], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    merged = warc.merge_index(warc.read_warc(spark, str(tmp_path / "w")), range_rows=3).orderBy("range_no", "range_pos").collect()
    keys = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in merged]
    assert keys == sorted(keys) and len(keys) == len(rows) and len({r["range_no"] for r in merged}) > 1


def test_loser_tree():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree([iter([(x,) for x in r]) for r in runs])) == sorted((x,) for r in runs for x in r)


PAGE = '<html><head><title>T {0}</title><script>var a="</p>";</script></head><body><div id="nav-{0}"><a href="/">Home</a></div><header>H</header>{1}<div class="comments"><p>nice {0}</p></div><footer>&copy; {0}</footer></body></html>'


def test_html_articles(spark):
    rows = []
    for i in range(8):
        extra = "<aside>side</aside>" if i % 2 else ""
        paras = "".join(f"<p>par {k} of &lt;{i}&gt; &amp; <b>bold\n {k}</b> end" + ("</p>" if k % 2 else "") for k in range(i))
        rows.append((i, f"http://h{i % 2}.x/{i}", PAGE.format(i, f"<article><h1>Head&nbsp;{i}</h1>{extra}{paras}</article>"), "clash"))
    rows += [(8, None, None, "c"), (9, "http://h0.x/9", "", "c"), (10, "http://h0.x/10", "<article><p>cut &am", "c"), (11, "http://h0.x/11", "<p>a < b<br>c<p hid", "c"), rows[3]]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = collections.defaultdict(set)
    for r in html_wrappers.extract(d).collect():
        got[r["page_id"]].add(r["text"])
    for i in range(8):
        assert got[i] == {"\n".join([f"Head {i}", *[f"par {k} of <{i}> & bold {k} end" for k in range(i)]])}
    assert got[8] == {""} and got[9] == {""} and got[10] == {"cut &am"} and got[11] == {"a < b c"}
    assert html_wrappers.extract(d.filter("false")).count() == 0


def test_html_template_text_is_dropped(spark):
    """Without an element of content, what all pages of the host share is the template."""
    rows = [(i, "http://h.x/", f"<body><div class=top>Welcome to the site</div><div class=b><p>story {i} one</p><p>two {i}</p></div></body>") for i in range(5)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_wrappers.extract(d).collect()} == {i: f"story {i} one\ntwo {i}" for i in range(5)}


def test_html_template_text_in_articles_is_dropped(spark):
    """A notice without a telling class is template if all articles of the host have it; constants within a sentence stay."""
    page = "<body>{}<{}><h1>Title {}</h1><div class=box><b>Sale!</b> Buy now</div><p>By <i>{}</i> of the staff</p>{}</{}></body>"
    tags = {"a": "article", "m": "main", "n": "div class=content"}
    rows = [(k * 10 + i, f"http://{h}.x/{i}", page.format("", t, i, i, "<blockquote>Some say</blockquote>" if i > 2 else "", t.split()[0])) for k, (h, t) in enumerate(tags.items()) for i in range(5)]
    same = "<body><i>{}</i><article><h1>Once</h1><p>told</p></article></body>"
    rows += [(40 + i, "http://same.x/", same.format(i)) for i in range(3)] + [(50, "http://one.x/", page.format("", "article", 0, 0, "", "article")), (6, "http://a.x/", "")]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(3):
        for i in range(5):
            assert got[k * 10 + i] == f"Title {i}\nBy {i} of the staff" + ("\nSome say" if i > 2 else "")
    assert [got[40 + i] for i in range(3)] == ["Once\ntold"] * 3
    assert got[50] == "Title 0\nSale! Buy now\nBy 0 of the staff" and got[6] == ""


def test_html_constants_of_running_text_stay(spark):
    """Headings and quotations that all articles of a host have, and titles in the article's own header."""
    recipe = "<article><h1>Dish {0}</h1><h2>Ingredients</h2><ul><li>salt {0}</li></ul><h3>Method</h3><p>Stir {0} times.</p></article>"
    title = "<article><div class='article-header'><h1>The same title</h1></div><p>other text {0}</p></article>"
    quote = "<main><p>news {0}</p><blockquote>We shall see, said all.</blockquote></main>"
    rows = [(k * 10 + i, f"http://{k}.x/{i}", t.format(i)) for k, t in enumerate((recipe, title, quote)) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(4):
        assert got[i] == f"Dish {i}\nIngredients\nsalt {i}\nMethod\nStir {i} times."
        assert got[10 + i] == f"The same title\nother text {i}"
        assert got[20 + i] == f"news {i}\nWe shall see, said all."


def test_html_texts_are_compared_whole(spark):
    """Lone blocks stay where only their first 64 characters agree, and on hosts of nothing but copies."""
    lead = "The council met in the great hall of the old town on Monday evening and "
    rows = [(i, "http://h.x/", f"<body><div>Standing notice</div><div class=b><h2>{lead}{i}</h2></div></body>") for i in range(4)]
    rows += [(10 + i, "http://copies.x/", f"<body><nav>Visit {i}</nav><h1>Head</h1><p>text</p></body>") for i in range(3)] + [(20, "http://h.x/", None), (21, "http://copies.x/", "<nav>x</nav>")]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"{lead}{i}" for i in range(4)} | {10 + i: "Head\ntext" for i in range(3)} | {20: "", 21: ""}


def test_html_of_deep_pages(spark):
    """Trees of any depth: what is too deep stays in what it is in."""
    deep = "<div>" * 10_000
    rows = [(0, "http://a.x/", f"{deep}<article><p>hi <b>there</b></p><nav><ul><li>menu</li></ul></nav><p>you</p></article>"), (1, "http://b.x/", "<b>" * 20_000 + "bold"), (2, "http://c.x/", f"<article>{deep}in<nav>no</nav></article>"), (3, "http://d.x/", "<article>" + "<p>word</p>" * 100_000 + "</article>")]
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].split() == ["hi", "there", "you"] and got[1] == "bold" and got[2] == "in" and got[3] == "\n".join(["word"] * 100_000)


def test_longest_common_labels():
    rng = random.Random(8)
    for _ in range(400):
        a, b = (rng.choices("abcd", k=rng.randrange(12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = html_wrappers.matches(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p < q and x < y for (p, x), (q, y) in zip(got, got[1:]))


def test_wrapper_alignment():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul><div>d</div><p>y</p>"]
    items = html_wrappers.aligned(*[html_wrappers.own(html_wrappers.parse(p)) for p in pages])
    assert html_wrappers.expression(items) == "<ul>(<li>#text</li>)+</ul>(<div>d</div>)?<p>#text</p>"


def neighbours(d, recall_of, **options):
    """The mean share of the true 20 neighbours that are found, with ranks, order and scores checked."""
    got = collections.defaultdict(list)
    for r in permutation_index.nearest(d, F.col("vec_id") % 20 == 0, **options).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids, x = recall_of
    x, recall = x.astype(float), []
    place = {i: k for k, i in enumerate(ids.tolist())}
    assert set(got) == {i for i in place if i % 20 == 0}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and found == sorted(found, key=lambda f: (-f[2], f[1]))
        score = x @ x[place[q]]
        assert all(abs(score[place[v]] - s) <= 1e-9 * max(1, abs(s)) and v != q for _, v, s in found)
        score[place[q]] = -np.inf
        best = np.lexsort((ids, -np.round(score, 9)))[:20]
        recall.append(len({v for _, v, _ in found} & set(ids[best].tolist())) / 20)
    return np.mean(recall)


def test_permutation_index(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 24)).astype("float32")
    x[50:90] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [float("inf")] + [1.0] * 23), (5080, []), (5100, [None] + [1.0] * 23), (None, [1.0] * 24)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").unionByName(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    d = d.withColumns({c: F.lit(1) for c in ("vec", "dim", "near", "rank", "score", "query_id", "h", "shard")})
    assert neighbours(d, (np.arange(1200), x)) >= 0.9
    few = permutation_index.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), F.col("vec_id") == 0)
    assert few.count() == 2 and permutation_index.nearest(d.filter("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("spread", [0.3, 1.0])
def test_permutation_index_of_unequal_norms(spark, spread):
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(3000, 32)) * np.exp(rng.normal(size=(3000, 1)) * spread)).astype("float32")
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert neighbours(d, (np.arange(3000), x)) >= 0.9


def test_permutation_index_of_the_given_vectors(spark):
    """The registered query's recall, with a tenth of the rows reranked."""
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in d.collect() if r["embedding"] is not None and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    assert permutation_index.SHARE <= 0.1
    assert neighbours(d, (np.array([i for i, _ in rows]), np.array([v for _, v in rows]))) >= 0.9


def test_mixing(spark, docs, nothing):
    want = {"lang": {"en": 0.7}, "source": {"s0": 0.5, "s1": 0.2}}
    topic = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")
    got = mixing.mix(docs, want, 0.6, topic=topic).select("*", "mix.*").collect()
    total = sum(r["tokens"] for r in got)
    share = lambda f: sum(r["tokens"] * (r["weight"] or 0) for r in got if f(r)) / total
    assert share(lambda r: r["lang"] == "en") == pytest.approx(0.7, abs=1e-6)
    assert share(lambda r: r["source"] == "s0") == pytest.approx(0.5, abs=1e-6) and share(lambda r: r["source"] == "s1") == pytest.approx(0.2, abs=1e-6)
    assert sum(r["tokens"] * r["probability"] for r in got) / total == pytest.approx(0.6, abs=1e-6)
    again = {(r["doc_id"], r["mix"]["drawn"]) for r in mixing.mix(docs.repartition(2), want, 0.6, topic=topic).collect()}
    assert again == {(r["doc_id"], r["drawn"]) for r in got}
    assert mixing.mix(nothing, want).count() == 0


def test_mixing_as_aggregations(docs, monkeypatch):
    want = {"lang": {"en": 0.7}, "topic": {"prose": 0.5}}
    small = {r["doc_id"]: r["mix"]["probability"] for r in mixing.mix(docs, want).collect()}
    monkeypatch.setattr(mixing, "CELLS", 0)
    monkeypatch.setattr(mixing, "ROUNDS", 50)
    monkeypatch.setattr(mixing, "ERROR", 1e-4)
    monkeypatch.setattr(mixing, "calibrated", lambda cells, budget, steps=12, f=mixing.calibrated: f(cells, budget, steps))
    large = {r["doc_id"]: r["mix"]["probability"] for r in mixing.mix(docs, want).collect()}
    assert all(abs(small[k] - large[k]) < 0.02 for k in small)


def test_empty_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    assert warc.merge_index(warc.read_warc(spark, str(tmp_path / "w"))).count() == 0
    model = url_filter.train(labelled_urls(spark))
    assert url_filter.judge(pages, RULES, model).count() == 0
    assert bpe.encode_decode(pages.select("page_id", F.col("html").alias("text")), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.fixture(scope="module")
def odd_tables(spark, rows, tmp_path_factory):
    """documents and pages with odd rows, as a folder of tables; repeated rows have ids of their own."""
    folder = tmp_path_factory.mktemp("odd")
    docs = [(k, *r) for k, (_, *r) in enumerate(rows)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(folder / "documents.parquet"))
    pages = [(1, "https://A.Example.org:8080/X?q=1#f", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "no scheme", None), (4, "http://u@b.com", ""), (5, "http://b.com/%20 a", "ñ"), (6, "http://b.com/%20 a", "ñ")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    spark.createDataFrame([(1, "a b, A-c"), (2, None), (3, ""), (4, "éd ed\n10")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(corpus_queries.oracle_sql()))
@pytest.mark.parametrize("sf", ["odd", "/root/testdata/sf0.001"])
def test_queries_equal_sql(spark, odd_tables, name, sf):
    import duckdb

    folder = odd_tables if sf == "odd" else sf
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet{'/*.parquet' if sf == 'odd' else ''}'")
    got = corpus_queries.queries()[name](spark, folder)
    cols = ", ".join(sorted(got.columns))
    want = db.sql(f"SELECT {cols} FROM ({corpus_queries.oracle_sql()[name]})").fetchall()
    assert collections.Counter(tuple(r) for r in got.selectExpr(*cols.split(", ")).collect()) == collections.Counter(want)
