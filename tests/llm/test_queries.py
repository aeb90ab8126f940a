"""The registered corpus queries without SQL, and the pipeline stage by stage, against brute force on small tables."""

import collections
import hashlib
import html
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from versespark.llm import queries as corpus_queries
from versespark.llm import sql

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest given tables, and a folder with odd rows: nulls, empty and long texts, ties, copies, extra columns."""
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdeéß日", k=rng.randrange(2, 8))) for _ in range(200)]
    line = lambda k: " ".join(rng.choices(vocab, k=k))
    passage = "\n".join(line(20) for _ in range(4))
    texts = ["\n".join(line(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    texts += [f"{passage}\n{texts[k]}" for k in range(4)] + [texts[5], texts[5], texts[6] + " more", None, "", " \n ", "one", "a" * 900, "<|endoftext|> x", line(5000)]
    folder = tmp_path_factory.mktemp("odd")
    docs = [(3 * k, t, None if k % 7 == 3 else "en", None if k % 5 == 4 else f"s{k % 3}", None if t is None else len(t), "clash") for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, ids string").write.parquet(str(folder / "documents.parquet"))
    x = np.random.default_rng(4).normal(size=(400, 16))
    x[10:40] = x[10]
    vectors = [(k, v.tolist(), k) for k, v in enumerate(x)] + [(500, None, 0), (520, [0.0] * 16, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int").write.parquet(str(folder / "embeddings.parquet"))
    pages = [(1, "https://A.Example.org/es/q?x", "<article><p>one</p></article>", "clash"), (2, None, None, "clash"), (3, "none", "", "clash"), (4, "http://b.com/de/", "<article><h1>T&amp;U</h1><p>a<br>b<b>c</b></article>", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string, text string").write.parquet(str(folder / "pages.parquet"))
    return {"odd": str(folder), "given": SMALL}


def rows_of(spark, folder, table, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{table}.parquet").select(*cols).collect()]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def groups(docs, width):
    """id -> smallest id that links of similarity 0.8 reach."""
    sets = {i: shingles(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, j in enumerate(ids):
        for i in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}, sets


@pytest.mark.parametrize("at", ["odd", "given"])
def test_op1(spark, folders, at):
    docs = rows_of(spark, folders[at], "documents", "doc_id", "text")
    data = {i: (t or "").encode() for i, t in docs}
    seen = collections.Counter(hash(b[k : k + 200]) for b in data.values() for k in range(len(b) - 199))
    want = set()
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, np.int8)
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                gone[k : k + 200] = 1
        kept = np.frombuffer(b, np.uint8)[gone[: len(b)] == 0].tobytes()
        want.add((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = corpus_queries.op1_substring_dedup(spark, folders[at]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


@pytest.mark.parametrize("at", ["odd", "given"])
def test_op2(spark, folders, at):
    vectors = {i: np.array(v, float) for i, v in rows_of(spark, folders[at], "embeddings", "vec_id", "embedding") if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids.tolist()])
    got = collections.defaultdict(list)
    for r in corpus_queries.op2_permutation_index(spark, folders[at]).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in vectors if i % 20 == 0}
    recall = []
    for q, found in got.items():
        score = x @ vectors[q]
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -np.round(score, 9)))[:20]].tolist()
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1] for f in found] == [v for _, v in sorted((-f[2], f[1]) for f in found)]
        recall.append(len(set(best) & {f[1] for f in found}) / 20)
    assert np.mean(recall) >= 0.9


BLOCK = re.compile(r"</?(?:p|h[1-6]|div|ul|ol|li|article|section|blockquote|table|tr|td)\b[^>]*>")


@pytest.mark.parametrize("at", ["odd", "given"])
def test_op3(spark, folders, at):
    """The article of each page, cut at block tags; a simple way that these tables allow."""
    want = set()
    for i, u, page in rows_of(spark, folders[at], "pages", "page_id", "url", "html"):
        page = re.sub(r"(?s)<!--.*?-->|<(script|style|nav|aside|footer|header|form)\b.*?</\1>", "", page or "")
        page = re.sub(r'(?s)<(div|section|ul) (?:class|id)="(?:comments?|ad|sidebar|cookie[^"]*|notice|share|related|promo)[^"]*">.*?</\1>', "", page)
        m = re.search(r"(?s)<article\b[^>]*>(.*?)(?:</article>|\Z)", page)
        blocks = BLOCK.split(re.sub(r"<br ?/?>", " ", m[1])) if m else []
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        text = "\n".join(t for t in texts if t)
        want.add((i, u, text, len(text)))
    got = {tuple(r) for r in corpus_queries.op3_html_wrappers(spark, folders[at]).select("page_id", "url", "text", "n_chars").collect()}
    assert got == want


@pytest.mark.parametrize("at", ["odd", "given"])
def test_op4(spark, folders, at):
    docs = rows_of(spark, folders[at], "documents", "doc_id", "text")
    root, sets = groups(docs, 2)
    got = corpus_queries.op4_near_dedup(spark, folders[at]).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got) == sorted((i, len(sets[i]), root[i], root[i] == i) for i, _ in docs)


@pytest.mark.parametrize("at", ["odd", "given"])
def test_op5(spark, folders, at):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = set()
    for i, text in rows_of(spark, folders[at], "documents", "doc_id", "text"):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert {tuple(r) for r in corpus_queries.op5_bpe_round_trip(spark, folders[at]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


@pytest.mark.parametrize("at", ["odd", "given"])
def test_op7(spark, folders, at):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    seen = set()
    for r in corpus_queries.op7_url_filter(spark, folders[at]).join(spark.read.parquet(f"{folders[at]}/pages.parquet").select("page_id", "url"), "page_id").collect():
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(len(t), t, v) for t, v in rules if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
        name, verdict = max(fit)[1:] if fit else (None, None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
        seen.add(r["page_id"])
    assert len(seen) == len(rows_of(spark, folders[at], "pages", "page_id"))


@pytest.mark.parametrize("at", ["odd", "given"])
def test_pipeline(spark, folders, at, tmp_path):
    """Each stage on what the stage before it kept."""
    docs = spark.read.parquet(f"{folders[at]}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    cols = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs.write.parquet(str(tmp_path / name))
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS FROM '{tmp_path / name}/*.parquet'")
        out = stage(spark, spark.read.parquet(str(tmp_path / name)), folders[at])
        out.write.parquet(str(tmp_path / f"{name}-out"))
        docs = spark.read.parquet(str(tmp_path / f"{name}-out"))
        assert docs.columns == cols or name == "bpe"
        after = {r["doc_id"]: r for r in docs.collect()}
        kept[name] = set(after)
        if name == "quality_rules":
            want = {i for (i,) in db.sql(f"SELECT doc_id FROM ({sql.QUALITY}) WHERE kept").fetchall()}
            assert set(after) == want and all(after[i] == before[i] for i in after)
        if name == "line_dedup":
            want = {i: h for i, h in db.sql(f"SELECT doc_id, kept_sha256 FROM ({sql.LINES})").fetchall()}
            assert {i: hashlib.sha256((r["text"] or "").encode()).hexdigest() for i, r in after.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after.values() if r["text"] is not None)
        if name == "near_dedup":
            root, _ = groups([(i, r["text"]) for i, r in before.items()], 5)
            assert set(after) == {i for i in root if root[i] == i} and all(after[i] == before[i] for i in after)
        if name == "mixing":
            want = {i for (i,) in db.sql(f"SELECT doc_id FROM ({sql.mixing_sql(corpus_queries.MIX, corpus_pipeline.BUDGET)}) WHERE drawn").fetchall()}
            assert set(after) == want and all(after[i] == before[i] for i in after)
        if name == "bpe":
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(corpus_queries.tokenizer_path())
            assert {i: (r["n_tokens"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["round_trip"]) for i, r in after.items()} == {i: (len(x := t.encode(r["text"] or "", add_special_tokens=False).ids), x, True) for i, r in before.items()}
    assert 0 < len(kept["bpe"]) <= len(kept["near_dedup"]) < len(before) + len(kept["quality_rules"])


def test_pipeline_of_nothing(spark, folders, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
