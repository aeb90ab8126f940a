"""Each reader and writer on small files, and the streams batch by batch."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from versespark import streaming
from versespark.operators import alignment as L
from versespark.operators import assembly as A
from versespark.operators import checks as C
from versespark.operators import routes as R
from versespark.operators import sections
from versespark.sources import readers, sinks, staging


def rows(d):
    return sorted(tuple(r) for r in d.collect())


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "x": "अ"}, {"id": 2}], indent=1, ensure_ascii=False))
    assert rows(readers.json_array(spark, str(tmp_path / "a.json"), "id int, x string").fillna("")) == [(1, "अ"), (2, "")]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": 3}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "b.jsonl"), "id int")) == [(1,), (3,)]
    for k in (1, 2):
        (tmp_path / f"pages-{k}.json").write_text(json.dumps({"pages": [{"pdfPage": 10 * k}, {"pdfPage": 10 * k + 1}]}))
    (tmp_path / "pages-3.json").write_text("{broken")
    assert rows(readers.proof_pages(spark, str(tmp_path / "pages-*.json"), "pdfPage:int")) == [("pages-1.json", 0, 10), ("pages-1.json", 1, 11), ("pages-2.json", 0, 20), ("pages-2.json", 1, 21)]


def test_keyed_chunks(spark, tmp_path):
    for k, keys in enumerate((["a", "b"], ["c"])):
        (tmp_path / f"chunk-{k}.json").write_text(json.dumps({x: {"n": k} for x in keys}))
    glob = str(tmp_path / "chunk-*.json")
    assert rows(readers.keyed_chunks(spark, glob, "struct<n:int>").select("key", "value.n")) == [("a", 0), ("b", 0), ("c", 1)]
    (tmp_path / "chunk-9.json").write_text(json.dumps({"a": {"n": 9}}))
    with pytest.raises(Exception, match="in two files: a"):
        readers.keyed_chunks(spark, glob, "struct<n:int>").collect()


def test_sections_of_plain_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# 1\none\ntwo\n\nthree\n# 2\r\nfour\r\n")
    got = rows(readers.sectioned(spark, str(tmp_path / "t.txt"), r"# (\d+)").select("number", "block_no", "line_no", "text"))
    assert got == [(1, 0, 0, "one"), (1, 0, 1, "two"), (1, 1, 0, "three"), (2, 0, 0, "four")]


def test_spans_files_and_ingest(spark, tmp_path):
    s = spark.createDataFrame([(1, 10.0, 12.0, (5.0, 0.0, 6.0, 1.0)), (1, 10.0, 12.1, (1.0, 0.0, 2.0, 1.0)), (1, 20.0, 12.0, (0.0, 9.0, 1.0, 9.5)), (1, 20.0, 15.0, (2.0, 9.0, 3.0, 9.5))], f"page int, baseline double, font_size double, bbox {readers.BOX}")
    assert [r["bbox"]["x0"] for r in readers.body_spans(s).collect()] == [1.0, 5.0]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    (tmp_path / "f" / "b.bin").write_bytes(b"")
    f = readers.files(spark, str(tmp_path / "f"))
    want = {"a.bin": hashlib.sha256(b"abc").hexdigest()}
    assert {r["path"].split("/")[-1]: r["sha256"] for r in sinks.checksums(f).collect()} == want
    m = spark.createDataFrame([("a.bin", 3, want["a.bin"]), ("b.bin", 1, "x"), ("c.bin", 1, "x"), ("a.bin", 4, "x"), ("a.bin", 3, "x")], "file string, bytes long, sha256 string")
    assert rows(C.checksum_mismatches(f, m)) == [("a.bin", "content"), ("a.bin", "size"), ("b.bin", "missing"), ("c.bin", "missing")]
    done = f.select(F.when(F.col("path").endswith("a.bin"), 1).otherwise(2).alias("page"), "length")
    assert rows(readers.pages_to_do(spark.createDataFrame([(1,), (2,), (3,)], "page int"), done)) == [(2,), (3,)]


def test_writers(spark, tmp_path):
    d = spark.range(100).withColumn("t", F.concat(F.lit("x"), F.col("id").cast("string"))).repartition(7)
    for k in "ab":
        sinks.corpus(d, str(tmp_path / k), ["id"], 3)
    texts = ["".join(p.read_text() for p in sorted((tmp_path / k).glob("part-*"))) for k in "ab"]
    assert texts[0] == texts[1] and [json.loads(x)["id"] for x in texts[0].splitlines()] == list(range(100))
    sinks.json_lines(d, str(tmp_path / "j"))
    assert rows(readers.json_lines(spark, str(tmp_path / "j"), "id long, t string")) == rows(d)
    x = spark.createDataFrame([("s", 2, 1, "c"), ("s", 1, 1, "a"), ("s", 1, 2, "b")], "sec string, entry int, n int, text string")
    assert sinks.report(x, "sec", "entry", "n", "text").first()["markdown"] == "## s\n\n### 1\n\na\nb\n\n### 2\n\nc"
    sinks.audit(spark.range(1).select(F.lit(5).alias("pads")), {"lost": d.limit(2)}, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit" / "counts")).first()["pads"] == 5 and spark.read.json(str(tmp_path / "audit" / "lost")).count() == 2


def test_staged_tables_are_released(spark):
    d = staging.staged(spark.range(3), "numbers")
    assert d.count() == 3
    (path,) = {f.rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:") for f in d.inputFiles()}
    import os

    assert path.startswith(staging.staging_dir(spark)) and os.path.isdir(path)


def test_search_index_is_shared_and_built_again(spark):
    import shutil

    from versespark.plans import tables

    a = tables.index_of(spark, "/root/testdata/sf0.001")
    assert tables.index_of(spark, "/root/testdata/sf0.001") is a and staging.there(a.dim)
    shutil.rmtree(a.dim.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:"))
    b = tables.index_of(spark, "/root/testdata/sf0.001")
    assert b is not a and b.dim.count() > 0


def test_newest_query_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("session string, request_id long, query string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in ([("a", 1, "x"), ("a", 3, "xyz"), ("b", 2, "q")], [("a", 2, "xy"), ("c", 5, "n")], [("b", 4, "qq")]):
        spark.createDataFrame(part, "session string, request_id long, query string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streaming.newest_only_stream(stream, lambda d: d.withColumn("answer", F.upper("query")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "answers")).select("batch", "session", "request_id", "answer")
    assert rows(got) == [(0, "a", 3, "XYZ"), (0, "b", 2, "Q"), (1, "c", 5, "N"), (2, "b", 4, "QQ")]
    seen = streaming.state_of(spark, str(tmp_path / "cp"), "session string, request_id long")
    assert rows(seen) == [("a", 3), ("b", 4), ("c", 5)]


def test_ingest_takes_up_new_files_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    asked, failing = [], {"b"}

    def work(pages):
        asked.append(sorted(r["page"] for r in pages.select("page").collect()))
        text = F.when(F.col("page").isin(sorted(failing)), "").otherwise(F.upper(F.col("content").cast("string"))) if failing else F.upper(F.col("content").cast("string"))
        return pages.select("page", text.alias("text"))

    run = lambda: readers.ingest(spark, str(tmp_path / "in"), work, str(tmp_path / "out"), str(tmp_path / "cp"))
    for name in "ab":
        (tmp_path / "in" / f"{name}.txt").write_text(f"text {name}")
    run()
    assert asked == [["a", "b"], ["b"]]  # what came out empty is tried again
    failing.clear()
    asked.clear()
    (tmp_path / "in" / "c.txt").write_text("text c")
    run()
    assert asked == [["c"], ["b"]]
    asked.clear()
    run()
    assert asked == [[]]
    assert rows(readers.ingested(spark, str(tmp_path / "out"))) == [("a", "TEXT A"), ("b", "TEXT B"), ("c", "TEXT C")]


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "request_id long, bytes long, total long, complete boolean"
    spark.createDataFrame([(1, 5, 10, False), (1, 10, 10, False), (1, 10, 10, True), (2, 1, 2, False), (1, 0, None, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streaming.progress_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), spark.createDataFrame([(1,)], "request_id long"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["progress"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0.0, 0.5, 0.99, 1.0]


def test_counts_that_do_not_add_up(spark):
    lines = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "p long, n_line long")
    regions = spark.createDataFrame([(1, 0, 2, "x"), (2, 0, 1, "y")], "p long, region_no int, n_lines long, box string")
    assert rows(A.located_blocks(lines, regions, "p", "n_line").select("p", "n_line", "box")) == [(1, 0, "x"), (1, 1, "x"), (2, 0, "y")]
    with pytest.raises(Exception, match="don't add up"):
        A.located_blocks(lines, regions.withColumn("n_lines", F.col("n_lines") + 1), "p", "n_line").collect()


def test_music(spark):
    d = spark.createDataFrame([(["(राग भैरवी — तीन ताल)", "(तर्ज — x)"],), (["(राग देस)"],), (["title", "(होरी)"],), ([],)], "h array<string>")
    got = [tuple(r) for r in d.select(*[v.alias(k) for k, v in A.music(F.col("h")).items()]).collect()]
    assert got == [("भैरवी", "तीन", "तर्ज — x"), ("देस", None, None), (None, None, "होरी"), (None, None, None)]


def test_headings_look_ahead(spark):
    parts = [["[1]", "(राग x", "Title", "(sub)", "line।"], ["Name", "first॥", "b"], ["Name", "first", "b"], ["(a)", "(b)"]]
    d = spark.createDataFrame([(p, i, t) for p, lines in enumerate(parts) for i, t in enumerate(lines)], "p long, i long, t string")
    got = A.peeled_headings(d, "p", "i", "t", F.col("t") == "Name").orderBy("p", "i").collect()
    roles = [[r["role"] for r in got if r["p"] == p] for p in range(len(parts))]
    assert roles == [["number", "heading", "heading", "heading", "verse"], ["heading", "verse", "verse"], ["verse"] * 3, ["heading"] * 2]


def test_best_similarity_needs_letters(spark):
    a = spark.createDataFrame([(1, 1, "Abcdefgh-ijklm"), (1, 2, "short"), (1, 3, "zzzzzzzzzzzzzz"), (2, 4, "abcdefghijklm")], "page long, key long, text string")
    b = spark.createDataFrame([(1, "abcdefgh ijklm"), (1, "abcdefghijklx")], "page long, text string")
    got = {r["key"]: (r["best"], r["missing"]) for r in L.best_similarity(a, b, "page", "key", "text").collect()}
    assert got == {1: (1.0, False), 3: (0.0, True), 4: (0.0, True)}
    box = spark.createDataFrame([(True, 7.0), (True, 50.0), (False, 50.0)], "ok boolean, h double").select(L.believed_box(F.lit("box"), F.col("ok"), F.col("h")))
    assert [r[0] for r in box.collect()] == [None, "box", None]


def test_small_functions(spark):
    d = spark.createDataFrame([("k:10",), ("k:9",), ("a",)], "k string")
    assert [r["k"] for r in d.orderBy(*sections.numeric_order("k")).collect()] == ["a", "k:9", "k:10"]
    t = spark.createDataFrame([(["a", "b"], "a"), (["a"], "c")], "s array<string>, k string").select(R.toggled(F.col("s"), F.col("k"))).collect()
    assert [r[0] for r in t] == [["b"], ["a", "c"]]
