from pyspark.sql import functions as F

from versespark.operators import adapters as A


def test_search_number(spark):
    d = spark.createDataFrame([(610, 6, True, 3), (1, None, True, 4), (2, None, False, 5), (3, None, False, None)], "id long, search_number long, has_search_number boolean, printed_number long")
    number = lambda x: {r["id"]: r["search_number"] for r in x.collect()}
    assert number(A.search_documents(d, False)) == {610: 6, 1: None, 2: 5, 3: 3}
    assert number(A.search_documents(d, True)) == {610: 6, 1: None, 2: 5, 3: None}


def test_canonical_and_editions(spark):
    e = spark.createDataFrame([(1, "t", "s", [["a", "b"], ["c"]])], "sequence int, title string, section_id string, blocks array<array<string>>")
    s = spark.createDataFrame([("s", "Section")], "section_id string, name string")
    r = A.canonical(e, "m", s).first()
    assert (r["mode"], r["id"], r["section"], r["verses"]) == ("m", 1, "Section", ["a", "b", "c"])
    items = spark.createDataFrame([(1, 7, "other")], "base_id int, id int, title string")
    r = A.other_edition(A.canonical(e, "m", s), items, ["title"], "n").first()
    assert (r["mode"], r["id"], r["title"], r["verses"]) == ("n", 7, "other", ["a", "b", "c"])


def test_row_roles(spark):
    d = spark.createDataFrame([(1, 10.0, "heading"), (1, 600.0, "[1]"), (2, 100.0, "(१२)"), (2, 300.0, "(१२)"), (3, 500.0, "line"), (4, 5.0, "(20)")], "page int, y double, text string")
    z = spark.createDataFrame([(1, 0.0, 50.0)], "page int, y0 double, y1 double")
    got = [r["role"] for r in A.row_roles(d, "page", "y", "text", z, [(4, "(20)")]).orderBy("page", "y").collect()]
    assert got == ["excluded", "marker", "excluded", "body", "body", "marker"]


def test_segments(spark):
    d = spark.createDataFrame([("ab cd ef", ["ab", "cde f"]), ("ab cd ef", ["a", "bcdef"]), ("ab", ["abc"]), ("x y", ["x y"]), ("q", [])], "text string, frag array<string>")
    got = [r["segments"] for r in A.segment_texts(d, "text", "frag").collect()]
    assert got == [["ab ", "cd ef"], ["ab cd ef"], ["ab"], ["x y"], ["q"]]
    assert all("".join(g) == r["text"] for g, r in zip(got, d.collect(), strict=True))
    s = spark.createDataFrame([(["ab", "ca"],)], "s array<string>")
    assert s.select(A.replaced_across(F.col("s"), lambda c: F.translate(c, "a", "x"))).first()[0] == ["xb", "cx"]


def test_notes_and_stanzas(spark):
    rows = spark.createDataFrame([(1, 10.0, "a"), (1, 20.0, "*"), (1, 30.0, "b"), (2, 5.0, "c"), (2, 50.0, "d")], "page int, y double, text string")
    limits = spark.createDataFrame([(2, 40.0)], "page int, note_y double")
    assert [r["is_note"] for r in A.note_lines(rows, "page", "y", F.col("text") == "*", limits).orderBy("page", "y").collect()] == [False, True, True, False, True]
    lines = spark.createDataFrame([(1, 0, 1, "a।"), (1, 1, 1, "b॥"), (1, 2, 2, "c")], "id int, line int, stanza int, text string")
    assert [r["text"] for r in A.numbered_stanzas(lines, "id", "line", "stanza", "text").orderBy("line").collect()] == ["a।", "b॥१॥", "c॥२॥"]
    assert spark.createDataFrame([("one two three",)], "t string").select(A.split_at(F.col("t"), "two")).first()[0] == ["one", "two three"]
