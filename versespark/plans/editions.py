"""Queries of how editions are put together: headings, music, pairs, blocks, stars, note groups, routes and records, with SQL
twins. Order lines, parts and customers stand for printed lines, headings and entries; where the given tables have no text
of a kind, it is derived from their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..functions import text as T
from ..operators import adapters as D
from ..operators import assembly as A
from ..operators import checks as C
from ..operators import geometry as G
from ..operators import notes as N
from ..operators import routes as R
from ..operators import sections
from ..operators import search as S
from ..operators.scan import numbered
from .layout import PLACE
from .search import _first_words_sql, _found, search_sql
from .tables import first_words, lines, table

QUERIES: list = []
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with its SQL twin."""

    def take(f):
        QUERIES.append(f)
        ORACLES[f.__name__] = sql
        return f

    return take


#: Words by part number, as what the lines of an order say.
MODES = ["AIR", "RAIL", "SHIP", "TRUCK", "MAIL"]
PLACED_SQL = f"(select *, {PLACE} as place, {MODES}[1 + l_partkey % 5] as l_shipmode from lineitem)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return li.withColumns({"place": F.expr(PLACE), "l_shipmode": F.get(F.array(*map(F.lit, MODES)), (F.col("l_partkey") % 5).cast("int"))})


#: Order lines as the top of an entry: numbers, headings in parentheses, openers of a raag, plain lines, and lines with dandas.
HEAD_TEXT = """case cast(l_quantity as bigint) % 6 when 0 then '[' || l_linenumber || ']' when 1 then '(' || l_shipmode || ')' when 2 then '(राग ' || l_shipmode
 when 3 then l_shipmode || '।' when 4 then l_shipmode else l_linestatus || '॥' end"""


@query(f"""with t as (select l_orderkey, place, l_linenumber, {HEAD_TEXT} as text, row_number() over (partition by l_orderkey order by place) as r from {PLACED_SQL}),
k as (select *, regexp_matches(text, '^[\\[(][0-9]+[\\])]$') as number, (starts_with(text, '(') and (ends_with(text, ')') or starts_with(text, '(राग '))) as head from t),
f as (select l_orderkey, coalesce(min(case when not number and not head then r end), 1000000) as f from k group by 1),
a as (select l_orderkey, f, k1.text as one, k2.text as two from f left join k k1 using (l_orderkey) left join k k2 using (l_orderkey) where k1.r = f and k2.r = f + 1),
w as (select l_orderkey, case when starts_with(two, '(') and ends_with(two, ')') and not contains(one, '।') and not contains(one, '॥') then 2
  when length(one) < 55 and not contains(one, '।') and not contains(one, '॥') and (ends_with(two, '।') or ends_with(two, '॥')) and one in ('AIR', 'RAIL', 'SHIP') then 1 else 0 end as more from a)
select k.l_orderkey, place, case when r < f then case when number then 'number' else 'heading' end when r < f + coalesce(more, 0) then 'heading' else 'verse' end as role from k join f using (l_orderkey) left join w using (l_orderkey)""")
def heading_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _placed(spark, sf_dir).withColumn("text", F.expr(HEAD_TEXT))
    return A.peeled_headings(d, "l_orderkey", "place", "text", F.col("text").isin("AIR", "RAIL", "SHIP")).select("l_orderkey", "place", "role")


@query("""with h as (select o_orderkey, o_orderpriority || case when o_orderkey % 3 = 0 then ' ' else ' — ' end || case o_orderkey % 4 when 0 then o_orderstatus when 1 then 'ताल ' || o_orderstatus else o_orderstatus || ' ताल' end as inside, case when o_orderkey % 5 = 0 then o_orderstatus || ' गीत' end as form from orders)
select o_orderkey, trim(split_part(inside, '-', 1)) as raag, trim(replace(substr(inside, instr(inside, '-') + 1), 'ताल', '')) as taal, form from h""")
def heading_music(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as raags (their own hyphen is the first dash), with or without a dash before the beat; some with a form."""
    beat = F.expr("case o_orderkey % 4 when 0 then o_orderstatus when 1 then 'ताल ' || o_orderstatus else o_orderstatus || ' ताल' end")
    sep = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(" — ")
    raag = F.concat(F.lit("(राग "), F.col("o_orderpriority"), sep, beat, F.lit(")"))
    form = F.concat(F.lit("("), F.col("o_orderstatus"), F.lit(" गीत)"))
    d = table(spark, sf_dir, "orders").withColumn("headings", F.when(F.col("o_orderkey") % 5 == 0, F.array(form, raag)).otherwise(F.array(F.col("o_orderstatus"), raag)))
    return d.select("o_orderkey", *[v.alias(k) for k, v in A.music(F.col("headings")).items()])


@query("""select p_partkey, case when p_partkey % 3 = 0 then p_type when p_partkey % 3 = 1 then p_brand else p_name end as title from part""")
def entry_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading without parentheses, else the first verse, else the old title."""
    third = F.col("p_partkey") % 3
    headings = F.when(third == 0, F.array(F.concat(F.lit("("), F.col("p_brand"), F.lit(")")), F.col("p_type"))).otherwise(F.array(F.concat(F.lit("("), F.col("p_type"), F.lit(")"))))
    verses = F.when(third == 1, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", A.title_of(headings, verses, F.col("p_name")).alias("title"))


@query(f"""with t as (select l_orderkey, place, l_shipmode || case when l_returnflag = 'R' then '-' else '' end as text, row_number() over (partition by l_orderkey order by place) - 1 as i from {PLACED_SQL}),
g as (select *, case when l_orderkey % 20 <= 13 then i // 2 else i end as pair_no from t)
select l_orderkey, pair_no, case when count(*) = 2 and ends_with(min_by(text, i), '-') then min_by(text, i) || max_by(text, i) when count(*) = 2 then min_by(text, i) || ' ' || max_by(text, i) else min(text) end as text, string_agg(i, ' ' order by i) as source_lines from g group by 1, 2""")
def paired_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders two by two up to the thirteenth of twenty, else one by one."""
    d = _placed(spark, sf_dir).withColumn("text", F.concat("l_shipmode", F.when(F.col("l_returnflag") == "R", "-").otherwise("")))
    p = A.paired_lines(d, "l_orderkey", "place", "text", F.col("l_orderkey") % 20 <= 13)
    return p.withColumn("source_lines", F.array_join(F.col("source_lines").cast("array<string>"), " "))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as line from documents where text is not null)
select doc_id, line::int as line, (line // 3)::int as region_no, 'page ' || (doc_id % 10 + line // 3) as source_page from l""")
def located_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of three lines each, the last of what is left, over all lines of documents."""
    ln = lines(spark, sf_dir).select("doc_id", "line")
    region = F.floor(F.col("line") / 3).cast("int")
    regions = ln.groupBy("doc_id", region.alias("region_no")).agg(F.count("*").alias("n_lines"))
    regions = regions.withColumn("source_page", F.concat(F.lit("page "), (F.col("doc_id") % 10 + F.col("region_no")).cast("string")))
    return A.located_blocks(ln, regions, "doc_id", "line").select("doc_id", "line", "region_no", "source_page")


#: Order lines that end stanzas: dandas alone, starred or numbered, and such as don't end one.
DANDA_TEXT = "l_shipmode || case cast(l_quantity as bigint) % 6 when 0 then '॥' when 1 then '॥*' when 2 then '॥१२' when 3 then '।' when 4 then '॥ ' else '' end"


@query(f"""with t as (select l_orderkey, place, cast(l_quantity as bigint) % 6 in (0, 1, 2) as ends from {PLACED_SQL})
select l_orderkey, place, (coalesce(sum(ends::int) over (partition by l_orderkey order by place rows between unbounded preceding and 1 preceding), 0) + 1)::int as stanza from t""")
def danda_stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _placed(spark, sf_dir).withColumn("text", F.expr(DANDA_TEXT))
    return A.breaks_after(d, "l_orderkey", "place", A.ends_stanza(F.col("text"))).select("l_orderkey", "place", "stanza")


@query(f"""with t as (select l_orderkey, place, l_returnflag as f, l_orderkey % 2 = 0 as moved, l_suppkey % 3 + 1 as stanza, row_number() over (partition by l_orderkey, l_suppkey % 3 order by place desc) = 1 as last,
 row_number() over (partition by l_orderkey order by place desc) = 1 and l_orderkey % 3 = 0 as closes from {PLACED_SQL}),
n as (select *, translate(stanza::varchar, '0123456789', '०१२३४५६७८९') as digits from t)
select l_orderkey, place, case when moved then case when not last then f || case when f = 'A' then '॥' else '' end when stanza = 2 then case when f = 'A' then f || '*॥' || digits || '॥' else f || case when closes then '' else '*' end end when f = 'A' then f || '॥' || digits || '॥' else f end
 else case when not last then f || case when f = 'A' then '॥*' else '*' end when f = 'A' then f || '॥' || digits || '॥' || case when closes then '' else '*' end else f || case when closes then '' else '*' end end
 end as text from (select * replace (case when not moved and closes and not last then false else closes end as closes) from n)""")
def star_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starred lines: in even orders, the star moves before the end of the second stanza; closing ones lose the last."""
    d = _placed(spark, sf_dir).withColumns({"text": F.expr("l_returnflag || case when l_returnflag = 'A' then '॥*' else '*' end"), "stanza": F.col("l_suppkey") % 3 + 1})
    after = F.when(F.col("l_orderkey") % 2 == 0, 2)
    return A.numbered(d, "l_orderkey", "place", "stanza", "text", after, F.col("l_orderkey") % 3 == 0).select("l_orderkey", "place", "text")


@query(f"""with t as (select l_orderkey, place, l_shipmode || case when l_suppkey % 2 = 0 then '*' else '' end as text, l_suppkey % 2 = 0 as star, o_custkey % 2 = 0 as one, o_custkey % 3 = 0 as special from {PLACED_SQL} join orders on o_orderkey = l_orderkey),
k as (select *, count(*) filter (star) over w as stars, case when special then min(case when star and contains(text, 'AIR') then place end) over w else max(case when star then place end) over w end as keep from t window w as (partition by l_orderkey))
select l_orderkey, place, case when not one or stars < 2 or place is not distinct from keep then text else replace(text, '*', '') end as text from k""")
def one_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even customers have one note; of every third customer, the star stays with a word."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    d = _placed(spark, sf_dir).withColumn("text", F.expr("l_shipmode || case when l_suppkey % 2 = 0 then '*' else '' end")).join(o, "l_orderkey")
    return A.last_star_only(d, "l_orderkey", "place", "text", F.col("o_custkey") % 2 == 0, F.when(F.col("o_custkey") % 3 == 0, "AIR")).select("l_orderkey", "place", "text")


@query("""select s_suppkey, s_name, case when s_suppkey % 4 = 0 then s_nationkey * 2.0 else s_nationkey * 1.0 end::double as box, case when s_suppkey % 4 = 0 then 'moved' end as box_reason from supplier""")
def box_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("double").alias("box"))
    o = s.filter("s_suppkey % 4 = 0").select("s_suppkey", "s_name", (F.col("box") * 2).alias("box"), F.lit("moved").alias("reason"))
    return A.boxes_overridden(s, o, ["s_suppkey"], "box", "s_name")


@query(f"""with l as (select l_orderkey as id, place, l_shipmode as text, row_number() over (partition by l_orderkey, l_shipmode order by place) as r from {PLACED_SQL}),
s as (select o_orderkey as id, page, y, text, row_number() over (partition by o_orderkey, text order by page, y) as r from orders join (select p_partkey as page, p_size::double as y, ['AIR', 'RAIL', 'SHIP'][1 + p_partkey % 3] as text from part) on page between o_custkey and o_custkey + 2 and (o_custkey < page or 10 <= y) and (o_custkey + 2 > page or y < 40))
select l.id, place, 'line' as kind from l where not exists (select 1 from s where s.id = l.id and s.text = l.text and s.r = l.r)
union all select s.id, page, 'missed' from s where not exists (select 1 from l where s.id = l.id and s.text = l.text and s.r = l.r)""")
def notes_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note lines (a part on each page) taken out of the orders whose three pages hold them."""
    li = _placed(spark, sf_dir).select(F.col("l_orderkey").alias("id"), "place", F.col("l_shipmode").alias("text"))
    word = F.get(F.array(*map(F.lit, ("AIR", "RAIL", "SHIP"))), (F.col("p_partkey") % 3).cast("int"))
    spans = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("page"), F.col("p_size").cast("double").alias("y"), word.alias("text"))
    first = F.col("o_custkey").cast("long")
    pads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), first.alias("start_page"), F.lit(10.0).alias("start_y"), (first + 2).alias("end_page"), F.lit(40.0).alias("end_y"))
    kept, missed = N.interval_removal(li, spans, pads, "place")
    return kept.select("id", "place", F.lit("line").alias("kind")).unionByName(missed.select("id", F.col("page").alias("place"), F.lit("missed").alias("kind")))


@query(f"""with t as (select l_orderkey, place, l_suppkey as page, case l_returnflag when 'R' then '०' || translate(l_linenumber::varchar, '0123456789', '०१२३४५६७८९') || '. ' || l_shipmode when 'A' then l_linenumber || '-' || l_shipmode else l_shipmode end as text from {PLACED_SQL}),
g as (select l_orderkey, min_by(text, place) as first, list_sort(list_distinct(list(page))) as pages, string_agg(text, '|' order by place) as lines from t group by 1)
select l_orderkey, case when pages = [7] then 'note' when regexp_matches(translate(first, '०१२३४५६७८९', '0123456789'), '^[0-9]+[.-]') then (regexp_extract(translate(first, '०१२३४५६७८९', '0123456789'), '^([0-9]+)', 1)::int)::varchar else '*' end as marker, lines, array_to_string(pages, ' ') as pages, s_nationkey::bigint as target from g left join supplier on s_suppkey = pages[1] and s_suppkey % 2 = 0""")
def note_group_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as notes on their supplier's page: marker, lines, pages and targets."""
    text = F.expr("case l_returnflag when 'R' then '०' || translate(cast(l_linenumber as string), '0123456789', '०१२३४५६७८९') || '. ' || l_shipmode when 'A' then l_linenumber || '-' || l_shipmode else l_shipmode end")
    d = _placed(spark, sf_dir).withColumns({"text": text, "page": F.col("l_suppkey").cast("long")})
    targets = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("long").alias("page"), F.array(F.col("s_nationkey").cast("long")).alias("target_ids"))
    g = N.group_summaries(d, ["l_orderkey"], "place", "text", "page", targets, {7: "note"})
    return g.select("l_orderkey", "marker", F.array_join("lines", "|").alias("lines"), F.array_join(F.col("pages").cast("array<string>"), " ").alias("pages"), F.get("target_ids", F.lit(0)).alias("target"))


@query(f"""with r as (select *, row_number() over (partition by l_shipmode, l_returnflag order by place, l_orderkey) as x from {PLACED_SQL}),
a as (select l_shipmode, l_returnflag, count(*) filter (l_linenumber % 2 = 1) as c, count(*) filter (l_linenumber % 2 = 0) as p from {PLACED_SQL} group by 1, 2)
select (select count(*) from orders) as n_pads, (select count(*) from supplier) as n_notes, coalesce(sum(c) filter (c = p), 0)::bigint as n_matched, coalesce(sum(c) filter (p = 0), 0)::bigint as n_unmatched, coalesce(sum(c) filter (p > 0 and p <> c), 0)::bigint as n_ambiguous from a""")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _placed(spark, sf_dir).select("l_shipmode", "l_returnflag", "l_linenumber", "place")
    m = N.matched_occurrences(d.filter("l_linenumber % 2 = 1"), d.filter("l_linenumber % 2 = 0").select(*[F.col(c).alias(c) for c in d.columns]), ["l_shipmode", "l_returnflag"], "place")
    return N.audit_totals(table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier"), m)


@query("""select l_orderkey, bool_or(l_quantity * 2 < 65) as doubtful from lineitem group by 1""")
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a word below 65: quantities stand for halves of confidence."""
    words = F.collect_list(F.struct((F.col("l_quantity") * 2).alias("conf")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(words.alias("words")).select("l_orderkey", G.low_confidence(F.col("words")).alias("doubtful"))


@query(f"""with b as (select l_orderkey, (l_partkey * 7 % 1000)::double as x0, l_quantity::double as y0, ' ' || l_shipmode || ' ' as t from {PLACED_SQL}),
f as (select *, x0 + 40 as x1, y0 + 10 as y1, trim(t) as w from b),
n as (select *, row_number() over (partition by l_orderkey order by x0, x1, w) as n from f),
g as (select *, round(x0 - lag(x1) over (partition by l_orderkey order by n), 3) as gap from n)
select l_orderkey, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, coalesce(string_agg(gap::int, ' ' order by n), '') as gaps, string_agg(w, ' ' order by n) as text from g group by 1""")
def fragment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fragments of one printed row."""
    x, y = (F.col("l_partkey") * 7 % 1000).cast("double"), F.col("l_quantity").cast("double")
    d = _placed(spark, sf_dir).select("l_orderkey", x.alias("x0"), (x + 40).alias("x1"), y.alias("y0"), (y + 10).alias("y1"), F.concat(F.lit(" "), "l_shipmode", F.lit(" ")).alias("text"))
    r = G.fragment_rows(d, ["l_orderkey"], "text")
    return r.withColumn("gaps", F.array_join(F.transform("gaps", lambda g: g.cast("int").cast("string")), " "))


@query("""select c_custkey, round(c_nationkey * 288.0 / (100 + c_custkey % 400), 6)::double as x, round(c_custkey * 288.0 / (100 + c_custkey % 400), 6)::double as "fontSize", c_nationkey::bigint as other from customer""")
def common_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), F.col("c_custkey").cast("double").alias("fontSize"), F.col("c_nationkey").cast("long").alias("other"), (100 + F.col("c_custkey") % 400).alias("page_width"))
    return G.at_common_width(d, "page_width").select("c_custkey", F.round("x", 6).alias("x"), F.round("fontSize", 6).alias("fontSize"), "other")


@query("""select c_custkey, round(least(300.0 / (10 + c_custkey), 200.0 / (5 + c_nationkey)), 6)::double as factor from customer""")
def aspect_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer")
    return d.select("c_custkey", F.round(G.fit(10 + F.col("c_custkey"), 5 + F.col("c_nationkey"), F.lit(300.0), F.lit(200.0)), 6).alias("factor"))


@query("""select doc_id from documents where text is not null and doc_id % 7 = 0 and contains(text, chr(10))
union all select -doc_id - 1 from documents where doc_id % 11 = 3 and doc_id % 7 = 1""")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose stanzas were turned round, and references with another marker than their note."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    verses = F.split("text", "\n")
    stanzas = F.transform(F.when(F.col("doc_id") % 7 == 0, F.transform(verses, lambda v, i: F.when(i == 0, F.concat(v, F.lit("!"))).otherwise(v))).otherwise(verses), lambda v: F.array(v))
    pads = d.filter(F.contains("text", F.lit("\n"))).select("doc_id", verses.alias("verses"), stanzas.alias("stanzas"))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner_id"), F.lit(0).alias("note_index"))
    notes = ids.withColumn("marker", F.lit("*"))
    refs = ids.filter("owner_id % 7 = 1").withColumns({"id": -F.col("owner_id") - 1, "marker": F.when(F.col("owner_id") % 11 == 3, "1").otherwise("*")})
    return C.unlike_stanzas(pads).select("doc_id").unionByName(C.unlike_markers(refs, notes).select(F.col("id").alias("doc_id")))


@query("""select p_partkey, 'q''राधा ‘श्याम'' ' || replace(p_name, ' ', ' ‘क ') as text from part""")
def opening_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that open a word of the script, and such as don't, around the names of parts."""
    text = F.concat(F.lit("q'राधा 'श्याम' "), F.replace("p_name", F.lit(" "), F.lit(" 'क ")))
    return table(spark, sf_dir, "part").select("p_partkey", T.opening_quotes(text).alias("text"))


@query("""select o_orderkey, o_orderkey % 4 in (0, 1, 2) as citation, o_orderkey % 4 = 3 as musical from orders""")
def label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations and musical labels, made of order numbers."""
    n = F.col("o_orderkey").cast("string")
    c = F.concat(F.lit("("), n, F.lit("। "), F.col("o_orderstatus"), F.lit(")"))
    label = F.expr("case o_orderkey % 4 when 0 then '  (गीता ' || o_orderkey || ')' when 1 then null when 2 then '(कवीन्द्र ' || o_orderstatus || ')' else '(राग ' || o_orderstatus || ')' end")
    text = F.coalesce(label, c)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.is_citation(text).alias("citation"), T.is_musical_label(text).alias("musical"))


@query("""select p_partkey, 'कि ' || p_brand || ' क्ति ’' as text from part""")
def glyph_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typing order around the brands of parts: a mark before its letter, and before a cluster; stray glyphs; blanks."""
    text = F.concat(F.lit("çक  "), "p_brand", F.lit(" \t çक्तï Ó"))
    return table(spark, sf_dir, "part").select("p_partkey", T.glyph_order(text).alias("text"))


@query("""select n_nationkey, n_name || chr(10) || chr(10) || 'https://pads.example.org/' || case when n_regionkey = 0 then 'rkk' else case when n_regionkey = 1 then 'main' else n_regionkey::varchar end || '/' || n_nationkey end || chr(10) || chr(10) || 'Download App:' || chr(10) || 'iOS - https://pads.example.org/ios' || chr(10) || 'Android - https://pads.example.org/android' as text from nation""")
def shared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as entries of their region's collection, as they are copied with link and footer."""
    mode = F.when(F.col("n_regionkey") == 0, "single").otherwise(F.col("n_regionkey").cast("string"))
    path = R.route_path(mode, F.col("n_nationkey"), {"single": "rkk", "1": "main"}, ("single",))
    footer = R.share_footer("https://pads.example.org", path, {"iOS": "/ios", "Android": "/android"})
    return table(spark, sf_dir, "nation").select("n_nationkey", R.copied_text(F.col("n_name"), footer).alias("text"))


@query(f"""with f as ({search_sql(_first_words_sql(2), 'select query_id, mode, count(*) as n from ranked group by all')})
select query_id, mode, n, row_number() over (partition by query_id order by mode <> case when query_id % 2 = 0 then 'fr' else 'en' end, mode)::int as group_pos from f""")
def current_group_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result counts by collection, the current one first."""
    n = S.counts(_found(spark, sf_dir, first_words(spark, sf_dir, 2), scored=False)).filter("mode is not null").withColumn("n", F.col("n").cast("long"))
    return R.current_first(n, "mode", "mode", F.when(F.col("query_id") % 2 == 0, "fr").otherwise("en"))


@query(search_sql(_first_words_sql(2), "select r.query_id, r.mode, r.id, score, rank2::int as rank from (select *, row_number() over (partition by query_id, mode order by score desc, id) as rank2 from ranked join (select lang as m, doc_id as i, source as section from documents) on m = mode and i = id where (query_id % 3 <> 0 or mode = 'de') and (query_id % 2 <> 0 or section = 'src0')) r where rank2 <= 20"))
def search_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third query in one collection, every second in one section."""
    q = first_words(spark, sf_dir, 2).withColumns({"scope": F.when(F.col("query_id") % 3 == 0, "de"), "section": F.when(F.col("query_id") % 2 == 0, "src0")})
    return S.top(_found(spark, sf_dir, q)).select("query_id", "mode", "id", "score", "rank")


@query("""select o_orderkey, row_number() over (order by o_orderstatus, o_custkey, o_orderkey)::int as pos from orders""")
def numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks like F:12 in the order of their numbers, not of their digits, numbered through in ranges."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit(":"), F.col("o_custkey").cast("string")).alias("key"))
    name, number, whole = sections.numeric_order("key")
    d = numbered(d.withColumns({"_name": name, "_number": number, "_whole": whole}), ["_name", "_number", "_whole", "o_orderkey"], "pos")
    return d.select("o_orderkey", F.col("pos").cast("int"))


@query("""select min(o_orderkey) as o_orderkey from orders where o_orderstatus = 'O' and o_orderkey > 100""")
def next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("verified").alias("status"))
    return streaming.next_pending(state, "o_orderkey", 100)


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'b' else 'a b k' || c_custkey end as keys from customer""")
def bookmark_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bookmark that is there goes; another comes at the end."""
    key = F.when(F.col("c_custkey") % 2 == 0, "a").otherwise(F.concat(F.lit("k"), F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(R.toggled(F.array(F.lit("a"), F.lit("b")), key), " ").alias("keys"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then '{}' else '{"x":' || c_nationkey || ',"zoom":' || c_custkey || '}' end as viewport, true as stamped from customer""")
def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewports as JSON, with the time of writing (whether it is there, as it differs between runs)."""
    view = F.when(F.col("c_custkey") % 3 != 0, F.struct(F.col("c_nationkey").alias("x"), F.col("c_custkey").alias("zoom")))
    d = streaming.stamped(table(spark, sf_dir, "customer").select("c_custkey", view.alias("viewport")))
    return d.select("c_custkey", "viewport", F.col("updated").isNotNull().alias("stamped"))


@query("""select p_partkey, replace(p_brand, '#', '~') as first, replace(p_type, ' ', '_') as second from part""")
def segments_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of a whole line that keeps its length, cut into its segments again."""
    got = D.replaced_across(F.array("p_brand", "p_type"), lambda line: F.translate(line, "# ", "~_"))
    return table(spark, sf_dir, "part").select("p_partkey", F.get(got, F.lit(0)).alias("first"), F.get(got, F.lit(1)).alias("second"))


@query("""select 's' as mode, s_suppkey as id, '/s/' || s_suppkey as route, '#' || s_suppkey as display_number, 288 as width from supplier
union all select 'n', n_nationkey, '/n', translate(n_nationkey::varchar, '0123456789', '०१२३४५६७८९'), 100 from nation""")
def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections with their own pages, routes and numbers, as one table of entries."""
    s = D.Collection("s", lambda: table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), lambda d: d.withColumn("width", F.lit(288)), lambda i: R.route_path(F.lit("s"), i, {}), lambda d: F.concat(F.lit("#"), F.col("id").cast("string")))
    n = D.Collection("n", lambda: table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), lambda d: d.withColumn("width", F.lit(100)), lambda i: R.route_path(F.lit("n"), i, {}, ("n",)), lambda d: T.devanagari_number(F.col("id")))
    return D.Collections(s, n).entries().select("mode", "id", "route", "display_number", "width")


#: Part names in three printed fragments, cut after the third letter and after two letters of the second word.
FRAGMENTS = """with w as (select p_partkey, p_size, p_name, length(split_part(p_name, ' ', 1)) as n from part),
f as (select *, p_partkey % 2 + 0.0 as y1, p_partkey % 3 + 0.0 as y2, p_partkey % 5 + 0.0 as y3 from w)"""


@query(FRAGMENTS + """
select p_partkey, case when p_partkey % 7 = 0 then p_name when n = 3 then 'red ' || '|' || substring(p_name || '!', 5) else p_name || '!' end as texts,
  case when p_partkey % 7 = 0 then null when n = 3 then 10.0 else 10.0 end as left_edge, case when p_partkey % 7 = 0 then null when n = 3 then y1 else least(y1, y2, y3) end as first_top,
  case when p_partkey % 7 = 0 then null else greatest(y2, y3, case when n = 3 then 0.0 else y1 end) + p_size end as last_bottom, case when p_partkey % 7 = 0 then null else 39.0 end as right_edge from f""".replace("'red ' || '|'", "substring(p_name, 1, 4) || '|'"))
def segments_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that begin within a word are merged with what stands before; every seventh has other letters. Names end in
    an exclamation mark where they are shown."""
    n = F.length(F.split_part("p_name", F.lit(" "), F.lit(1)))
    cut = n + 3  # a blank and two letters of the second word
    text = lambda k: [F.substring("p_name", F.lit(1), F.lit(3)), F.substring(F.col("p_name"), F.lit(4), cut - 3), F.substring(F.col("p_name"), cut + 1, F.length("p_name"))][k]
    top = lambda k: (F.col("p_partkey") % (2, 3, 5)[k]).cast("double")
    fragment = lambda k: F.struct(text(k).alias("text"), F.lit(10.0 * (k + 1)).alias("x0"), top(k).alias("y0"), F.lit(10.0 * (k + 1) + 9).alias("x1"), (top(k) + F.col("p_size")).alias("y1"))
    d = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.array(*map(fragment, range(3))).alias("f"))
    d = d.withColumn("f", F.when(F.col("p_partkey") % 7 == 0, F.slice("f", 1, 2)).otherwise(F.col("f")))
    d = d.withColumn("shown", F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("!"))))
    d = D.merged_segments(d, "p_name", "f", "s", "shown")
    first, last = F.get("s", F.lit(0)), F.get(F.col("s"), F.size("s") - 1)
    return d.select("p_partkey", F.array_join(F.transform("s", lambda x: x["text"]), "|").alias("texts"), first["x0"].alias("left_edge"), first["y0"].alias("first_top"), last["y1"].alias("last_bottom"), last["x1"].alias("right_edge"))
