"""Queries of editing work: roles of rows, headings, stanzas, stars, cuts, source pages and coverage, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..functions import text as T
from ..operators import adapters as D
from ..operators import alignment as L
from ..operators import assembly as A
from ..operators import checks as C
from ..operators import geometry as G
from ..operators import notes as N
from .layout import PLACE, PLACED_SQL
from .tables import table

QUERIES: list = []
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with its SQL twin."""

    def take(f):
        QUERIES.append(f)
        ORACLES[f.__name__] = sql
        return f

    return take


#: Order lines as printed rows: what is returned is a marker, what is open has a number in parentheses.
ROW_TEXT = "case l_returnflag when 'R' then '[' || l_linenumber || ']' when 'A' then '(' || l_linenumber || ')' else l_returnflag || ' ' || l_linestatus end"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return li.withColumns({"place": F.expr(PLACE), "page": F.col("l_suppkey"), "y": F.col("l_quantity") * 10.0, "text": F.expr(ROW_TEXT)})


@query(f"""with r as (select l_orderkey, place, {ROW_TEXT} as text, l_quantity * 10.0 as y, l_quantity * 10.0 >= s_nationkey * 10 and l_quantity * 10.0 < s_nationkey * 10 + 50 as inside from {PLACED_SQL} left join supplier on s_suppkey = l_suppkey)
select l_orderkey, place, case when inside then 'excluded' when text like '[%' then 'marker' when text like '(%' and y < 140 then 'excluded' else 'body' end as role,
case when inside then 'section heading or decoration' when text like '(%' and y < 140 then 'printed page number' end as reason from r""")
def row_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines on their supplier's page, which has one zone."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), (F.col("s_nationkey") * 10.0).alias("y0"), (F.col("s_nationkey") * 10.0 + 50.0).alias("y1"))
    return D.row_roles(_rows(spark, sf_dir), "page", "y", "text", s).select("l_orderkey", "place", "role", "reason")


@query(f"""with r as (select l_orderkey, place, l_suppkey, l_quantity * 10.0 as y, min(case when l_returnflag = 'R' then l_quantity * 10.0 end) over (partition by l_suppkey) as first from {PLACED_SQL})
select l_orderkey, place, coalesce(y >= case when l_suppkey % 2 = 0 then 300.0 else first end, false) as is_note from r""")
def note_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes below the limit of even pages, and below the first marker of odd ones."""
    limits = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("page"), F.lit(300.0).alias("note_y"))
    return D.note_lines(_rows(spark, sf_dir), "page", "y", F.col("l_returnflag") == "R", limits).select("l_orderkey", "place", "is_note")


@query(f"""with r as (select l_orderkey, place, l_returnflag, l_suppkey % 2 = 0 as star, max(case when l_suppkey % 2 = 0 then place end) over (partition by l_orderkey) as last from {PLACED_SQL})
select l_orderkey, place, l_returnflag || case when star and place = last then '*' else '' end as text from r""")
def last_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _rows(spark, sf_dir).withColumn("text", F.expr("l_returnflag || case when l_suppkey % 2 = 0 then '*' else '' end"))
    return A.last_star_only(d, "l_orderkey", "place", "text").select("l_orderkey", "place", "text")


@query(f"""with r as (select l_orderkey, place, l_returnflag, l_suppkey % 3 + 1 as stanza, lead(place) over (partition by l_orderkey, l_suppkey % 3 order by place) is null as ends from {PLACED_SQL})
select l_orderkey, place, case when ends then l_returnflag || '॥' || translate(stanza::varchar, '0123456789', '०१२३४५६७८९') || '॥' else l_returnflag || '!' end as text from r""")
def stanza_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _rows(spark, sf_dir).withColumns({"text": F.expr("l_returnflag || '!'"), "stanza": F.col("l_suppkey") % 3 + 1})
    return D.numbered_stanzas(d, "l_orderkey", "place", "stanza", "text").select("l_orderkey", "place", "text")


@query("""select p_partkey, rtrim(substr(p_name, 1, instr(p_name, p_word) - 1)) as before_word, substr(p_name, instr(p_name, p_word)) as from_word
from (select p_partkey, p_brand || ' ' || p_type || ' ' || p_size as p_name, p_type as p_word from part)""")
def phrase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand, type and size of a part as a line, cut at the type."""
    cut = D.split_at(F.expr("p_brand || ' ' || p_type || ' ' || p_size"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", cut.alias("cut")).select("p_partkey", F.get("cut", F.lit(0)).alias("before_word"), F.get("cut", F.lit(1)).alias("from_word"))


@query("""with p as (select l_orderkey as id, l_suppkey as page from lineitem union select o_orderkey, o_custkey from orders union select r.o_orderkey, n.o_custkey from orders r join orders n on n.o_orderkey = r.o_orderkey - 1 and r.o_custkey % 2 = 0)
select id, string_agg(page, ' ' order by page) as pages from p group by 1""")
def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of an order: its lines' suppliers, its own note's, and the note's of the order before it."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("long").alias("page"))
    notes = o.select(F.col("o_orderkey").alias("owner_id"), F.lit(0).alias("note_index"), F.array(F.col("o_custkey").cast("long")).alias("source_pages"))
    refs = o.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") - 1).alias("owner_id"), F.lit(0).alias("note_index"))
    return D.source_pages(li, notes, refs).select("id", F.array_join(F.col("pages").cast("array<string>"), " ").alias("pages"))


@query("""select l_suppkey as page, count(*) as rows, count(*) filter (l_returnflag = 'R') as n_missing, count(*) filter (l_returnflag = 'R') > 2 as suspect from lineitem group by 1""")
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _rows(spark, sf_dir).withColumn("missing", F.col("l_returnflag") == "R")
    return L.coverage(d, "page", "place").select("page", "rows", F.size("missing_rows").cast("long").alias("n_missing"), "suspect")


@query("""select distinct o_custkey as id, 'extra' as side from orders where o_custkey not between 1 and 100
union all select n, 'missing' from (select unnest(range(1, 101)) as n) where n not in (select o_custkey from orders)""")
def ids_not_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders against the numbers from 1 to 100."""
    return C.not_covered(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id", 1, 100)


@query("""with w as (select distinct split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) as accepted, 'x' || split_part(text, ' ', 3) as rejected from benchmark)
select accepted, rejected, coalesce(bool_or(contains(text, accepted)), false) as has_accepted, coalesce(bool_or(contains(text, rejected)), false) as has_rejected from w left join documents on contains(text, accepted) or contains(text, rejected) group by 1, 2""")
def required_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each benchmark item as an accepted reading over all documents."""
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    terms = table(spark, sf_dir, "benchmark").select(F.concat_ws(" ", word(1), word(2)).alias("accepted"), F.concat(F.lit("x"), word(3)).alias("rejected"))
    return C.required_terms(table(spark, sf_dir, "documents"), "text", terms)


@query("""select l_orderkey, least(1.0, 30.0 / max(l_quantity))::double as scale from lineitem group by 1""")
def text_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scale for each order, so that its widest line fits."""
    return G.text_scale(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", 30.0)


@query(f"""with b as (select l_orderkey, place, (l_partkey % 500)::double as x0, l_partkey % 500 + 40.0 as x1 from {PLACED_SQL}),
w as (select *, min(x0) over (partition by l_orderkey) as l, max(x1) over (partition by l_orderkey) as r from b)
select l_orderkey, place, (x1 - x0) / greatest(r - l, 1) < 0.8 and abs((x0 + x1) / 2 - (l + r) / 2) / greatest(r - l, 1) < 0.045 as centred from w""")
def centred_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _rows(spark, sf_dir).select("l_orderkey", "place", (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_partkey") % 500 + 40.0).alias("x1"), F.lit(1).alias("page"))
    return G.placement(d, G.page_bounds(d, "l_orderkey", "page"), ["l_orderkey"]).select("l_orderkey", "place", "centred")


@query(f"""select l_orderkey as request_id, place, case when l_linestatus = 'F' then 1.0 else least(0.99, l_quantity / 40) end::double as progress from {PLACED_SQL} join orders on o_orderkey = l_orderkey where o_custkey % 2 = 0""")
def download_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as progress events of the orders that are active: the batch twin of the progress stream."""
    e = _rows(spark, sf_dir).select(F.col("l_orderkey").alias("request_id"), "place", F.col("l_quantity").alias("bytes"), F.lit(40).alias("total"), (F.col("l_linestatus") == "F").alias("complete"))
    active = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("request_id"))
    return streaming.progress(e, active).select("request_id", "place", F.col("progress").cast("double").alias("progress"))


@query("""with r as (select o_custkey % 50 + 1 as owner_id, (o_orderkey % 3)::int as note_index, o_orderkey as id from orders)
select owner_id, note_index, string_agg(id, ' ' order by id) as ids from r group by 1, 2""")
def notes_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50 + 1).alias("owner_id"), (F.col("o_orderkey") % 3).cast("int").alias("note_index"), F.col("o_orderkey").alias("id"))
    return N.shared_with(o).select("owner_id", "note_index", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("""select o_orderkey, translate(o_orderkey::varchar, '0123456789', '०१२३४५६७८९') as number from orders""")
def devanagari_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.devanagari_number(F.col("o_orderkey")).alias("number"))
