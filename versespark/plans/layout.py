"""Queries of page geometry and of matching recognised lines, with SQL twins. Order lines stand for words on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as L
from ..operators import geometry as G
from ..sources.staging import staged
from .tables import lines, table

QUERIES: list = []
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES.append(f)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


#: Order lines in an order without ties; line numbers alone repeat within an order.
PLACE = "((l_linenumber * 100000 + l_partkey) * 100000 + l_suppkey) * 100 + cast(l_quantity as bigint)"
PLACED_SQL = f"(select *, {PLACE} as place from lineitem)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long")).withColumn("place", F.expr(PLACE))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as boxes: quantity is the top and the part number the left edge."""
    return _placed(spark, sf_dir).select("l_orderkey", "l_linenumber", "place", F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_partkey") % 500 + 40.0).alias("x1"), F.col("l_quantity").alias("y0"), (F.col("l_quantity") + 10.0).alias("y1"), F.col("l_returnflag").alias("text"))


@query("""select l_orderkey, min(l_partkey) as x0, min(l_suppkey) as y0, max(l_partkey + l_linenumber) as x1, max(l_suppkey + 2) as y1, string_agg(l_returnflag, ' ' order by place) as text, round_even(avg(l_linenumber), 1) as confidence from """ + PLACED_SQL + """ group by 1""")
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _placed(spark, sf_dir).select("l_orderkey", "place", F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("top"), F.col("l_linenumber").alias("width"), F.lit(2).alias("height"), F.col("l_linenumber").alias("conf"), F.col("l_returnflag").alias("text"))
    return G.line_boxes(w, ["l_orderkey"], "place")


@query("""with b as (select l_orderkey, l_suppkey % 3 as page, min(l_partkey % 500)::double as left, max(l_partkey % 500 + 40.0)::double as right from lineitem group by 1, 2)
select l_orderkey, page, "left", "right", greatest(1.0, max("right" - "left") over (partition by l_orderkey))::double as widest from b""")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _boxes(spark, sf_dir).withColumn("page", F.col("page") % 3)
    return G.page_bounds(d, "l_orderkey", "page")


@query("""with g as (select l_orderkey, l_quantity - lag(l_quantity) over w as gap, l_suppkey % 2 = lag(l_suppkey % 2) over w as same from """ + PLACED_SQL + """ window w as (partition by l_orderkey order by place)),
s as (select l_orderkey, list_sort(list(gap) filter (same and gap > 0)) as v from g group by 1)
select l_orderkey, coalesce(v[len(v) // 2 + 1], 28.0)::double as median_gap from s""")
def upper_median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _boxes(spark, sf_dir).withColumn("page", F.col("page") % 2)
    g = G.gaps(d, "l_orderkey", "page", "place", "y0")
    return g.groupBy("l_orderkey").agg(G.upper_median("gap", 28.0).alias("median_gap"))


@query("""with s as (select l_orderkey, place, row_number() over w as r, l_suppkey % 2 = lag(l_suppkey % 2) over w as same, l_quantity - lag(l_quantity) over w as gap, l_returnflag != lag(l_returnflag) over w as role, l_linestatus != lag(l_linestatus) over w as stanza from """ + PLACED_SQL + """ window w as (partition by l_orderkey order by place)),
t as (select *, case when r = 1 then 0.0 else case when same then greatest(gap, 12.0) else 20.0 end + case when role then 8.0 when stanza then 5.0 else 0.0 end end as step from s)
select l_orderkey, place, round(sum(step::double) over (partition by l_orderkey order by place rows unbounded preceding), 3) as y from t""")
def cumulative_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _placed(spark, sf_dir).withColumn("page", F.col("l_suppkey") % 2)
    d = G.layout_steps(li, "l_orderkey", "page", "place", "l_quantity", "l_returnflag", "l_linestatus", 20.0, 12.0, 5.0, 8.0)
    return G.running_y(d, "l_orderkey", "place", F.col("step")).select("l_orderkey", "place", F.round("y", 3).alias("y"))


@query("""select l_orderkey, place from (select *, lag(l_quantity) over (partition by l_orderkey order by place) as before from """ + PLACED_SQL + """) where l_quantity <= before""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.out_of_order(_boxes(spark, sf_dir), "l_orderkey", "place", "y0").select("l_orderkey", "place")


#: What order lines say as recognised text: cases, hyphens and blanks that comparing leaves out.
SAID = "case l_linenumber % 2 when 1 then upper(l_returnflag) || '-' || (l_partkey % 3) else lower(l_returnflag) || ' ' || (l_partkey % 3) || '.' end"


@query(f"""with a as (select distinct l_orderkey, place, l_quantity, {SAID} as said from {PLACED_SQL} where l_linenumber % 2 = 1), b as (select l_orderkey, place, l_quantity, {SAID} as said from {PLACED_SQL} where l_linenumber % 2 = 0),
o as (select a.l_orderkey, a.place, a.said, coalesce(string_agg(b.said, ' ' order by b.place, b.said), '') as alternate from a left join b on a.l_orderkey = b.l_orderkey and least(a.l_quantity, b.l_quantity) + 10 - greatest(a.l_quantity, b.l_quantity) > 0 group by a.l_orderkey, a.place, a.l_quantity, a.said)
select l_orderkey, place, alternate, lower(replace(said, '-', '')) = replace(replace(alternate, ' ', ''), '.', '') as agrees from o""")
def overlap_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd order lines against even ones of the same order, as two passes over a page."""
    d = _boxes(spark, sf_dir).drop("text").join(_placed(spark, sf_dir).select("l_orderkey", "place", F.expr(SAID).alias("text")).distinct(), ["l_orderkey", "place"])
    b = d.filter("l_linenumber % 2 = 0").select(*[F.col(c).alias(c) for c in d.columns])
    a = d.filter("l_linenumber % 2 = 1").select("l_orderkey", "place", "y0", "y1", "text").distinct()
    return L.overlapping(a, b, ["l_orderkey"], "place", "text").select("l_orderkey", "place", "alternate", "agrees")


@query("""with s as (select * from lineitem where l_linenumber % 2 = 1), b as (select * from lineitem where l_linenumber % 2 = 0),
h as (select s.l_orderkey, s.l_linenumber, b.l_linenumber as body_key from s join b on s.l_orderkey = b.l_orderkey and b.l_quantity - s.l_quantity > 0.7 and b.l_quantity - s.l_quantity <= 6.5 and b.l_partkey % 500 - 10 <= s.l_partkey % 500 and b.l_partkey % 500 + 400 + 10 >= s.l_partkey % 500 + 40)
select l_orderkey, l_linenumber, any_value(body_key) as body_key from h group by 1, 2 having count(*) = 1""")
def unique_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _boxes(spark, sf_dir).withColumnRenamed("y0", "baseline").select("l_orderkey", "l_linenumber", "baseline", "x0", "x1")
    b = d.filter("l_linenumber % 2 = 0").select("l_orderkey", "l_linenumber", "baseline", "x0", (F.col("x0") + 400.0).alias("x1"), F.lit(16.0).alias("font"))
    return L.unique_lower(d.filter("l_linenumber % 2 = 1"), b, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "body_key")


@query("""select l.l_orderkey, l.l_linenumber, r.s_suppkey from lineitem l join supplier r on l.l_suppkey = r.s_suppkey where l.l_quantity >= r.s_nationkey and l.l_quantity - 5 < r.s_nationkey + 10 - 0.01 and l.l_partkey % 500 + 40 > 100 and l.l_partkey % 500 < 300""")
def region_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in a region of their supplier's page."""
    d = _boxes(spark, sf_dir).withColumns({"baseline": F.col("y0"), "top": F.col("y0") - 5})
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_suppkey"), F.lit(100.0).alias("rx0"), F.lit(300.0).alias("rx1"), F.col("s_nationkey").cast("double").alias("ry0"), (F.col("s_nationkey") + 10.0).alias("ry1"))
    return L.in_region(d, r, "page").select("l_orderkey", "l_linenumber", "s_suppkey")


@query(f"""with recursive r as materialized (select l_suppkey as page, l_orderkey, place, l_quantity as y, row_number() over (partition by l_suppkey order by l_quantity, l_orderkey, place) as n from {PLACED_SQL}),
c as (select page, l_orderkey, place, y, n, y as anchor, 1 as row_no from r where n = 1
 union all select r.page, r.l_orderkey, r.place, r.y, r.n, case when abs(anchor - r.y) > 5 then r.y else anchor end, row_no + case when abs(anchor - r.y) > 5 then 1 else 0 end from c join r on r.page = c.page and r.n = c.n + 1)
select page, l_orderkey, place, y, row_no from c""")
def anchor_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _boxes(spark, sf_dir).select("page", "l_orderkey", "place", F.col("y0").alias("y"))
    return L.anchored_rows(d, "page", "y", "l_orderkey", 5.0)


#: What order lines say, some in brackets, which stay alone.
BRACKETED = "case when l_returnflag = 'R' and l_linestatus = 'F' then '[R]' else l_returnflag end"


@query(f"""with recursive r as materialized (select l_suppkey as page, lpad(l_orderkey::varchar, 12, '0') || ' ' || lpad(place::varchar, 24, '0') as "order", (l_partkey % 500)::double as x0, l_quantity as y0, (l_partkey % 500 + 40.0)::double as x1, l_quantity + 10.0 as y1, {BRACKETED} as text, row_number() over (partition by l_suppkey order by l_orderkey, place) as n from {PLACED_SQL}),
a as materialized (select *, length(text) < 18 and (contains(text, '[') or contains(text, ']')) as alone, y1 - y0 as h from r),
c as (select *, [{{'k': 0, 'y0': y0, 'y1': y1, 'alone': alone}}] as last, 1 as lines, 0 as line_no from a where n = 1
 union all select page, "order", x0, y0, x1, y1, text, n, alone, h, case when hit is null then list_append(last, {{'k': lines, 'y0': y0, 'y1': y1, 'alone': alone}})[-4:] else list_transform(last, lambda o: case when o.k = hit then {{'k': o.k, 'y0': least(o.y0, y0), 'y1': greatest(o.y1, y1), 'alone': o.alone}} else o end) end,
  lines + (hit is null)::int, coalesce(hit, lines) from (
   select a.*, c.last, c.lines, list_reverse(list_filter(c.last, lambda o: not a.alone and not o.alone and greatest(o.y1 - o.y0, a.h) < 2 * least(o.y1 - o.y0, a.h) and least(o.y1, a.y1) - greatest(o.y0, a.y0) > least(o.y1 - o.y0, a.h) / 2))[1].k as hit from c join a on a.page = c.page and a.n = c.n + 1))
select page, "order", x0, y0, x1, y1, text, line_no::int as line_no from c""")
def greedy_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _boxes(spark, sf_dir).drop("text").join(_placed(spark, sf_dir).select("l_orderkey", "place", F.expr(BRACKETED).alias("text")).distinct(), ["l_orderkey", "place"])
    d = d.withColumn("order", F.format_string("%012d %024d", "l_orderkey", "place")).select("page", "order", "x0", "y0", "x1", "y1", "text")
    return L.rejoined_rows(d, "page")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("doc_id"), F.col("line").cast("long").alias("line"), "text")


@query()
def best_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against every third line of the same document."""
    d = staged(L.normal_lines(_lines(spark, sf_dir), "doc_id"), "similar-lines")
    return L.best_similarity(d, d.filter("line % 3 = 0").select(*[F.col(c).alias(c) for c in d.columns]), "doc_id", "line", "text", normal=True).select("doc_id", "line", F.round("best", 6).alias("best"), "missing")


@query()
def monotone_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without every fourth, aligned with all of them."""
    d = staged(L.normal_lines(_lines(spark, sf_dir), "doc_id"), "align-lines")
    return L.aligned_rows(d.filter("line % 4 != 3").select(*[F.col(c).alias(c) for c in d.columns]), d, "doc_id", normal=True)
