"""Queries of corpus assembly: sections, notes, segments, edits, checks, routes and review states, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..functions import text as T
from ..operators import assembly as A
from ..operators import checks as C
from ..operators import notes as N
from ..operators import routes as R
from ..operators import sections as S
from .search import _normal_sql
from .tables import LINES_SQL, lines, table

QUERIES: list = []
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL twin."""

    def take(f):
        QUERIES.append(f)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def _part_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("k", F.floor(F.col("p_partkey") / 25))
    return p.groupBy("k").agg(F.min("p_partkey").alias("start_id"), F.max("p_partkey").alias("end_id")).withColumn("name", F.concat(F.lit("S"), F.col("k").cast("string"))).drop("k")


@query("""with s as (select 'S' || (p_partkey // 25)::varchar as name, min(p_partkey) as a, max(p_partkey) as b from part group by 1)
select p_partkey as id, name from part join s on p_partkey between a and b""")
def section_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.range_join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), _part_sections(spark, sf_dir)).select("id", "name")


@query("""with s as (select p_brand as parent, p_type as name, min(p_partkey) as a, max(p_partkey) as b from part group by 1, 2),
n as (select *, lead(a) over (partition by parent order by a, b) as next_start from s)
select parent, name, b as end_id, next_start, next_start - b - 1 as gap from n where next_start - b - 1 != 0""")
def section_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("parent"), F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("start_id"), F.max("p_partkey").alias("end_id"))
    return S.tiling_gaps(s, "parent")


@query("""select o_custkey, first(o_orderkey order by o_orderdate, o_orderkey) as first_shown, last(o_orderkey order by o_orderdate, o_orderkey) as last_shown from orders group by 1""")
def section_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("pos", F.struct("o_orderdate", "o_orderkey"))
    return S.bounds(o, "o_custkey", "pos", "o_orderkey")


@query("""select doc_id, source is distinct from lag(source) over (partition by lang order by doc_id) and source is not null as show_header from documents""")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.headers(table(spark, sf_dir, "documents"), "lang", "doc_id", "source").select("doc_id", "show_header")


@query("""select n_nationkey, coalesce(lag(n_name) over w, last_value(n_name) over e) as prev_key, coalesce(lead(n_name) over w, first_value(n_name) over e) as next_key from nation
window w as (partition by n_regionkey order by n_nationkey), e as (partition by n_regionkey order by n_nationkey rows between unbounded preceding and unbounded following)""")
def circular_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbours(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name").select("n_nationkey", "prev_key", "next_key")


@query("""select s.o_orderkey as span_id, arg_max(i.o_orderkey, (i.o_orderdate, i.o_orderkey)) as owner
from orders s join orders i on s.o_custkey = i.o_custkey and i.o_orderdate <= s.o_orderdate + interval 10 day group by 1""")
def interval_owner_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of the customer ten days after each order."""
    o = table(spark, sf_dir, "orders")
    spans = o.select("o_custkey", F.col("o_orderkey").alias("span_id"), (F.col("o_orderdate") + F.expr("interval 10 days")).alias("at"))
    return N.owner_asof(spans, o, "o_custkey", "at", "o_orderdate", "o_orderkey").select("span_id", "owner")


@query("""with f as (select s.o_orderkey as span_id, s.o_custkey, s.o_orderdate - interval 20 day as place, arg_max((i.o_orderkey, i.o_orderdate + interval 60 day), (i.o_orderdate, i.o_orderkey)) as last
  from orders s left join orders i on s.o_custkey = i.o_custkey and i.o_orderdate <= s.o_orderdate - interval 20 day group by all)
select span_id, case when o_custkey % 50 = 7 then o_custkey + 1000000 when last[2] >= place then last[1] end as owner from f""")
def interval_owner_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of the customer at least twenty days before each order, if it isn't over sixty days older than that;
    some customers' owners are given by hand."""
    o = table(spark, sf_dir, "orders").withColumn("ends", F.col("o_orderdate") + F.expr("interval 60 days"))
    spans = o.select("o_custkey", F.col("o_orderkey").alias("span_id"), (F.col("o_orderdate") - F.expr("interval 20 days")).alias("at"))
    manual = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 7").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") + 1000000).alias("o_orderkey"))
    return N.owner_asof(spans, o, "o_custkey", "at", "o_orderdate", "o_orderkey", "ends", manual).select("span_id", "owner")


@query("""with s as (select n_name as name, n_nationkey * 60 as start_id, n_nationkey * 60 + case when n_nationkey % 5 = 0 then 70 else 58 end as end_id, n_nationkey from nation),
u as (select n_name as parent, n_nationkey * 60 + k * 30 as start_id, n_nationkey * 60 + k * 30 + case when n_nationkey % 4 = 0 then 35 else 28 end as end_id from nation, (values (0), (1)) t(k) where n_nationkey % 3 = 0),
h as (select p_partkey as id, count(name) as n, min(name) as name from part left join s on p_partkey between start_id and end_id group by 1)
select id, 'section' as kind, n from h where n <> 1
union all select id, 'subsection', count(u.parent) as n from h left join u on u.parent = h.name and h.id between u.start_id and u.end_id where h.n = 1 and h.name in (select parent from u) group by id having count(u.parent) <> 1""")
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that lie in no nation's range or in several, or in a range with parts of its own, but not in exactly one of these."""
    n = table(spark, sf_dir, "nation")
    start = F.col("n_nationkey").cast("long") * 60
    main = n.select(F.col("n_name").alias("name"), start.alias("start_id"), (start + F.when(F.col("n_nationkey") % 5 == 0, 70).otherwise(58)).alias("end_id"), F.lit(None).cast("string").alias("parent"))
    halves = n.filter("n_nationkey % 3 = 0").select("n_name", "n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    begin = start + F.col("k") * 30
    sub = halves.select(F.concat("n_name", F.lit(" "), F.col("k").cast("string")).alias("name"), begin.alias("start_id"), (begin + F.when(F.col("n_nationkey") % 4 == 0, 35).otherwise(28)).alias("end_id"), F.col("n_name").alias("parent"))
    return S.coverage_violations(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), main.unionByName(sub))


@query(f"""with l as ({LINES_SQL}),
a as (select *, row_number() over (partition by doc_id, text order by line) as k, count(*) over (partition by doc_id, text) as n from l),
b as (select doc_id, text, line as physical, row_number() over (partition by doc_id, text order by line) as k, count(*) over (partition by doc_id, text) as found from l where line % 7 != 3),
f as (select distinct doc_id, text, found from b)
select a.doc_id, line, case when f.found is null then 'unmatched' when f.found = n then 'matched' else 'ambiguous' end as status, case when f.found = n then physical end as physical
from a left join f using (doc_id, text) left join b using (doc_id, text, k)""")
def occurrence_rank_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against the same lines without every seventh: repeated ones match only if none is missing."""
    a = lines(spark, sf_dir)
    return N.matched_occurrences(a, a.filter("line % 7 != 3").select(*[F.col(c).alias(c) for c in a.columns]), ["doc_id", "text"], "line").select("doc_id", "line", "status", "physical")


@query(f"""with l as ({LINES_SQL}),
a as (select *, row_number() over (partition by doc_id, text order by line) as k from l),
b as (select doc_id, text, row_number() over (partition by doc_id, text order by line) as k from l where line % 5 = 0)
select doc_id, line from a anti join b using (doc_id, text, k)""")
def multiset_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lines(spark, sf_dir)
    kept, _ = N.multiset_removal(a, a.filter("line % 5 = 0").select(*[F.col(c).alias(c) for c in a.columns]), ["doc_id", "text"], "line")
    return kept.select("doc_id", "line")


@query("""select conv_id, turn, sum((role = 'user')::int) over (partition by conv_id order by turn rows unbounded preceding)::bigint as segment from conversations""")
def marker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.marker_segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "segment")


@query(f"""with l as ({LINES_SQL}) select doc_id, line, (coalesce(sum((right(text, 1) = '.')::int) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) + 1)::int as stanza from l""")
def stanza_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end with a full stop end a stanza."""
    return A.breaks_after(lines(spark, sf_dir), "doc_id", "line", F.col("text").endswith(".")).select("doc_id", "line", "stanza")


@query(f"""with l as ({LINES_SQL}), c as (select doc_id, line // 3 as group_no, count(*) as n from l group by 1, 2),
u as (select *, sum(n) over (partition by doc_id order by group_no rows unbounded preceding) as upto from c),
i as (select *, row_number() over (partition by doc_id order by line) - 1 as i from l)
select i.doc_id, line, group_no from i join u on i.doc_id = u.doc_id and i >= upto - n and i < upto""")
def count_list_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lines(spark, sf_dir)
    counts = a.groupBy("doc_id", F.floor(F.col("line") / 3).alias("group_no")).agg(F.count("*").alias("n"))
    return A.regroup_by_counts(a, counts, "doc_id", "line").select("doc_id", "line", "group_no")


@query(f"""with l as ({LINES_SQL}), p as (select *, (row_number() over (partition by doc_id order by line) - 1) // 2 as pair_no from l),
g as (select doc_id, pair_no, first(text order by line) as a, case when count(*) > 1 then last(text order by line) end as b from p group by 1, 2)
select doc_id, pair_no, md5(a || case when b is null then '' else case when ends_with(a, '-') then '' else ' ' end || b end) as joined from g""")
def paired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paired_lines(lines(spark, sf_dir), "doc_id", "line", "text").select("doc_id", "pair_no", F.md5(F.col("text").cast("binary")).alias("joined"))


@query(f"""with l as ({LINES_SQL}) select doc_id, line, md5(case when doc_id % 10 = 0 and line = 0 then text || ' corrected' else text end) as text from l where not (doc_id % 10 = 1 and line = 1)""")
def corrections_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every tenth document is corrected, the second one of the next is deleted."""
    a = lines(spark, sf_dir)
    c = a.filter("(doc_id % 10 = 0 and line = 0) or (doc_id % 10 = 1 and line = 1)")
    c = c.select(F.col("doc_id").alias("doc_id"), F.col("line").alias("line"), F.col("text").alias("before"), F.when(F.col("line") == 0, F.concat("text", F.lit(" corrected"))).alias("after"))
    return A.corrected(a, c, ["doc_id", "line"], "text").select("doc_id", "line", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""select d.doc_id, case when quality = 1 then 'verified' else source end as source, case when quality = 1 then 'toxic ' || toxic else lang end as lang from documents d left join labels l on d.doc_id = l.doc_id""")
def review_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit("verified").alias("source"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("lang"))
    return A.overridden(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), o, "doc_id", ["source", "lang"], F.col("quality") == 1).select("doc_id", "source", "lang")


@query("""select p_partkey from part anti join (select * from lineitem where l_returnflag = 'R' and l_quantity < 5) on p_partkey = l_partkey""")
def decision_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no small returned order line bears out."""
    return A.lost(table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity < 5").withColumnRenamed("l_partkey", "p_partkey"), ["p_partkey"])


@query("""with refs as (select o_orderkey as id, o_orderkey + 1 as owner_id, 2 as note_index from orders where o_orderpriority = '1-URGENT'),
notes as (select l_orderkey as owner_id, l_linenumber as note_index, l_returnflag as marker from lineitem)
select id, owner_id, note_index, marker from refs join notes using (owner_id, note_index)
union all select o_orderkey, owner_id, note_index, marker from orders join notes on o_orderkey = owner_id where o_orderpriority != '1-URGENT'""")
def note_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders refer to the second note of the next order, others have their own."""
    o = table(spark, sf_dir, "orders")
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner_id"), F.col("l_linenumber").alias("note_index"), F.col("l_returnflag").alias("marker"))
    refs = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") + 1).alias("owner_id"), F.lit(2).alias("note_index"))
    return N.resolved_refs(o.select(F.col("o_orderkey").alias("id")), notes, refs)


@query("""select l_suppkey as id, string_agg(l_orderkey || '/' || l_linenumber || '/' || l_returnflag, ' ' order by l_orderkey, l_linenumber, l_returnflag) as refs from lineitem group by 1""")
def note_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as notes for their suppliers."""
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner_id"), F.col("l_linenumber").alias("note_index"), F.col("l_returnflag").alias("marker"), F.array("l_suppkey").alias("target_ids"))
    ref = lambda r: F.concat_ws("/", r["owner_id"].cast("string"), r["note_index"].cast("string"), r["marker"])
    return N.refs_per_target(notes).select("id", F.array_join(F.transform("refs", ref), " ").alias("refs"))


@query("""with e as (select event_id, user_id, ts, event_type, case when event_type in ('click', 'view') then event_type end as k from events),
c as (select *, last_value(k ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as key from e),
n as (select *, (key is distinct from lag(key) over (partition by user_id order by event_id))::int as new from c)
select event_id, sum(new) over (partition by user_id order by event_id rows unbounded preceding)::bigint as group_no from n""")
def note_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")))
    return N.note_groups(e, "user_id", "event_id", "k").select("event_id", "group_no")


@query("""select doc_id, sha256('{"headings": [' || to_json(coalesce(source, '')) || '], "verses": [' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: to_json(x)), ', ') || ']}') as hash from documents""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source as heading and all lines of the text as verses."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.canonical_hash(F.array(F.coalesce("source", F.lit(""))), F.split("text", "\n")).alias("hash"))


@query("""with f as (select doc_id::varchar as file, octet_length(encode(text)) as length, sha256(text) as found from documents),
m as (select doc_id::varchar as file, octet_length(encode(text)) + case when doc_id % 7 = 0 then 1 else 0 end as bytes, case when doc_id % 5 = 0 then 'x' else sha256(text) end as sha256 from documents union all select 'none', 1, 'x')
select file, case when length is null then 'missing' when length != bytes then 'size' else 'content' end as why from m left join f using (file) where length is null or length != bytes or found != sha256""")
def checksum_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files against a manifest with wrong sizes, wrong hashes and a file that isn't there."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    files = d.select(F.concat(F.lit("/x/"), F.col("doc_id").cast("string")).alias("path"), F.length("content").alias("length"), "content")
    wrong = F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.sha2("content", 256))
    m = d.select(F.col("doc_id").cast("string").alias("file"), (F.length("content") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("bytes"), wrong.alias("sha256"))
    none = spark.range(1).select(F.lit("none").alias("file"), F.lit(1).alias("bytes"), F.lit("x").alias("sha256"))
    return C.checksum_mismatches(files, m.unionByName(none))


@query("""select role, turn, conv_id from conversations where length(trim(text)) > case when role = 'user' then 200 else 400 end and role in ('user', 'assistant')""")
def length_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "conversations").select("role").distinct().filter("role in ('user', 'assistant')").withColumn("most", F.when(F.col("role") == "user", 200).otherwise(400))
    return C.length_limits(table(spark, sf_dir, "conversations"), "role", "text", most).select("role", "turn", "conv_id")


@query("""select unnest(['positive quantity', 'known flag', 'discount below a tenth', 'shipped']) as rule, unnest([count(*) filter (not coalesce(l_quantity > 0, false)), count(*) filter (not coalesce(l_returnflag in ('A', 'N', 'R'), false)), count(*) filter (not coalesce(l_discount < 0.1, false)), count(*) filter (l_shipdate is null)]) as violations from lineitem""")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return C.violations(table(spark, sf_dir, "lineitem"), {"positive quantity": c("l_quantity") > 0, "known flag": c("l_returnflag").isin("A", "N", "R"), "discount below a tenth": c("l_discount") < 0.1, "shipped": c("l_shipdate").isNotNull()})


@query("""select l_suppkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1""")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"])


@query("""select doc_id, d.quality as old_quality, l.quality as new_quality from labels d full join (select doc_id, case when doc_id % 9 = 0 then 1 - quality else quality end as quality from labels where doc_id % 11 != 0) l using (doc_id) where d.quality is distinct from l.quality""")
def classification_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "labels")
    new = table(spark, sf_dir, "labels").filter("doc_id % 11 != 0").withColumn("quality", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return A.changed(old, new, "doc_id", ["quality"])


@query("""select p.page_id, case when d.doc_id is not null then p.lang end as mode, case when d.doc_id is not null then p.id end as id from (select page_id, case nullif(regexp_extract(url, '://[^/?#]*/([^/?#]+)/([0-9]+)/?$', 1), '') when 'en' then 'de' else nullif(regexp_extract(url, '://[^/?#]*/([^/?#]+)/([0-9]+)/?$', 1), '') end as lang, try_cast(regexp_extract(url, '://[^/?#]*/([^/?#]+)/([0-9]+)/?$', 2) as bigint) as id from pages) p left join documents d on p.lang = d.lang and p.id = d.doc_id""")
def routes_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages as routes to documents: language and number; one language's name is an alias of another."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://[^/?#]*(/.*)$", 1).alias("path"))
    slugs = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("lang").alias("slug"), F.lit("de").alias("mode")).distinct()
    entries = table(spark, sf_dir, "documents").select(F.col("lang").alias("mode"), F.col("doc_id").alias("id"))
    return R.routes(p, "path", slugs, entries).select("page_id", "mode", "id")


@query("""select c_custkey, case when n_nationkey is not null then c_mktsegment end as mode, n_nationkey::bigint as id, n_name as title from customer left join nation on c_custkey % 40 = n_nationkey and c_custkey % 2 = 0""")
def bookmarks_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' bookmarks of nations; every other one isn't a number."""
    key = F.concat("c_mktsegment", F.lit(":"), (F.col("c_custkey") % 40).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("x"))
    k = table(spark, sf_dir, "customer").select("c_custkey", key.alias("key"))
    modes = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    entries = modes.withColumn("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(24)))).join(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("c_mktsegment").alias("mode"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    return R.bookmarks(k, "key", entries).select("c_custkey", "mode", "id", "title")


@query("""select doc_id, translate(doc_id::varchar, '0123456789', '०१२३४५६७८९') as shown from documents""")
def display_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.devanagari_number(F.col("doc_id")).alias("shown"))


@query(f"""with h as (select n_nationkey, list_reduce(list_prepend(0, list_transform(string_split(n_name, ''), lambda c: ascii(c))), lambda a, c: (a * 31 + c) % 25) as h from nation)
select n_nationkey, ({T.DESIGNS})[(n_nationkey + h) % 25 + 1] as design from h""")
def bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", T.design(F.col("n_name"), F.col("n_nationkey")).alias("design"))


@query("""select doc_id, md5(coalesce(nullif(array_to_string(string_split(text, chr(10))[1:8], ' '), ''), source)) as preview from documents""")
def preview_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document gets a musical label before each of its lines, which previews leave out."""
    d = table(spark, sf_dir, "documents")
    verses = F.split("text", "\n")
    labelled = F.flatten(F.transform(verses, lambda v: F.array(F.concat(F.lit("(राग "), F.col("lang"), F.lit(")")), v)))
    return d.select("doc_id", F.md5(T.preview(F.col("source"), F.when(F.col("doc_id") % 3 == 0, labelled).otherwise(verses)).cast("binary")).alias("preview"))


@query(f"""with w as (select distinct unnest(string_split(replace(text, chr(10), ' '), ' ')) as word from documents), n as (select word, {_normal_sql("word")} as normal from w)
select word, regexp_replace(normal, 'a([^A-Za-z0-9_]|$)', '\\1', 'g') as roman from n""")
def romanize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of documents, with their accents and punctuation, as they are spelt on a keyboard."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).distinct()
    return T.decomposed(w, "word", "nfd").select("word", T.romanized(F.col("nfd")).alias("roman"))


@query("""select user_id, event_type as status, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where event_type in ('click', 'view', 'purchase')) where r = 1""")
def review_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of known kind of each user: the batch twin of the review stream."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.lit("").alias("comment"), "ts", "event_id")
    return streaming.latest(e.filter(streaming.valid(e, ["click", "view", "purchase"])), "user_id").select("user_id", "status", "event_id")


@query("""select event_type as status, count(*) as n from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1 group by 1""")
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), "ts", "event_id")
    return streaming.progress_counts(streaming.latest(e, "user_id"))


@query("""select user_id as session, max(event_id) as request_id, arg_max(event_type, event_id) as query from events group by 1""")
def latest_query_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("request_id"), F.col("event_type").alias("query"))
    return streaming.latest_query(e)


@query("""select o_orderkey as file, coalesce(n = o_custkey % 7 + 1, false) as available from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey""")
def asset_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the expected number of lines, as files with the expected size."""
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 7 + 1).alias("bytes"))
    there = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.count("*").alias("size"))
    return C.available(m, there).select("file", "available")


#: Consonants that are spelt with one letter, and vowel signs, for words of the script made from words of other letters.
LETTERS = {"k": "क", "g": "ग", "j": "ज", "t": "त", "d": "द", "n": "न", "p": "प", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "s": "स", "h": "ह"}
SIGNS = {"i": "ि", "e": "े", "o": "ो", "u": "ु"}


@query(f"""with w as (select p_partkey, regexp_replace(lower(p_type), '[^{''.join(LETTERS)}{''.join(SIGNS)} ]', '', 'g') as w from part)
select p_partkey, regexp_replace(regexp_replace(regexp_replace(w, '([{''.join(LETTERS)}])', '\\1a', 'g'), 'a([{''.join(SIGNS)}])', '\\1', 'g'), 'a( |$)', '\\1', 'g') as roman from w""")
def romanize_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of parts in letters of the script, as they are spelt on a keyboard: consonants carry an "a" unless a vowel
    sign follows, or the word ends."""
    keep = F.regexp_replace(F.lower("p_type"), f"[^{''.join(LETTERS)}{''.join(SIGNS)} ]", "")
    script = F.translate(keep, "".join(LETTERS) + "".join(SIGNS), "".join(LETTERS.values()) + "".join(SIGNS.values()))
    d = T.decomposed(table(spark, sf_dir, "part").select("p_partkey", script.alias("word")), "word", "nfd")
    return d.select("p_partkey", T.romanized(F.col("nfd")).alias("roman"))
