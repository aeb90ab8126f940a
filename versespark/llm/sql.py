"""DuckDB SQL for the rows of the corpus queries that SQL can state. Each is written from the query's definition, without
its sketches, fingerprints, indexes or merges, so that it checks them."""

from __future__ import annotations

from . import line_dedup, mixing, quality, resampling, warc

WORDS = r"'[^\x20\x09-\x0D]+'"

LEAST = " ".join(f"WHEN '{m}' THEN {n}" for m, n in quality.LEAST.items())

QUALITY = rf"""
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
word AS (
  SELECT k, unnest(w) AS w, unnest(range(len(w))) AS i
  FROM (SELECT k, regexp_extract_all(t, {WORDS}) AS w FROM doc)
),
triple AS (
  SELECT k, i, w, CASE WHEN count(*) OVER three = 3 THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o END AS x
  FROM word WINDOW o AS (PARTITION BY k ORDER BY i), three AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
),
often AS (SELECT k, i, w, x IS NOT NULL AND count(*) OVER (PARTITION BY k, x) > 1 AS often FROM triple),
covered AS (SELECT k, w, max(often::INT) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM often),
on_words AS (SELECT k, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(c)::BIGINT AS n_repeat_words FROM covered GROUP BY k),
line AS (SELECT k, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS})) AS l FROM doc),
on_text AS (SELECT k, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM line),
measured AS (
  SELECT k, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_lines, n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM doc JOIN on_text USING (k) LEFT JOIN on_words USING (k)
),
judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    100 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(n_words, 1) AS symbols,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines
  FROM measured
),
ratio AS (UNPIVOT (SELECT k, lang, source, word_length, symbols, repeats, dup_lines FROM judged WHERE NOT base_failed) ON word_length, symbols, repeats, dup_lines INTO NAME measure VALUE x),
rounded AS (SELECT *, x - x % (1::BIGINT << greatest(length(bin(x)) - 6, 0)) AS b FROM ratio),
bucket AS (SELECT lang, source, measure, b, count(*)::BIGINT AS n FROM rounded GROUP BY ALL),
-- a language's buckets with some documents' worth of all, a group's with as much of its language
whole AS (SELECT measure, b, sum(n)::BIGINT AS n, sum(sum(n)) OVER (PARTITION BY measure)::BIGINT AS total FROM bucket GROUP BY measure, b),
language AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, measure)::BIGINT AS total FROM (
    SELECT lang, measure, b, sum(n)::BIGINT AS n FROM (
      SELECT lang, measure, b, {quality.UNIT} * n AS n FROM bucket
      UNION ALL SELECT lang, measure, b, {quality.UNIT * quality.PRIOR} * n // total FROM whole, (SELECT DISTINCT lang FROM bucket)
    ) GROUP BY ALL
  )
),
blend AS (
  SELECT lang, source, measure, b, sum(n)::BIGINT AS n FROM (
    SELECT lang, source, measure, b, {quality.UNIT} * n AS n FROM bucket
    UNION ALL SELECT l.lang, source, measure, b, {quality.UNIT * quality.PRIOR} * n // total FROM language l JOIN (SELECT DISTINCT lang, source FROM bucket) g ON g.lang IS NOT DISTINCT FROM l.lang
  ) GROUP BY ALL HAVING sum(n) > 0
),
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total FROM blend),
quartile AS (SELECT lang, source, measure, min(b) FILTER (100 * upto >= 25 * total) AS q1, min(b) FILTER (100 * upto >= 75 * total) AS q3 FROM run GROUP BY lang, source, measure),
fence AS (
  SELECT *, q1 - {quality.REACH} * spread AS low, q3 + {quality.REACH} * spread AS high
  FROM (SELECT *, greatest(q3 - q1, q3 // 10, CASE measure {LEAST} END) AS spread FROM quartile)
),
outside AS (
  SELECT DISTINCT j.k
  FROM (UNPIVOT (SELECT k, lang, source, word_length, symbols, repeats, dup_lines FROM judged) ON word_length, symbols, repeats, dup_lines INTO NAME measure VALUE x) j
  JOIN fence f ON f.measure = j.measure AND f.lang IS NOT DISTINCT FROM j.lang AND f.source IS NOT DISTINCT FROM j.source
  WHERE j.x > f.high OR (j.measure = 'word_length' AND j.x < f.low)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND k NOT IN (SELECT k FROM outside) AS kept
FROM judged
"""

CAPTURES = f"""
WITH body AS (SELECT page_id, url, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
digest AS (SELECT *, sha1(payload) AS hex FROM body),
host AS (SELECT *, regexp_extract(url, '(?s)^[^:/?#]+://([^/?#]*)(.*)$', ['host', 'rest']) AS u, coalesce(regexp_matches(url, '^[^:/?#]+://'), FALSE) AS has_host FROM digest),
named AS (SELECT *, lower(regexp_replace(u.host, '^.*@', '')) AS h, lower(split_part(u.rest, '#', 1)) AS tail FROM host),
keyed AS (
  SELECT *, CASE WHEN has_host THEN array_to_string(list_reverse(string_split(split_part(h, ':', 1), '.')), ',')
    || CASE WHEN length(h) > length(split_part(h, ':', 1)) + 1 THEN substr(h, length(split_part(h, ':', 1)) + 1) ELSE '' END || ')' || CASE WHEN tail = '' THEN '/' ELSE tail END
    ELSE lower(coalesce(url, '')) END AS url_key,
    strftime(TIMESTAMP '{warc.BASE_DATE}' + to_seconds(coalesce(page_id, 0) % 2000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
  FROM named
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to,
  url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id NULLS FIRST) AS history_pos
FROM keyed
"""

LINES = rf"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
),
line AS (SELECT doc_id, i, x, len(regexp_extract_all(x, {WORDS})) AS words FROM raw WHERE regexp_matches(x, {WORDS})),
placed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto FROM line),
span AS (
  SELECT doc_id, min(i) OVER w AS a, max(i) OVER w AS b, sum(words) OVER w AS n, list(x) OVER w AS xs
  FROM (SELECT *, upto - words AS before FROM placed) WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {line_dedup.MIN_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(i) OVER w, max(i) OVER w, sum(words) OVER w, list(x) OVER w
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {line_dedup.MIN_WORDS - 1} PRECEDING AND CURRENT ROW)
),
run AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY xs ORDER BY doc_id, a) AS r, min((doc_id, a)) OVER (PARTITION BY xs) AS earliest FROM span WHERE n >= {line_dedup.MIN_WORDS}),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM run WHERE (doc_id, a) <> earliest),
kept AS (
  SELECT raw.doc_id, coalesce(string_agg(x, chr(10) ORDER BY raw.i) FILTER (gone.i IS NULL), '') AS kept, count(gone.i) AS n_removed
  FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.i = raw.i GROUP BY raw.doc_id
)
SELECT doc_id, strlen(kept)::BIGINT AS kept_bytes, n_removed, sha256(kept) AS kept_sha256 FROM kept
"""


def mixing_sql(want: dict[str, dict[str, float]], budget: float = 0.5) -> str:
    """Rows of the mixing query: cells are raked round by round, and the factor is found from the cells in the order of
    their weights instead of by bisection: with the heaviest cells certain, the others reach the budget at some factor, and
    the true factor is the largest of these."""
    rows = ", ".join(f"('{m}', '{c}', {v!r}::DOUBLE)" for m, shares in want.items() for c, v in shares.items())
    step = "round"
    for k, m in enumerate(mixing.MARGINS):
        share = f"sum(raked) OVER (PARTITION BY c.{m}) / total"
        error = f"greatest({'e' if k else 0}, abs({share} - t.target))"
        step = f"(SELECT c.* REPLACE (raked * t.target / ({share}) AS raked, {error} AS e) FROM {step} c JOIN target t ON t.margin = '{m}' AND t.category = c.{m})"
    margins = " UNION ALL ".join(f"SELECT '{m}' AS margin, {m} AS category, sum(tokens) AS tokens FROM cell GROUP BY {m}" for m in mixing.MARGINS)
    return rf"""
WITH RECURSIVE want(margin, category, share) AS (VALUES {rows}),
doc AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, 'no source') AS source, coalesce(lang, 'no lang') AS lang FROM documents),
counted AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(t, {WORDS}))::BIGINT AS tokens,
    CASE WHEN 100 * len(regexp_extract_all(t, '[#*$%&|<>{{}}]')) > 2 * length(t) THEN 'markup' WHEN 100 * len(regexp_extract_all(t, '[0-9]')) > 5 * length(t) THEN 'data'
      WHEN length(t) < 60 * len(string_split(t, chr(10))) THEN 'list' ELSE 'prose' END AS topic
  FROM doc
),
cell AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS raked, sum(sum(tokens)) OVER ()::DOUBLE AS total FROM counted GROUP BY source, lang, topic HAVING sum(tokens) > 0),
there AS (SELECT m.margin, m.category, m.tokens, share FROM ({margins}) m LEFT JOIN want USING (margin, category)),
rest AS (SELECT margin, coalesce(sum(share), 0) AS given, sum(tokens) FILTER (share IS NULL) AS others FROM there GROUP BY margin),
target AS (
  SELECT margin, category, coalesce(share, greatest(1 - given, 0) * tokens / others) / (given + CASE WHEN others IS NULL THEN 0 ELSE greatest(1 - given, 0) END) AS target
  FROM there JOIN rest USING (margin)
),
round AS (
  SELECT 0 AS n, 0::DOUBLE AS e, 1::DOUBLE AS worst, * FROM cell
  UNION ALL
  SELECT n + 1, e, max(e) OVER () AS worst, * EXCLUDE (n, e, worst) FROM {step} WHERE n < {mixing.ROUNDS} AND worst >= {mixing.ERROR}
),
weighed AS (SELECT source, lang, topic, tokens, raked / tokens AS weight, worst < {mixing.ERROR} AS converged FROM round WHERE n = (SELECT max(n) FROM round)),
capped AS (
  SELECT *, coalesce(sum(tokens) OVER (ORDER BY weight DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS certain,
    sum(tokens * weight) OVER (ORDER BY weight RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open, sum(tokens) OVER () AS total FROM weighed
),
factor AS (SELECT max(({budget} * total - certain) / open) AS c FROM capped)
SELECT doc_id, topic, counted.tokens, round(weight, 6) AS weight, round(coalesce(least(1, weight * c), 1), 6) AS probability,
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < coalesce(least(1, weight * c), 1) AS drawn, (SELECT bool_and(converged) FROM weighed) AS converged
FROM counted CROSS JOIN factor LEFT JOIN weighed USING (source, lang, topic)
"""


def _resampling_words(table: str, doc_id: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"SELECT row_number() OVER () AS k, {doc_id} AS doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM {table}"


#: The CRC-32 of distinct words is worked out byte by byte with a table of 256 values.
RESAMPLING = f"""
WITH RECURSIVE bit AS (SELECT n, 0 AS k, n::BIGINT AS x FROM range(256) r(n) UNION ALL SELECT n, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bit WHERE k < 8),
crc AS MATERIALIZED (SELECT list(x ORDER BY n) AS c FROM bit WHERE k = 8),
doc AS MATERIALIZED ({_resampling_words("documents", "doc_id")}),
aim AS MATERIALIZED ({_resampling_words("benchmark", "NULL")}),
raw AS MATERIALIZED (SELECT k, w, count(*)::BIGINT AS n FROM (SELECT k, unnest(w) AS w FROM doc) GROUP BY ALL),
goal AS (SELECT w, count(*)::BIGINT AS n FROM (SELECT unnest(w) AS w FROM aim) GROUP BY ALL),
word AS (SELECT w, hex(w) AS h, list_transform(range(octet_length(encode(w))), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bytes FROM (SELECT w FROM raw UNION SELECT w FROM goal)),
bucket AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295) % {resampling.BUCKETS} AS b FROM word, crc),
s AS (SELECT b, sum(n)::BIGINT AS s FROM raw JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, sum(n)::BIGINT AS t FROM goal JOIN bucket USING (w) GROUP BY b),
size AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + {resampling.BUCKETS} AS s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + {resampling.BUCKETS} AS t),
gain AS (SELECT b, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * size.s / ((s.s + 1)::DOUBLE * size.t)))::BIGINT AS g FROM s LEFT JOIN t USING (b), size),
mean AS (SELECT k, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS m, sum(n)::BIGINT AS n FROM raw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY k),
scored AS (
  SELECT k, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(m, 0) AS weight,
    coalesce(m, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM doc LEFT JOIN mean USING (k)
),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= {resampling.MIN_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN r <= n * {resampling.PERCENT} // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (k)
"""
