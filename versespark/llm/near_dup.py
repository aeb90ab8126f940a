"""MinHash near-dedup with odd sketches.

1. A pass over the texts gives each document the size of its shingle set, a 128-bit hash of the set, the hashes of its
   MinHash bands and an odd sketch: each of the MinHash samples flips one bit of a bitmap, so the XOR of two bitmaps
   has a set bit for about each sample that they don't share.
2. Documents with equal sets are a class, and only its smallest id goes on.
3. Representatives that share a band meet the band's pivot (the one with the smallest hash; another order for each
   band). The XOR population count of the two odd sketches estimates their similarity; pairs far below the threshold are
   false candidates. Those that a pivot rejects then meet all others of the band that have about their size and are not
   so close to the pivot that their links would be close to it too. What is left connects candidates into pools.
4. Links are confirmed on full shingle sets. A pool is dealt into chunks of bounded size; every member is held against
   the pool's pivots, then against each member that is still outside the pool's largest component. So all pairs
   of a pool that could join two components are compared, but no pairs are emitted but confirmed links.
5. Components are found by alternating large-star and small-star steps on the links.

With 36 bands of 5 rows, a pair of similarity 0.8 shares no band with a probability of 6e-7, more similar ones less. Pairs
that share one are lost only where estimates are off by some standard deviations. A band of many documents that are not
alike costs time with the square of their number (sketches of 128 bytes in blocks), but no rows.

Defined results: a document without words (null, empty or blank text) has no shingles and is linked with nothing; one with
fewer words than a shingle has its whole sequence as one. Ids should be unique: a repeated row is in the class of its
like, and another text under the same id is judged by its own class. Rows without an id are linked with their class
only, and have the component of its smallest id (null if it has none). Ties can't occur, as classes and components are
named by their smallest ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, small_enough, staged

BANDS, ROWS = 36, 5
SKETCH_LONGS = 16  # bits of an odd sketch: 64 times this
PERCENT = 80
#: Estimates this far below the threshold are no candidates: over five standard deviations.
MARGIN = 0.3
#: With an estimate of this much for a pivot, all documents linked with a member are at least MARGIN candidates of the pivot
#: (distances obey the triangle inequality), but for 0.2 that the two estimates may be off together.
TIGHT = 1 - MARGIN + 0.2
#: Members of a pool that one task holds at a time, and the pivots of a pool.
CHUNK, PIVOTS = 400, 8
#: Members of a band that are joined row by row at most, and sketches that one task holds at a time beyond that.
FEW, SKETCHES = 32, 4000
SEED = 20_111

_WORDS: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = _WORDS.get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's `width`-word shingles: words are what lies between ASCII blanks, A-Z
    lower-cased; fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = min(width, len(words))
    h = _word_hashes(words)
    n = len(words) - w + 1
    out = np.full(n, w, np.uint64)
    for i in range(w):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _samples(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash samples of a non-empty set: the least value under each of bands * rows hash functions."""
    a, b = _functions(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        x = h[i : i + 1024, None] * a
        x += b
        least = np.minimum(least, x.min(0))
    return least


@lru_cache
def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def _sketch(samples: np.ndarray, longs: int) -> np.ndarray:
    """The odd sketch of samples: bit p is the parity of the samples that fall on p."""
    at = _mix(samples + np.arange(1, len(samples) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * longs)
    bits = (np.bincount(at.astype(np.int64), minlength=64 * longs) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def signatures(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, c1, c2 (hash of the set), bands (array of band hashes) and sketch (array of long) of each row."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                h = shingle_hashes(t, width)
                if not len(h):
                    out.append((0, 0, 0, [], []))
                    continue
                c1, c2 = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64).tolist()
                s = _samples(h, bands, rows)
                keys = np.arange(bands, dtype=np.uint64)
                for column in s.reshape(bands, rows).T:
                    keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
                out.append((len(h), c1, c2, keys.view(np.int64), _sketch(s, SKETCH_LONGS)))
            got = pd.DataFrame(out, columns=["n_shingles", "c1", "c2", "bands", "sketch"])
            got.insert(0, "id", b["id"].array)
            yield got
        _WORDS.clear()  # the worker lives on

    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return d.mapInPandas(_with_ids(sign), "id long, n_shingles long, c1 long, c2 long, bands array<long>, sketch array<long>")


def _with_ids(f):
    """Keep nullable ids whole numbers on their way through pandas."""

    def g(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return f(b.astype({"id": "Int64"}) for b in batches)

    return g


def estimate(a: Column, b: Column, samples: int = BANDS * ROWS, longs: int = SKETCH_LONGS) -> Column:
    """Similarity by two odd sketches: the population count of their XOR tells how many samples differ."""
    odd = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    bits = 64 * longs
    # of d samples that differ on each side, 2 d flips leave about bits / 2 * (1 - exp(-4 d / bits)) odd bits
    open_ = F.greatest(1 - 2.0 * odd / bits, F.lit(1e-3))
    return 1 + bits / (4.0 * samples) * F.log(open_)


def components(links: DataFrame) -> DataFrame:
    """id, component for each id of `links` (a, b): the smallest id that it is connected with."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e = staged(e, "links")
    before = None
    while True:
        # large star: hang all larger neighbours of a node on its smallest one
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: hang a node and its smaller neighbours on the smallest of them
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_m, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u != v").distinct()
        e = staged(small, "links")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h"), F.count_distinct("u").alias("d")).first()
        if now["n"] == now["d"] and (now["n"], now["h"]) == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = (now["n"], now["h"])


def candidate_pools(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """id, pool for the representatives (id, n_shingles, bands, sketch) that may have a link."""
    keyed = reps.select("id", F.floor(F.log("n_shingles") / F.log(F.lit(100.01 / percent))).cast("int").alias("size"), F.explode("bands").alias("key"))  # a key names its band too
    order = F.struct(F.xxhash64("id", "key").alias("h"), F.col("id").alias("id"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    met = keyed.join(full.select("key", F.col("first.id").alias("pivot"), "n"), "key").filter("id != pivot")
    met = staged(met.withColumns({"a": F.least("id", "pivot"), "b": F.greatest("id", "pivot")}), "band-members")
    least = percent / 100 - MARGIN
    judged = staged(_estimated(met.select("a", "b").distinct(), reps).filter(F.col("e") >= least), "band-pairs")
    close = judged.select("a", "b").unionByName(_rejected_pairs(met, judged, reps, least))
    return components(close).select("id", F.col("component").alias("pool")).transform(_with_roots, "pool")


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b and e, the estimate of their similarity."""
    sketch = lambda c: reps.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
    return pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", estimate(F.col("sa"), F.col("sb")).alias("e"))


def _rejected_pairs(met: DataFrame, judged: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that connect what a band's pivot rejected with the candidates among the band's other members; those who
    met the pivot as candidates are connected by it. Linked documents are at most one class of size apart."""
    rest = met.filter("n > 2").join(judged, ["a", "b"], "left").filter(F.coalesce("e", F.lit(0.0)) < TIGHT)
    rest = staged(rest.select("key", "size", "id", F.col("e").isNull().alias("rejected")), "band-rest")
    asked = rest.filter("rejected").select("key", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), F.col("id").alias("asker"))
    m = rest.groupBy("key", "size").agg(F.count("*").alias("members"))
    q = asked.groupBy("key", "size").agg(F.count("*").alias("askers"))
    groups = staged(m.join(q, ["key", "size"]), "band-sizes")
    few = groups.filter(F.col("members") <= FEW).select("key", "size")
    pairs = asked.join(few, ["key", "size"]).join(rest, ["key", "size"]).filter("asker != id").select(F.least("id", "asker").alias("a"), F.greatest("id", "asker").alias("b")).distinct()
    found = _estimated(pairs, reps).filter(F.col("e") >= least).select("a", "b")
    many = groups.filter(F.col("members") > FEW).withColumns({"chunks": F.ceil(F.col("members") / SKETCHES).cast("int"), "blocks": F.ceil(F.col("askers") / SKETCHES).cast("int")})
    many = small_enough(staged(many, "band-blocks"))
    part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sketch = lambda c: reps.select(F.col("id").alias(c), "sketch")
    keys = ["key", "size", "chunk", "block"]
    left = rest.join(many, ["key", "size"]).withColumn("chunk", part("id", "chunks")).withColumn("block", every("blocks")).join(sketch("id"), "id").select(*keys, "id", "sketch")
    right = asked.join(many, ["key", "size"]).withColumn("block", part("asker", "blocks")).withColumn("chunk", every("chunks")).join(sketch("asker"), "asker").select(*[F.col(c).alias(c) for c in keys], F.col("asker").alias("id"), F.col("sketch").alias("sketch"))
    more = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(lambda x, y: _close_in_block(x, y, least), "a long, b long")
    return staged(found.unionByName(more), "rejected-pairs")


def _close_in_block(members: pd.DataFrame, asked: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs that connect each of `asked` with all candidates of `members`: one for each part that isn't connected yet."""
    links = []
    if len(members) and len(asked):
        ids, bits = members["id"].to_numpy(), 64 * SKETCH_LONGS
        sketches = np.stack(members["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
        limit = bits / 2 * (1 - np.exp((least - 1) * 4 * BANDS * ROWS / bits))
        label = np.arange(len(ids))
        for i, s in zip(asked["id"].tolist(), asked["sketch"], strict=True):
            odd = np.bitwise_count(sketches ^ np.asarray(s, np.int64).view(np.uint64)).sum(1, dtype=np.int64)
            parts, at = np.unique(np.where(odd <= limit, label, -1), return_index=True)
            near = parts[parts >= 0]
            links += [(min(i, j), max(i, j)) for j in ids[at[parts >= 0]].tolist() if i != j]
            if len(near) > 1:
                label[np.isin(label, near)] = near[0]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _with_roots(named: DataFrame, name: str) -> DataFrame:
    """Also the rows of the smallest ids, which components() leaves out."""
    return named.unionByName(named.select(F.col(name).alias("id"), name).distinct())


def shingle_sets(docs: DataFrame, pools: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """id, pool, shingles (packed hashes) of the documents in pools."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "pool": b["pool"], "shingles": [shingle_hashes(t, width).tobytes() for t in b["text"]]})

    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return d.join(small_enough(pools), "id").mapInPandas(pack, "id long, pool long, shingles binary")


def _confirm(members: pd.DataFrame, asked: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the documents of a chunk and those asked for: intersections are counted in one sorted index."""
    sets = [np.frombuffer(s, np.uint64) for s in members["shingles"]]
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = members["id"].to_numpy()
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
    links = []
    for i, s in zip(asked["id"], asked["shingles"], strict=True):
        q = np.frombuffer(s, np.uint64)
        lo, hi = np.searchsorted(flat, q, "left"), np.searchsorted(flat, q, "right")
        n = hi - lo
        take = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[take], minlength=len(sets))
        hit = (100 * common >= percent * (sizes + len(q) - common)) & (ids != i)
        links += [(min(i, j), max(i, j)) for j in ids[hit].tolist()]
    return pd.DataFrame(sorted(set(links)), columns=["a", "b"], dtype="int64")


def confirmed_links(sets: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between all of `sets` and `asked` (both: id, pool, shingles) in the same pool, in blocks of bounded size."""
    parts = lambda df, name: df.groupBy("pool").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    sizes = small_enough(staged(parts(sets, "chunks").join(parts(asked, "blocks"), "pool"), "pool-sizes"))
    cols = ["pool", "chunk", "block", "id", "shingles"]
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sets.join(sizes, "pool").withColumn("chunk", part("chunks")).withColumn("block", every("blocks")).select(cols)
    right = asked.join(sizes, "pool").withColumn("block", part("blocks")).withColumn("chunk", every("chunks")).select([F.col(c).alias(c) for c in cols])

    def compare(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _confirm(m, q, percent) if len(m) and len(q) else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    keys = cols[:3]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, c1, c2, class_id (smallest id with the same set), component_id of each row of `docs`."""
    signed = staged(signatures(docs, width, doc_id, text), "signatures")
    some = signed.filter("n_shingles > 0")
    classes = staged(some.groupBy("c1", "c2").agg(F.min("id").alias("class_id")), "classes")
    reps = some.join(classes.filter("class_id is not null").select(F.col("class_id").alias("id"), "c1", "c2"), ["id", "c1", "c2"], "left_semi").dropDuplicates(["id", "c1", "c2"])
    pools = staged(candidate_pools(reps.select("id", "n_shingles", "bands", "sketch"), percent), "pools")
    sets = staged(shingle_sets(docs, pools, width, doc_id, text), "shingle-sets", "lz4")
    w = Window.partitionBy("pool").orderBy(F.xxhash64("id"), "id")
    pivots = sets.select("id", "pool").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= PIVOTS).drop("r")
    first = staged(confirmed_links(sets, sets.join(small_enough(staged(pivots, "pivots")), ["id", "pool"], "left_semi"), percent), "first-links")
    part = _with_roots(components(first), "component")
    named = sets.select("id", "pool").distinct().join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("pool", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("pool").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("total"))
    # pools of at most PIVOTS members are done: all of them were pivots
    outside = named.join(main, "pool").filter((F.col("component") != F.col("m.component")) & (F.col("total") > PIVOTS)).select("id", "pool")
    outside = staged(outside, "outside")
    second = confirmed_links(sets, sets.join(small_enough(outside), ["id", "pool"], "left_semi"), percent)
    found = staged(components(first.unionByName(second)), "components")
    named = classes.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id"))
    out = signed.select("id", "n_shingles", "c1", "c2").join(named.select("c1", "c2", "class_id", "component_id"), ["c1", "c2"], "left")
    empty = F.col("n_shingles") == 0
    return out.select("id", "n_shingles", "c1", "c2", F.when(empty, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def kept(found: DataFrame) -> Column:
    return F.col("id").eqNullSafe(F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each group: the one with the smallest id. Documents without shingles all stay, and so do
    rows that repeat the id that stays."""
    found = near_duplicates(docs, width, percent, doc_id, text)
    gone = staged(found.filter(~kept(found)).select("id").distinct(), "near-copies")
    (key,) = fresh(docs, "near_copy_id")
    gone = gone.select(F.coalesce("id", F.lit(-1 << 63)).alias(key))
    return docs.join(small_enough(gone), F.coalesce(F.col(doc_id).cast("long"), F.lit(-1 << 63)) == F.col(key), "left_anti")
