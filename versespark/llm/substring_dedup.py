"""Exact substring dedup on a sharded run-length index.

Every byte covered by a `length`-byte string that also starts anywhere else is marked, over all documents.

1. Each window of `length` bytes is named by the smallest hash of the 16-byte grams in it. Equal windows have equal
   names, so a string can only repeat within the windows of one name. Neighbouring windows of one name are a context;
   a context is about a hundred windows.
2. Names and hashes of contexts are counted. A name with one context has no repeats in it and is done, unless a gram
   recurs inside that context. A context that occurs twice as a whole is repeated in all its windows and is done too.
   What is left are the edges of repeats.
3. Those contexts, and one of each repeated kind under the same names, are dealt out by name. Each shard builds a
   run-compressed Burrows-Wheeler transform of its contexts, with the suffix array sampled at run ends. Where the
   preceding bytes of two neighbouring suffixes are equal, the longest match of a suffix is that of the one before
   it less one byte; so matching statistics stream through the text from the samples at run ends alone. Windows whose
   statistic reaches `length` are marked.
4. A name with very many contexts would be too much for a shard: its windows are hashed one by one and counted.
5. Marked windows are merged to spans by document and cut out of the text's bytes.

Only short rows are shuffled; texts are read with the positions asked of them.

Defined results: a null text has no bytes; texts shorter than `length` have no windows; the same row twice repeats all
its windows; texts are told apart by id and text hash, so rows with equal ids don't mix; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, small_enough, staged

LENGTH, GRAM = 200, 16
#: Contexts of one shard's index, and of one name that a shard takes.
SHARD_CONTEXTS, NAME_CONTEXTS = 5_000, 20_000
#: Documents with positions or spans may be broadcast up to this number of documents and of positions.
BROADCAST_DOCS, BROADCAST_SPANS = 200_000, 1_500_000
#: Two suffixes are told apart by this many bytes; a context is shorter.
DEPTH = 512
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(a: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of n places of a byte array."""
    return np.lib.stride_tricks.as_strided(a[:8].view(np.uint64), (n,), (1,))


def gram_hashes(data: bytes) -> np.ndarray:
    """The hash of the 16 bytes from each place."""
    n = len(data) - GRAM + 1
    x = _words(np.frombuffer(data, np.uint8), n + 8)
    h = x[:n] * K1
    h ^= x[8 : n + 8] * K2
    h ^= h >> np.uint64(29)
    h *= K1
    h ^= h >> np.uint64(32)
    return h


def contexts(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, name, and whether the name's gram recurs in it, of each context of a text of at least `length` bytes."""
    h = gram_hashes(data)
    w, m = length - GRAM + 1, len(data) - length + 1
    rows = -(-len(h) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [m - 1]])
    name = least[first]
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    left = first + (view[first] == name[:, None]).argmax(1)
    right = last + w - 1 - (view[last][:, ::-1] == name[:, None]).argmax(1)
    recurs = left != right
    if (last - first >= w).any():  # a gram that recurs on and on: pieces of at most w contexts
        parts = [np.arange(a, b + 1, w) for a, b in zip(first, last, strict=True)]
        n = [len(p) for p in parts]
        name, recurs, stop = np.repeat(name, n), np.repeat(recurs, n), np.repeat(last, n)
        first = np.concatenate(parts)
        last = np.minimum(first + w - 1, stop)
    return first, last, name, recurs


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of some byte strings, with the suffix array sampled at run ends.

    Suffixes are sorted by their first DEPTH bytes, by doubling ranks of 8-byte prefixes. A string's first suffix
    never joins a run, so that matches don't carry over from the string before it."""

    def __init__(self, strings: list[bytes]):
        self.starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])[:-1]]).astype(np.int64)
        text = np.frombuffer(b"\xff".join(strings) + b"\xff" * (DEPTH + 16), np.uint8)
        n = self.n = len(text) - DEPTH - 15
        self.words = _words(text, len(text) - 7).byteswap()
        # rank: the place in the order where the suffixes that are equal so far begin. Only those of groups with several
        # are sorted again, within the places of their group.
        first_words = self.words[:n]
        order = np.argsort(first_words)
        same = np.concatenate([[False], first_words[order[1:]] == first_words[order[:-1]]])
        place = np.arange(n, dtype=np.int32)
        rank = np.empty(n + DEPTH, np.int32)
        rank[n:] = -1
        rank[order] = np.maximum.accumulate(np.where(same, 0, place))
        self.near = None
        k = 8
        while k < DEPTH:
            if k == 128:
                self.near = rank[:n].copy()  # equal ranks: at least 128 equal bytes
            open_ = np.flatnonzero(same | np.append(same[1:], False))
            if not len(open_):
                break
            sub = order[open_]
            key = rank[sub].astype(np.int64) << 32 | (rank[sub + k] + 1).astype(np.int64)
            by = np.argsort(key)
            sub, key = sub[by], key[by]
            order[open_] = sub
            same[open_] = np.concatenate([[False], key[1:] == key[:-1]])
            rank[sub] = np.maximum.accumulate(np.where(same, 0, place))[open_]
            k *= 2
        if self.near is None:
            self.near = rank[:n]
        before = text[order - 1]
        first = np.zeros(n, bool)
        first[self.starts] = True
        alone = first[order]
        breaks = np.flatnonzero((before[1:] != before[:-1]) | alone[1:] | alone[:-1]) + 1
        self.heads = before[np.concatenate([[0], breaks])]  # the runs' bytes
        self.run_starts = np.concatenate([[0], breaks])
        self.at_start = order[self.run_starts]  # samples: the suffix at each run's start and end
        self.at_end = order[np.concatenate([breaks - 1, [n - 1]])]

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes from a and from b are equal, up to DEPTH."""
        out = np.full(len(a), DEPTH, np.int64)
        open_ = np.arange(len(a))
        for k in range(0, DEPTH, 8):
            # places past the end repeat the filler, which no text has
            x = self.words[np.minimum(a[open_] + k, len(self.words) - 1)] ^ self.words[np.minimum(b[open_] + k, len(self.words) - 1)]
            ends = np.flatnonzero(x)
            if len(ends):
                v, equal = x[ends], np.zeros(len(ends), np.int64)
                for shift in range(56, -1, -8):
                    equal += (v >> np.uint64(shift)) == 0
                out[open_[ends]] = k + equal
                open_ = np.delete(open_, ends)
            if not len(open_):
                break
        return out

    def statistics(self, least: int) -> np.ndarray:
        """The longest match of each suffix with another one, where it is at least `least` (>= 128); smaller values are lower bounds."""
        value = np.zeros(self.n, np.int64)
        a, b = self.at_end[:-1], self.at_start[1:]
        far = self.near[a] == self.near[b]
        a, b = a[far], b[far]
        equal = self._match(a, b)
        np.maximum.at(value, a, equal)
        np.maximum.at(value, b, equal)
        place = np.arange(self.n)
        return np.maximum.accumulate(np.where(value >= least, value + place, 0)) - place


def repeated_windows(strings: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each string the ranges (first, last) of places from which `length` bytes also start elsewhere in the strings."""
    index = RunIndex(strings)
    long = index.statistics(length) >= length
    out = []
    for at, s in zip(index.starts.tolist(), strings, strict=True):
        hit = np.flatnonzero(np.diff(np.concatenate([[0], long[at : at + len(s) - length + 1].astype(np.int8), [0]])))
        out.append([(a, b - 1) for a, b in hit.reshape(-1, 2).tolist()])
    return out


KEY = "id long, th int"


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.hash(F.col(text)).alias("th"), F.col(text).alias("text"))


def _places(docs: DataFrame, length: int) -> DataFrame:
    """id, th, first, last, name, context (hash) and recurs for each context of the documents."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, out = b["id"].astype("Int64"), []
            for k, (th, t) in enumerate(zip(b["th"], b["text"], strict=True)):
                data = (t or "").encode()
                if len(data) < length:
                    continue
                first, last, name, recurs = contexts(data, length)
                view = memoryview(data)
                hashed = np.array([xxhash.xxh64_intdigest(view[i:j]) for i, j in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
                out.append((np.full(len(first), k), np.full(len(first), th), first, last, name.view(np.int64), hashed.view(np.int64), recurs))
            if out:
                k, th, first, last, name, hashed, recurs = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"id": ids.take(k).array, "th": th, "first": first, "last": last, "name": name, "context": hashed, "recurs": recurs})

    return docs.mapInPandas(cut, f"{KEY}, first int, last int, name long, context long, recurs boolean")


def _few(df: DataFrame, entries: str) -> DataFrame:
    """A broadcast hint if the documents and their array entries are few enough."""
    n = df.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size(entries)), F.lit(0)).alias("entries")).first()
    return F.broadcast(df) if n["docs"] <= BROADCAST_DOCS and n["entries"] <= BROADCAST_SPANS else df


def _same_doc(df: DataFrame) -> DataFrame:
    """id and th as one key that matches nulls."""
    return df.withColumn("doc", F.struct("id", "th")).drop("id", "th")


def repeated_spans(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc (struct of id and text hash) and its spans (array of start, end in bytes): the maximal repeated stretches."""
    if not 128 <= length <= 256:
        raise ValueError("the index takes lengths from 128 to 256 bytes")
    bounded_batches(docs.sparkSession, 500)
    texts = _texts(docs, doc_id, text)
    places = staged(_places(texts, length), "contexts")
    kinds = places.groupBy("name", "context").agg(F.count("*").alias("n"), F.max("recurs").alias("recurs"))
    names = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.max("n").alias("most"), F.min("n").alias("fewest"), F.max("recurs").alias("recurs"))
    # names with something to find; the edges are in those with several kinds of context
    names = names.filter("kinds > 1 or most > 1 or recurs")
    found = staged(places.join(names.drop("recurs"), "name").drop("recurs"), "shared-contexts")
    whole = found.groupBy("name", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "first")).alias("one")).filter("n > 1")
    found = found.join(whole, ["name", "context"], "left")
    done = F.col("n").isNotNull()
    found = staged(found.select("id", "th", "first", "last", "name", ((F.col("kinds") > 1) & (F.col("fewest") == 1)).alias("edges"), "kinds", done.alias("done"), (~done | (F.struct("id", "th", "first") == F.col("one"))).alias("shown")), "context-kinds")
    spans = found.filter("done").select("id", "th", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    # a name needs the index if one of several contexts stands alone, or if it recurs inside its only context
    ask = found.filter("shown and (edges or not done)")
    ask = ask.groupBy("id", "th").agg(F.collect_list(F.struct("name", "first", "last", (F.col("kinds") > NAME_CONTEXTS).alias("many"))).alias("asked"))
    ask = staged(_same_doc(ask), "asked-contexts")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, out = [], []
            for i, th, t, asked in zip(b["id"].astype("Int64"), b["th"], b["text"], b["asked"], strict=True):
                data = t.encode()
                for c in asked:
                    first, last = c["first"], c["last"]
                    pieces = [(s, s) for s in range(first, last + 1)] if c["many"] else [(first, last)]
                    ids += [i] * len(pieces)
                    out += [(th, s, e, c["name"], c["many"], data[s : e + length]) for s, e in pieces]
            got = pd.DataFrame(out, columns=["th", "first", "last", "name", "many", "piece"])
            got.insert(0, "id", pd.array(ids, "Int64"))
            yield got

    with_text = texts.join(_few(ask, "asked").withColumns({"qid": F.col("doc.id"), "qth": F.col("doc.th")}).drop("doc"), F.col("id").eqNullSafe(F.col("qid")) & (F.col("th") == F.col("qth")))
    # rows that are equal all over ask for the same pieces
    pieces = with_text.select("id", "th", "text", "asked").mapInPandas(take, f"{KEY}, first int, last int, name long, many boolean, piece binary")
    single = F.xxhash64("piece")
    pieces = staged(pieces.select("id", "th", "first", "last", "name", "many", F.when(~F.col("many"), F.col("piece")).alias("piece"), F.when(F.col("many"), single).alias("h1"), F.when(F.col("many"), F.xxhash64(F.lit(1), "piece")).alias("h2")).dropDuplicates(["id", "th", "first", "last"]), "context-pieces")

    shards = max(1, -(-pieces.filter("not many").count() // SHARD_CONTEXTS))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        b = pd.concat(got, ignore_index=True)
        hits = repeated_windows([bytes(p) for p in b["piece"]], length)
        n = [len(x) for x in hits]
        flat = np.array([r for x in hits for r in x], np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(len(b)), n)
        first = b["first"].to_numpy()[row]
        yield pd.DataFrame({"id": b["id"].astype("Int64").take(row).array, "th": b["th"].to_numpy()[row], "start": first + flat[:, 0], "end": first + flat[:, 1] + length})

    edges = pieces.filter("not many").select("id", "th", "first", "name", "piece").repartition(shards, "name").mapInPandas(search, f"{KEY}, start int, end int")
    windows = pieces.filter("many").select("id", "th", "first", "h1", "h2")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    single = windows.join(twice, ["h1", "h2"], "left_semi").select("id", "th", F.col("first").alias("start"), (F.col("first") + length).alias("end"))
    spans = spans.unionByName(edges).unionByName(single)

    # spans that touch are one: a running maximum of ends within the document
    w = Window.partitionBy("id", "th").orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("start") > upto).cast("int"), F.lit(1)))
    spans = spans.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("id", "th", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, runs in zip(texts, spans, strict=True):
        data, at, parts = (t or "").encode(), 0, []
        for r in runs if runs is not None else ():
            parts.append(data[at : r["start"]])
            at = r["end"]
        out.append(b"".join([*parts, data[at:]]))
    return pd.Series(out, dtype=object)


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", spans: str = "spans", kept: str = "kept") -> DataFrame:
    """`docs` with the removed spans (array of start and end in bytes, empty if none) and the remaining bytes."""
    found = _few(staged(repeated_spans(docs, length, doc_id, text), "repeated-spans"), "spans")
    i, h, raw = fresh(docs, "repeat_id", "repeat_hash", "repeat_spans")
    found = found.select(F.col("id").alias(i), F.col("th").alias(h), F.col("spans").alias(raw))
    d = docs.join(found, F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (F.hash(docs[text]) == F.col(h)), "left")
    d = d.withColumns({spans: F.coalesce(raw, F.from_json(F.lit("[]"), "array<struct<start:int,end:int>>"))})
    return d.withColumn(kept, F.pandas_udf(_cut, "binary")(F.col(text), F.col(spans))).drop(i, h, raw)
