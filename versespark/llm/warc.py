"""WARC archives: write, read back, and merge capture indexes.

Writing: each page is one HTTP capture. Files are bounded by records and by bytes, as they are read back whole. Equal payloads are found by their SHA-1 in one partial aggregation (digest ->
largest id); the other copies become revisit records that name the kept response. Records are Spark text rows whose
line separator is the blank line pair that ends a WARC record, so Spark's own writer commits the files.

Reading: whole archive files are framed by Content-Length. The captures of a file, sorted by URL key, time and id, are
a local run. Runs are cut at common key ranges; within each range a loser tree merges the k runs, and the ranges
follow one another, so the whole is one globally ordered capture history. A URL with very many captures is split
between ranges by time and id.

Defined results: a null html is an empty payload; a null url has no target header and the empty URL key; a row without
id is never referred to; repeated rows are archived each; an empty table gives archives without records. Control
characters, spaces and "%" in a url are percent-encoded in the header and restored on reading.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import staging_dir
from .common import bounded_batches, small_enough, staged

#: Records of one archive file at most, and its bytes of payload: it is read back as a whole.
RECORDS_PER_FILE, FILE_BYTES = 500, 512 << 20
#: Captures of one key range of the merge.
RANGE_ROWS = 20_000
#: Captures get one date a second from here, in the order of their ids, where the caller has no date column.
BASE_DATE = "2020-01-01 00:00:00"

# Names of the WARC 1.1 format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, url_key string, captured string, file string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string: 40 bits of the digest are 8 letters."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to: the largest id with an equal payload if that is
    another row's and the payload has at least `min_bytes` bytes."""
    body = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    body = body.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = body.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    copies = staged(groups.filter("n > 1 and keeper is not null").drop("n"), "payload-copies")
    df = body.join(small_enough(copies), ["payload_digest", "payload_bytes"], "left")
    return df.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))).drop("keeper")


def record(captured: Column) -> Column:
    """A WARC record as text, without the blank lines that end it. Needs the columns of with_revisits."""
    c = F.col
    revisit = c("refers_to").isNotNull()
    # the HTTP head keeps the length of the full payload, for revisits too
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), c("payload_bytes").cast("string"), F.lit(END))
    url = c("url")
    for ch in ["%", *map(chr, range(0x21)), "\x7f"]:
        url = F.replace(url, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    url = F.when(c("url").rlike(r"[%\x00-\x20\x7f]"), url).otherwise(c("url"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(c("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(c("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("payload_digest"))),
        F.when(revisit, F.concat_ws("\r\n", line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), c("refers_to").cast("string"), F.lit(">"))))),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", length.cast("string")),
    )
    return F.concat(head, F.lit(END), http, F.when(revisit, "").otherwise(c("payload")))


def write_warc(pages: DataFrame, path: str, captured: str | None = None, min_bytes: int = 0) -> None:
    """Write `pages` (page_id, url, html and, if named, a timestamp column) as uncompressed WARC files."""
    df = with_revisits(pages, min_bytes=min_bytes)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(BASE_DATE)) + F.coalesce(F.col("page_id"), F.lit(0)) % 2_000_000_000)
    if captured is not None:
        dates = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(captured).alias("captured_at")).groupBy("page_id").agg(F.max("captured_at").alias("captured_at"))
        df = df.join(dates, "page_id", "left")
        at = F.coalesce(F.col("captured_at"), at)
    # files are cut by records, so long payloads go to files of their own with fewer records: a class for each octave
    least = FILE_BYTES // RECORDS_PER_FILE
    octave = F.greatest(F.lit(0), F.ceil(F.log2(F.col("payload_bytes") / least))).cast("int")
    rows = df.select(record(at).alias("value"), F.when(F.col("payload_bytes") > least, octave).otherwise(0).alias("octave"))
    sizes = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    octaves = range(max(0, math.ceil(math.log2(sizes / least))) + 1 if sizes > least else 1)
    for k in octaves:
        part = rows.filter(F.col("octave") == k) if len(octaves) > 1 else rows
        part.select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, RECORDS_PER_FILE >> k)).text(path)


def url_key(url: str) -> str:
    """The sort key of a url: host labels reversed, then path and query, lower-cased."""
    m = re.match(r"(?s)[^:/?#]+://([^/?#]*)(.*)", url)
    if not m:
        return url.lower()
    host = m[1].rpartition("@")[2].lower()
    name, _, port = host.partition(":")
    return f"{','.join(reversed(name.split('.')))}{':' + port if port else ''}){m[2].partition('#')[0].lower() or '/'}"


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        yield at, head, data[end + 4 : stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        at = stop + 4


def captures(data: bytes, file: str) -> list[tuple]:
    """Rows of INDEX and the payload (None for revisits) for each capture of an archive."""
    out = []
    for at, head, block in records(data):
        number = lambda v: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", v)) else None
        http, _, payload = block.partition(b"\r\n\r\n")
        full = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
        revisit = head["warc-type"] == "revisit"
        digest = head["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if not revisit and (len(payload) != full or f"sha1:{digest}" != head["warc-payload-digest"]):
            raise ValueError(f"the payload at byte {at} of {file} is not what its headers say")
        url = unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None
        out.append((number(head["warc-record-id"]), url, url_key(url or ""), head["warc-date"], file, at, full, digest, head["warc-type"], number(head.get("warc-refers-to", "")), None if revisit else payload))
    return out


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The capture index of the archives under `path`; with `payloads`, their payloads as well (null for revisits)."""
    names = [x.split()[0] for x in INDEX.split(", ")] + ["payload"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                got = pd.DataFrame(captures(data, file), columns=names)
                got = got.astype({"page_id": "Int64", "refers_to": "Int64"})
                yield got if payloads else got.drop(columns="payload")

    bounded_batches(spark, 4)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, INDEX + (", payload binary" if payloads else ""))


class LoserTree:
    """A tournament of k sorted runs: each inner node keeps the loser of its match, so that replacing the winner takes
    one match on each level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(self.k, 1)
        self.winner = self._play(1) if self.k else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, self.tree[node] = (a, b) if self._less(a, b) else (b, a)
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._less(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.winner = w


def natural_runs(keys: list[tuple]) -> list[list[int]]:
    """The ascending runs of a list, as lists of its places."""
    runs: list[list[int]] = []
    for i, k in enumerate(keys):
        if not runs or keys[runs[-1][-1]] > k:
            runs.append([])
        runs[-1].append(i)
    return runs


def merge_index(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of `index` in capture order (url_key, captured, page_id), with range_no and range_pos, their place in it."""
    keys = ["url_key", "captured", "page_id"]
    runs = staged(index.sortWithinPartitions(*keys), "capture-runs")
    n = max(1, -(-runs.count() // range_rows))
    bounded_batches(runs.sparkSession)  # index rows are short; files are read a few at a time

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if not got:
            return
        whole = pd.concat(got, ignore_index=True)
        ids = [-1 << 63 if v is None or pd.isna(v) else int(v) for v in whole["page_id"]]
        key = list(zip(whole["url_key"], whole["captured"], ids, range(len(whole)), strict=True))
        order = [k[-1] for k in LoserTree([iter([key[i] for i in r]) for r in natural_runs(key)])]
        out = whole.iloc[order].reset_index(drop=True)
        out["range_pos"] = range(len(out))
        yield out

    cut = runs.repartitionByRange(n, *keys)
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    return cut.mapInPandas(merge, f"{cols}, range_pos long").withColumn("range_no", F.spark_partition_id().cast("long"))


def with_positions(merged: DataFrame) -> DataFrame:
    """What merge_index() returns, with `history_pos`, the place of each capture in the whole history (from 1). Only the
    sizes of the ranges are summed up in order, one row for each of them."""
    merged = staged(merged, "capture-history")
    sizes = merged.groupBy("range_no").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(sizes.select("range_no", before.alias("start")), "range-starts")
    return merged.join(small_enough(starts), "range_no").withColumn("history_pos", F.col("start") + F.col("range_pos") + 1).drop("start")


def archive_folder(spark: SparkSession) -> str:
    return f"{staging_dir(spark)}/warc-{uuid.uuid4().hex}"
