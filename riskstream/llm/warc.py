"""WARC archives of captures, and a globally ordered index of them by external merging.

Writing: one record per capture, ``response`` for the first capture of a payload and ``revisit`` for the others. Spark's
text writer puts the records down with the line separator CR LF CR LF, which is exactly what ends a WARC record, so the
part files are plain WARC files, written through the cluster's file system and commit protocol.

Reading: each archive file is read as bytes and parsed by its Content-Length headers; payload digests are computed anew
and compared. Its captures, sorted by URL key, time and page, are one run. Runs are cut at common splitters (from a
sample of the keys whose size follows the number of ranges) into short sorted blocks; the blocks of a range meet in one
task in the order of their first keys, and a loser tree merges them, holding one open block per run. The result is in
global order: by range, and within a range by position.

Defined results: null html is an empty payload; a null url gives no target header and the empty URL key, and sorts first;
rows with the smallest ``page_id`` of their payload are all responses, also when the row is repeated; a null ``page_id``
comes after all others, is written as an empty id and read back as null. Control characters and spaces of a url are
percent-encoded. Empty tables give empty archives and an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.llm.common import checkpoint_path, materialize, partitions, ship_package

CRLF = "\r\n"
END = b"\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

FILE_BYTES = 16 << 20  # of html in an archive file, about
RANGE_ROWS = 100_000  # captures of a range, about; more where that would give more ranges than 4 x shuffle partitions
SAMPLE, SAMPLED = 64, 1 << 20  # sampled keys for each splitter, and for all of them at most
BLOCK_ROWS = 512

CAPTURE = ("page_id long, url_key string, captured long, record_type string, payload_bytes long, payload_digest string, "
           "refers_to long, file string, offset long, length long")
FIELDS = [c.split()[0] for c in CAPTURE.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: each five hex digits are four base32 digits."""
    h = F.sha1(payload.cast("binary"))
    quads = [F.lpad(F.lower(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), DIGITS32.lower(), BASE32)


def _encoded(url: Column) -> Column:
    for code in (*range(0x00, 0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def records(pages: DataFrame, captured: Column, min_bytes: int = 0) -> DataFrame:
    """(record) of each page: headers and block, without the closing CR LF CR LF."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), captured.alias("at"))
    p = p.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html")))
    firsts = materialize(p.where(F.col("bytes") >= min_bytes).groupBy("digest")
                         .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
                         .where("n > 1").select(F.col("digest").alias("first_digest"), "first_id"), "warc-firsts")
    p = p.join(firsts, (F.col("digest") == F.col("first_digest")) & (F.col("bytes") >= min_bytes), "left")
    revisit = F.col("first_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def page(c):
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF * 2))
    p = p.withColumn("revisit", revisit).withColumn(
        "block", F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html"))))
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), page("page_id")),
        F.concat(F.lit("WARC-Date: "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), _encoded(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), page("first_id"), F.lit(
            f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))
    return p.select(F.concat(head, F.lit(CRLF * 2), F.col("block")).alias("record"), "bytes")


def write_archives(pages: DataFrame, captured: Column, path: str, min_bytes: int = 0) -> None:
    """Write the pages' records as WARC files of about ``FILE_BYTES`` below ``path``."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 1
    (records(pages, captured, min_bytes).select("record").write
     .option("lineSep", CRLF * 2).option("maxRecordsPerFile", int(max(1, FILE_BYTES // max(1, mean)))).text(path))


def url_key(url: str) -> str:
    """Host labels in reverse order, then path and sorted query; without scheme, ``www.`` and fragment."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.lower().removeprefix("www.")
    path, mark, query = path.partition("?")
    query = "&".join(sorted(query.split("&")))
    return ",".join(reversed(host.split("."))) + ")" + slash + path + mark + query if url else ""


def parse(content: bytes, name: str) -> list[tuple]:
    """The captures of one archive file, in file order."""
    from datetime import datetime, timezone

    at, out = 0, []
    while at < len(content):
        head_end = content.index(END, at)
        lines = content[at:head_end].decode().split(CRLF)
        head = dict(x.split(": ", 1) for x in lines[1:])
        start = head_end + 4
        stop = start + int(head["Content-Length"])
        if lines[0] != "WARC/1.1" or content[stop:stop + 4] != END:
            raise ValueError(f"{name}: bad record at byte {at}")
        http_end = content.index(END, start) + 4
        size = int(content[start:http_end].rsplit(b"Content-Length: ", 1)[1])
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response":
            payload = content[http_end:stop]
            if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{name}: wrong digest at byte {at}")

        def page(field):
            text = head.get(field, "").removeprefix("<urn:page:").removesuffix(">")
            return int(text) if text else None

        date = datetime.strptime(head["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
        out.append((page("WARC-Record-ID"), url_key(head.get("WARC-Target-URI", "")), int(date.timestamp()), kind, size,
                    digest, page("WARC-Refers-To"), name, at, stop + 4 - at))
        at = stop + 4
    return out


def order_key(c: tuple) -> tuple:
    """Captures are ordered by URL key (as bytes), time and page, null pages last."""
    return (c[1].encode(), c[2], c[0] is None, c[0] or 0)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            rows = sorted(parse(bytes(content), path.rsplit("/", 1)[-1]), key=order_key)
            if rows:
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=FIELDS)
    return f.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archive files below ``path``; those of a file are sorted and lie together."""
    ship_package(spark)
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
            .mapInPandas(_runs, CAPTURE))


class LoserTree:
    """Tournament of sorted iterators: each inner node holds the loser of its match, so taking the smallest item and
    replacing it costs one match a level. Sources can be added; an ended one leaves its slot to the next."""

    def __init__(self):
        self.size, self.heads, self.rest = 1, [None], [None]
        self.free, self.losers, self.winner = [0], [0], 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[0] <= y[0])

    def _replay(self, slot: int) -> None:
        node = (slot + self.size) // 2
        while node:
            if self._beats(self.losers[node], slot):
                self.losers[node], slot = slot, self.losers[node]
            node //= 2
        self.winner = slot

    def _rebuild(self) -> None:
        self.losers, won = [0] * self.size, [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = won[1] if self.size > 1 else 0

    def add(self, source: Iterator) -> None:
        """source: of (key, item) in key order."""
        if not self.free:
            self.free = list(range(self.size, 2 * self.size))
            self.heads += [None] * self.size
            self.rest += [None] * self.size
            self.size *= 2
        slot = self.free.pop()
        self.rest[slot], self.heads[slot] = source, next(source, None)
        self._rebuild()  # a new source is no winner's successor: its slot may hold any match's outcome

    def smallest(self):
        return self.heads[self.winner]

    def pop(self):
        slot = self.winner
        top = self.heads[slot]
        self.heads[slot] = next(self.rest[slot], None)
        if self.heads[slot] is None:
            self.rest[slot] = None
            self.free.append(slot)
        self._replay(slot)
        return top[1]


def merge_blocks(blocks: Iterator[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted, non-empty blocks that come in the order of their first items: a block is opened when the merge
    reaches its first item, so of each run no more than one block is open, but for equal items."""
    tree = LoserTree()
    for block in blocks:
        first = order_key(block[0])
        while tree.smallest() is not None and tree.smallest()[0] < first:
            yield tree.pop()
        tree.add(iter([(order_key(c), c) for c in block]))
    while tree.smallest() is not None:
        yield tree.pop()


BLOCK = f"part int, first binary, first_at long, first_page long, captures array<struct<{CAPTURE.replace(' ', ':').replace(',:', ', ')}>>"


def _tuples(f: pd.DataFrame) -> list[tuple]:
    plain = f.astype({"page_id": object, "refers_to": object})
    return list(plain.where(plain.notna(), None).itertuples(index=False, name=None))


def _int(c: tuple) -> tuple:
    return (None if c[0] is None else int(c[0]), *c[1:6], None if c[6] is None else int(c[6]), *c[7:])


def _cutter(splitters: list[tuple]):
    from bisect import bisect_right

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            rows = [_int(c) for c in _tuples(b)]
            for (_, part), group in groupby(rows, key=lambda c: (c[7], bisect_right(splitters, order_key(c)))):
                group = list(group)
                for i in range(0, len(group), BLOCK_ROWS):
                    block = group[i:i + BLOCK_ROWS]
                    out.append((part, block[0][1].encode(), block[0][2],
                                2 ** 63 - 1 if block[0][0] is None else block[0][0],
                                [dict(zip(FIELDS, c)) for c in block]))
            yield pd.DataFrame(out, columns=["part", "first", "first_at", "first_page", "captures"])

    return cut


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def blocks():
        for b in batches:
            for part, captures in zip(b["part"], b["captures"]):
                yield part, [_int(tuple(c[k] for k in FIELDS)) for c in captures]

    for part, group in groupby(blocks(), key=lambda x: x[0]):
        rows, at = [], 0
        for c in merge_blocks(x[1] for x in group):
            rows.append(c)
            if len(rows) == 4096:
                yield _frame(rows).assign(part=part, position=range(at, at + len(rows)))
                at, rows = at + len(rows), []
        if rows:
            yield _frame(rows).assign(part=part, position=range(at, at + len(rows)))


def merged_index(runs: DataFrame) -> DataFrame:
    """The captures of ``runs`` with part and position, their place in the global order."""
    spark = runs.sparkSession
    ship_package(spark)
    n = runs.count()
    parts = max(1, min(n // RANGE_ROWS, 4 * partitions(spark)))
    splitters = []
    if parts > 1:
        share = min(1.0, min(SAMPLE * parts, SAMPLED) / n)
        keys = sorted(order_key((r.page_id, r.url_key, r.captured)) for r in
                      runs.where(F.pmod(F.xxhash64("file", "offset"), F.lit(1 << 30)) < int(share * (1 << 30)))
                      .select("page_id", "url_key", "captured").collect())
        splitters = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    blocks = (runs.mapInPandas(_cutter(splitters), BLOCK).repartitionByRange(max(1, len(splitters) + 1), "part")
              .sortWithinPartitions("part", "first", "first_at", "first_page"))
    return blocks.select("part", "captures").mapInPandas(_merge, f"{CAPTURE}, part int, position long")


def archive(pages: DataFrame, captured: Column, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and merge their index."""
    spark = pages.sparkSession
    path = checkpoint_path(spark, "warc")
    write_archives(pages, captured, path, min_bytes)
    return merged_index(materialize(read_runs(spark, path), "warc-runs"))
