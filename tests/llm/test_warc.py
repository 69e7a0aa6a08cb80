import base64
import hashlib
import random

from pyspark.sql import functions as F

from riskstream.llm import warc as W
from riskstream.llm.common import checkpoint_path

from .conftest import rows

PAGES = "page_id long, url string, html string"
ROWS = [(5, "http://www.Example.org/b?y=2&x=1#f", "same"), (3, "https://example.org/b?x=1&y=2", "same"),
        (4, "http://example.org/a", "a\r\n\r\nb WARC/1.1\r\n\r\n"), (9, None, None), (8, "http://example.org/é x\r\ny", ""),
        (7, "http://example.org/a", "日本" * 500), (3, "https://example.org/b?x=1&y=2", "same"), (None, "http://z.org", "same"),
        (None, "http://z.org/2", "alone")]


def at():
    return F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1_700_000_000)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_and_order(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    got = W.archive(pages, at()).collect()
    first = {"same": 3, "": 8}
    want = []
    for i, _, html in ROWS:
        to = first.get(html or "")
        again = to is not None and to != i
        want.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response", to if again else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == \
        sorted(want, key=repr)
    keys = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0) for r in
            sorted(got, key=lambda r: (r.part, r.position))]
    assert keys == sorted(keys)
    assert sum(r.url_key == "org,example)/b?x=1&y=2" for r in got) == 3


def test_min_bytes_keeps_small_payloads_apart(spark):
    got = W.archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES), at(), 3)
    assert [r.record_type for r in got.orderBy("page_id").collect()] == ["response", "response", "response", "revisit"]


def test_files_are_plain_warc(spark):
    path = checkpoint_path(spark, "warc-test")
    W.write_archives(spark.createDataFrame(ROWS, PAGES).coalesce(1), at(), path)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).first().content
    for page in W.parse(bytes(content), "f"):
        record = bytes(content)[page[8]:page[8] + page[9]]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")


def test_loser_tree_merges_many_runs(monkeypatch):
    rng = random.Random(3)
    runs = [sorted([(rng.randrange(40), f"k{rng.randrange(9)}", rng.randrange(5), "response", 0, "", None, str(n), i, 1)
                    for i in range(rng.randrange(30))], key=W.order_key) for n in range(37)]
    blocks = sorted((r[i:i + 4] for r in runs for i in range(0, len(r), 4)), key=lambda b: W.order_key(b[0]))
    merged = list(W.merge_blocks(iter(blocks)))
    assert sorted(merged) == sorted(c for r in runs for c in r)
    assert [W.order_key(c) for c in merged] == sorted(W.order_key(c) for c in merged)
    assert list(W.merge_blocks(iter([]))) == []


def test_ranges_join_up(spark, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ROWS", 50)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("id") % 7).alias("url"),
                                    F.lit("x").alias("html"))
    got = sorted(W.archive(pages.repartition(6), at()).collect(), key=lambda r: (r.part, r.position))
    keys = [(r.url_key, r.captured) for r in got]
    assert len(got) == 400 and keys == sorted(keys) and len({r.part for r in got}) > 1


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], PAGES)
    assert W.archive(empty, at()).count() == 0
    extra = spark.createDataFrame([(*r, "digest!", "bytes!", "record!") for r in ROWS], f"{PAGES}, digest string, bytes string, record string")
    take = ["page_id", "payload_digest", "record_type", "refers_to"]
    equal = rows(W.archive(extra, at()).select(take)) == rows(W.archive(spark.createDataFrame(ROWS, PAGES), at()).select(take))
    assert equal
