import hashlib
import re

from pyspark.sql import functions as F

from riskstream.llm import sketch

from .conftest import edge_rows, rows


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    shingles = [" ".join(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [" ".join(words)] * bool(words)
    return sorted(h for h in {hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles} if h < "4")


def test_against_brute_force(edges):
    rows_ = sorted(((i, t or "") for i, t, *_ in edge_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(rows_):
        after = rows_[(k + 1) % len(rows_)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), ",".join(brute(t)), ",".join(brute(edited))))
    got = rows(sketch.fingerprints(edges))
    equal = [r[:5] for r in got] == sorted(want, key=repr)  # very long strings: not for pytest to compare
    assert equal
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in got)


def test_containment_of_a_part(make):
    whole = " ".join(f"t{i}" for i in range(6000))
    docs = make([" ".join(f"t{i}" for i in range(1500)), whole])
    d = sketch.with_sketch(docs, "text", "fp")
    a, b = (r.fp for r in d.orderBy("doc_id").collect())
    pair = d.sparkSession.createDataFrame([(a, b)], "a array<string>, b array<string>")
    r = sketch.with_likeness(sketch.with_likeness(pair, "a", "b", "part"), "b", "a", "all_of").first()
    assert r.part == 1 and abs(r.all_of - 0.25) < 0.04
    assert 1400 < len(b) < 1600


def test_merge_is_the_sketch_of_the_union(make):
    left, right = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("l", 900), ("r", 30)))
    d = sketch.with_sketch(make([left, right]), "text", "fp").orderBy("doc_id")
    a, b = (r.fp for r in d.collect())
    merged = d.sparkSession.createDataFrame([(a, b)], "a array<string>, b array<string>").select(
        F.expr(sketch.merge_sketches("a", "b")).alias("m")).first().m
    assert merged == sorted(set(brute(left)) | set(brute(right)))


def test_many_ranges_of_uneven_ids(spark):
    """Few ranges, more ranges than ids, and ids that lie far apart."""
    ids = sorted({(i * i * i) % 10_007 - 5_000 for i in range(300)} | {10 ** 15, -10 ** 15, 2 ** 62})
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("3", "500"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = {r.doc_id: r.next_text for r in sketch.with_next(docs, ["fp"]).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == {i: f"text {ids[k - 1]}" for k, i in enumerate(ids)}


def test_range_of_an_id(spark):
    cuts = [i * 7 for i in range(80_000)]
    part, top = sketch._range_of("id", cuts)
    d = spark.range(0, 7 * 79_999, 6_007).selectExpr("id", f"{part} AS part", f"{top} AS top").collect()
    assert all(r.part == -(-r.id // 7) and r.top == 7 * r.part for r in d)


def test_other_tables(clashing, edges, nothing):
    equal = rows(sketch.fingerprints(clashing)) == rows(sketch.fingerprints(edges))
    assert equal
    assert sketch.fingerprints(nothing).count() == 0
