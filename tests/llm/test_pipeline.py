import __spark_entry__ as E
import corpus_pipeline as P
from riskstream.llm import mixing, partenum, pieces, quality, secrets
from riskstream.llm.common import BATCH_SETTING, materialize
from riskstream.llm.queries import QUERIES, vocabulary
from riskstream.session import path_exists

from .conftest import rows

SF = "/root/testdata/sf0.001"


def test_registered():
    names = sorted(n for n in E.queries() if n.startswith("op"))
    assert [f"op{i}" for i in range(1, 14)] == sorted((n.split("_")[0] for n in names), key=lambda n: int(n[2:]))
    assert "pipeline" in E.queries() and set(QUERIES) <= set(E.queries())


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.join(quality.rules(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns).persist()
    first = partenum.classes(kept)
    single = kept.join(first.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns).persist()
    clean = secrets.redacted(single).persist()
    taken = mixing.mix(clean).where("taken > 0").selectExpr("doc_id", "taken div size as times")
    mixed = clean.join(taken, "doc_id").selectExpr("doc_id", "text", "explode(sequence(1, cast(times as int))) as copy")
    want = pieces.encoded(mixed, vocabulary("piece_bpe_32k.model"))
    got = P.run(spark, SF)
    equal = rows(got) == rows(want) and got.count() > 50
    assert equal
    assert [c for c in kept.columns] == docs.columns


def test_stages_keep_columns_and_take_nothing(spark, edges, clashing, nothing):
    for docs in (edges, clashing, nothing):
        for name, stage in P.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns, name
        assert P.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "ids"]
    for _, stage in P.STAGES:
        assert stage(spark, nothing, SF).count() == 0


def test_last_stage_is_named_as_dealt():
    assert P.STAGES[-1][0] == "SentencePiece encoding and decoding"


def test_a_stage_deletes_what_the_one_before_read(spark, edges):
    out = P.quality_rules(spark, edges, SF)
    tables = [t.materialized_path for t in out.read_tables]
    P.near_duplicates(spark, out, SF)  # not written yet: it is still read
    assert all(path_exists(spark, p) for p in tables)
    written = materialize(out, "stage-test")
    again = P.near_duplicates(spark, written, SF)
    assert not any(path_exists(spark, p) for p in tables) and again.count() <= written.count()


def test_stages_lower_the_batches_and_the_run_puts_them_back(spark):
    before = spark.conf.get(BATCH_SETTING)
    try:
        for _, stage in P.STAGES:
            spark.conf.set(BATCH_SETTING, "20000")
            stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(3), SF)
            assert int(spark.conf.get(BATCH_SETTING)) == P.ROWS or stage is P.mix_sources  # which has no Python
        spark.conf.set(BATCH_SETTING, "20000")
        P.run(spark, SF)
        assert spark.conf.get(BATCH_SETTING) == "20000"
    finally:
        spark.conf.set(BATCH_SETTING, before)
