"""Event-log state operators: blacklist set, review queue ordering, partial upsert, insert-ignore."""

from riskstream.operators import feedback, state


def test_blacklist_log(spark):
    ops = spark.createDataFrame(
        [(1, "add", "a"), (2, "add", "b"), (3, "remove", "a"), (4, "clear", None), (5, "add", "c"),
         (6, "remove", "zzz"), (7, "add", "d")], "seq long, op string, value string")
    assert sorted(r[0] for r in state.set_from_log(ops).collect()) == ["c", "d"]


def test_review_queue_order(spark):
    ev = spark.createDataFrame(
        [("t1", 1, "item", 0.5), ("t2", 2, "item", 0.4), ("t1", 3, "item", 0.6), ("t2", 4, "review", None),
         ("t3", 5, "item", 0.3), ("t2", 6, "item", 0.7)], "transaction_id string, seq long, kind string, score double")
    page = feedback.review_page(feedback.review_queue(ev), limit=50)
    rows = page.collect()
    assert [r["transaction_id"] for r in rows] == ["t1", "t3", "t2"]
    assert rows[0]["score"] == 0.6  # newer payload, original position


def test_partial_upsert(spark):
    ch = spark.createDataFrame(
        [("k1", "u1", 1.0, "M1", 1), ("k1", "u2", 2.0, "M2", 2), ("k1", "u3", 3.0, "M3", 3), ("k2", "u9", 9.0, "M9", 2),
         ("k3", "u5", 5.0, "M5", 1)], "transaction_id string, user_id string, amount double, merchant_id string, seq int")
    out = {r["transaction_id"]: r for r in state.upsert_partial(ch, "transaction_id", ["user_id", "amount"]).collect()}
    assert (out["k1"]["user_id"], out["k1"]["amount"], out["k1"]["merchant_id"]) == ("u3", 3.0, "M1")
    assert out["k2"]["merchant_id"] == "M9" and out["k3"]["n_versions"] == 1


def test_insert_ignore(spark):
    old = spark.createDataFrame([("v1.0", "seed")], "version string, notes string")
    new = spark.createDataFrame([("v1.0", "new"), ("v2.0", "new")], "version string, notes string")
    out = dict(state.insert_ignore(old, new, "version").collect())
    assert out == {"v1.0": "seed", "v2.0": "new"}


def test_review_page_bounds(spark):
    import pytest

    ev = spark.createDataFrame([("t1", 1, "item", 0.5)], "transaction_id string, seq long, kind string, score double")
    with pytest.raises(ValueError):
        feedback.review_page(feedback.review_queue(ev), limit=501)


def test_submit_feedback_flow(spark):
    import datetime as dt
    import json

    t = dt.datetime(2024, 1, 2)
    fb = spark.createDataFrame([("f1", "t1", "a", "true_positive", "", t), ("f2", "t9", "a", "bogus", "", t)],
                               "feedback_id string, transaction_id string, analyst_id string, verdict string, "
                               "notes string, created_at timestamp_ntz")
    res = spark.createDataFrame([("t1", 0.9, "v2.0")], "transaction_id string, score double, model_version string")
    rows, msgs, deq = feedback.submit_feedback(fb, res)
    r = rows.first()
    assert rows.count() == 1 and r["original_score"] == 0.9 and r["original_model_version"] == "v2.0"
    m = msgs.first()
    assert m["key"] == "t1" and json.loads(m["value"])["verdict"] == "true_positive"
    assert [x["kind"] for x in deq.collect()] == ["review"]


def test_entity_coercion(spark):
    from riskstream.sources import io

    df = spark.createDataFrame([("f1", "t1", "x", "true_positive", None)],
                               "feedback_id string, transaction_id string, analyst_id string, verdict string, notes string")
    r = io.coerce(df, "analyst_feedback").first()
    assert r["notes"] == "" and r["original_score"] == 0.0 and r["original_model_version"] == "unknown"
    e = io.coerce(spark.createDataFrame([("e1", "abc")], "experiment_id string, traffic_split string"), "ab_experiment").first()
    assert e["traffic_split"] is None and e["end_date"] is None
