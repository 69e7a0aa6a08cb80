"""Structured Streaming twins of the velocity / scoring path.

One streaming aggregate serves all four dimensions (one state store). Sinks are written per
micro-batch into a directory named by the batch id with overwrite, so a replayed batch after a
failure rewrites the same files (idempotent; with the model state below it also computes the same rows);
the current table is the latest row per key across batches, compacted into a keyed table every few batches.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.config import EngineConfig
from riskstream.functions import EPOCH_NTZ, money, to_ntz
from riskstream.operators import iforest
from riskstream.operators.scoring import score_alerts
from riskstream.operators.velocity import ALERT_COLS, DIMENSIONS, alert_filter
from riskstream.session import checkpoint_dir
from riskstream.sources import files, io
from riskstream.sources.fixtures import transactions_from_events
from riskstream.sources.keyed_table import KeyedTable

ALERT_KEYS = ["dimension", "dimension_key", "window_start"]


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """A1 test twin: the driver's events table as a file stream (the Kafka source plugs in the same
    way: ``readStream.format('kafka')`` then ``from_json`` with the TRANSACTION schema)."""
    schema = spark.read.parquet(f"{sf_dir}/events*.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{sf_dir}/events*.parquet")


def kafka_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A1/A2: the messages of a topic as text (needs the Kafka connector on the classpath)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value")))


def kafka_transactions(spark: SparkSession, servers: str, topic: str) -> tuple[DataFrame, DataFrame]:
    """A1: transactions and dead letters of the transaction topic; both are streams of their own."""
    return io.transactions_of(kafka_lines(spark, servers, topic))


def kafka_alerts(spark: SparkSession, servers: str, topic: str) -> tuple[DataFrame, DataFrame]:
    """A2: velocity alerts and dead letters of the alert topic."""
    return io.alerts_of(kafka_lines(spark, servers, topic))


def json_sink(path: str, key: str, order: str | None = None):
    """foreachBatch writer of keyed JSON messages, one folder a batch (idempotent replay). With ``order``, a column,
    the files of a batch are ranges of (key, order) in the order of their names: read one after the other they give the messages
    of every key in order, and those of a hot key lie in several files."""

    def write(df: DataFrame, batch_id: int) -> None:
        out = df
        if order:
            out = df.repartitionByRange(key, order).sortWithinPartitions(key, order)
        io.encode_json(out, key).write.mode("overwrite").json(f"{path}/batch_id={batch_id}")

    return write


def append_sink(path: str, partition_by: tuple = ()):
    """foreachBatch writer that inserts rows into an append-only table, partitioned by columns of theirs; a replayed batch
    replaces what it had inserted (:func:`riskstream.sources.io.append`)."""

    def write(df: DataFrame, batch_id: int) -> None:
        io.append(df, path, partition_by, batch_id)

    return write


def distinct_transactions(tx: DataFrame, cfg: EngineConfig, watermark: str | None = None) -> DataFrame:
    """A stream of transactions in which each id counts once within the watermark, whatever batches its copies are in and
    also after a restart: the ids of that time are kept as state. Messages without an id are dropped: nothing tells them apart."""
    t = tx.where("transaction_id is not null").withColumn("_at", event_instant("event_time"))
    return t.withWatermark("_at", watermark or cfg.watermark).dropDuplicatesWithinWatermark(["transaction_id"])


def velocity_updates(tx: DataFrame, cfg: EngineConfig, watermark: str | None = None) -> DataFrame:
    """Watermarked tumbling-window aggregate over the exploded dimensions (event time)."""
    if "_at" in tx.columns:  # of distinct_transactions, with its watermark
        t = tx.withColumnRenamed("_at", "event_ts")
    else:
        t = tx.withColumn("event_ts", event_instant("event_time")).withWatermark("event_ts", watermark or cfg.watermark)
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("dimension_key")) for d, c in DIMENSIONS])
    rows = t.select("event_ts", "amount", F.inline(pairs)).where(
        F.col("dimension_key").isNotNull() & (F.col("dimension_key") != ""))
    agg = rows.groupBy(F.window("event_ts", cfg.window).alias("w"), "dimension", "dimension_key").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum(money("amount")).alias("_sum"))
    return agg.select(
        "dimension", F.lit(cfg.window_label).alias("window_size"), "dimension_key", "txn_count",
        F.col("_sum").cast("double").alias("total_amount"),
        F.unix_millis(F.col("w.start")).alias("window_start"), F.unix_millis(F.col("w.end")).alias("window_end"))


def event_instant(col: str) -> Column:
    """Wall-clock (UTC) timestamp_ntz to a TIMESTAMP instant, independent of the session time zone;
    watermarks need TIMESTAMP."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", EPOCH_NTZ(), to_ntz(col)))


def batch_sink(path: str, partition_by: list[str] | None = None):
    """foreachBatch writer: batch ``b`` goes to ``path/batch_id=b`` with overwrite (idempotent replay)."""

    def write(df: DataFrame, batch_id: int) -> None:
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path}/batch_id={batch_id}")

    return write


def latest_by_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current table of an update-mode changelog sink: the latest batch's row per key."""
    return _latest(spark.read.parquet(path), keys).drop("batch_id")


def _latest(log: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in log.columns if c not in keys and c != "batch_id"]
    agg = log.groupBy(*keys).agg(F.max_by(F.struct("batch_id", *cols), "batch_id").alias("_v"))
    return agg.select(*keys, "_v.*")


@dataclass
class ChangelogTable:
    """The current table of an update-mode changelog, whose reading costs its current rows and the last few batches.

    Batches are folders of a log. When ``every`` of them are open, they are merged into a keyed table, in one commit that
    carries the last one's id as its mark; the log counts from the mark on, whatever else lies in it, so a crash between any
    two steps leaves the same table. What a merge replaces is removed at the next one, so readers have that long to finish."""

    path: str
    keys: list[str]
    every: int = 8
    buckets: int = 64

    def _base(self, spark: SparkSession) -> KeyedTable | None:
        return KeyedTable.open(spark, f"{self.path}/base") if files.names(spark, f"{self.path}/base/commits") else None

    def _open_batches(self, spark: SparkSession, base: KeyedTable | None) -> list[int]:
        mark = -1 if base is None or base.batch is None else base.batch
        return [b for b in batch_ids(spark, f"{self.path}/log", "_SUCCESS") if b > mark]

    def _log(self, spark: SparkSession, ids: list[int]) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/log").parquet(*[f"{self.path}/log/batch_id={b}" for b in ids])

    def write(self, df: DataFrame, batch_id: int) -> None:
        """foreachBatch writer."""
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{self.path}/log/batch_id={batch_id}")
        base = self._base(spark)
        ids = self._open_batches(spark, base)
        if len(ids) < self.every:
            return
        if base is None:
            base = KeyedTable.create(spark, f"{self.path}/base", df.schema, self.keys,
                                     [c for c in df.columns if c not in self.keys], self.buckets)
        else:
            base.vacuum()
            for b in batch_ids(spark, f"{self.path}/log"):
                if b < ids[0]:
                    files.delete(spark, f"{self.path}/log/batch_id={b}")
        base.merge(self._log(spark, ids), seq="batch_id", batch_id=ids[-1])

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The latest row of every key; None if no batch was written."""
        base = self._base(spark)
        ids = self._open_batches(spark, base)
        if not ids:
            return None if base is None else base.read().drop("n_versions")
        new = _latest(self._log(spark, ids), self.keys).drop("batch_id")
        if base is None:
            return new
        return base.read().drop("n_versions").join(new.select(*self.keys), self.keys, "left_anti").select(*new.columns).unionByName(new)


def run_available(query_df: DataFrame, sink, checkpoint: str, mode: str = "update"):
    """Run a streaming query over everything available now, then stop (tests and backfills)."""
    q = (query_df.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_velocity_windows(spark: SparkSession, sf_dir: str, cfg: EngineConfig, mode: str = "update",
                            alerts_only: bool = False, work: str | None = None, max_files: int | None = None,
                            every: int = 8) -> DataFrame:
    """I1-I3 end to end: events stream -> transactions -> windowed aggregate -> changelog sink; returns
    the current table (latest update per window)."""
    base = work or f"{checkpoint_dir(spark).rstrip('/')}/stream-velocity-{uuid.uuid4().hex[:12]}"
    tx = transactions_from_events(events_stream(spark, sf_dir, max_files))
    upd = velocity_updates(tx, cfg)
    if alerts_only:
        upd = alert_filter(upd, cfg)
    table = ChangelogTable(f"{base}/sink", ALERT_KEYS, every, 16)
    run_available(upd, table.write, f"{base}/checkpoint", mode)
    current = table.read(spark)
    if current is None:  # no micro-batch: empty table
        current = spark.createDataFrame([], upd.schema)
    return current.select(*ALERT_COLS)


def batch_ids(spark: SparkSession, path: str, done: str = "") -> list[int]:
    """The batch ids of the folders ``path/batch_id=N`` that have ``done`` in them, in order."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*/{done}".rstrip("/"))
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(str(f.getPath()).split("batch_id=")[1].split("/")[0]) for f in found or [])


@dataclass
class ModelState:
    """I8/K5: online model policy across micro-batches (fit on earlier batches, score the current).

    After every batch a folder by its id holds the pool of the history so far (:func:`iforest.pool_of`: all rows, or about
    8 x trees x psi of them by hash) and the number of rows seen; ``meta`` is written last and makes it valid. The pool comes
    from the batch and the pool before it, so a trigger and a refit read and write a bounded number of rows however long the
    history is, and the trees are those of a fit over all of it. Models go to folders of their own in the same way. Batch
    ``b`` is scored by the newest model of a batch before it, and neither models nor pools depend on how often it ran."""

    cfg: EngineConfig
    features_path: str
    model_path: str
    _loaded: dict = field(default_factory=dict)

    def model_before(self, spark: SparkSession, batch_id: int) -> iforest.Forest | None:
        """The model that scores batch ``batch_id``."""
        ids = [i for i in batch_ids(spark, self.model_path, "meta/_SUCCESS") if i < batch_id]
        if not ids:
            return None
        path = f"{self.model_path}/batch_id={ids[-1]}"
        if ids[-1] not in self._loaded:
            self._loaded = {ids[-1]: iforest.Forest.load(path, spark)}
        return self._loaded[ids[-1]]

    def seen(self, spark: SparkSession, last: int) -> int:
        """Alerts in the batches up to ``last``."""
        ids = [i for i in batch_ids(spark, self.features_path, "meta/_SUCCESS") if i <= last]
        return spark.read.parquet(f"{self.features_path}/batch_id={ids[-1]}/meta").first()["n"] if ids else 0

    def samples(self, spark: SparkSession, first: int, last: int) -> int:
        """Alerts in the batches from ``first`` to ``last``."""
        return self.seen(spark, last) - self.seen(spark, first - 1)

    def pool(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{self.features_path}/batch_id={batch_id}/pool")

    def observe(self, spark: SparkSession, alerts: DataFrame, batch_id: int) -> None:
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in ALERT_KEYS], F.lit(str(batch_id)))
        feats = iforest.alert_features(alerts).select(key.alias("_k"), *iforest.FEATURES)
        here = f"{self.features_path}/batch_id={batch_id}"
        feats.write.mode("overwrite").parquet(f"{here}/new")
        feats = spark.read.parquet(f"{here}/new")
        before = [i for i in batch_ids(spark, self.features_path, "meta/_SUCCESS") if i < batch_id]
        n = feats.count() + (self.seen(spark, before[-1]) if before else 0)
        rows = feats.unionByName(self.pool(spark, before[-1])) if before else feats
        iforest.pool_of(rows, "_k", self.cfg, n).write.mode("overwrite").parquet(f"{here}/pool")
        spark.createDataFrame([(n,)], "n long").write.mode("overwrite").parquet(f"{here}/meta")
        fitted = [i for i in batch_ids(spark, self.model_path, "meta/_SUCCESS") if i < batch_id]
        last = fitted[-1] if fitted else -1
        if iforest.should_retrain(n, self.samples(spark, last + 1, batch_id), bool(fitted), self.cfg):
            forest = iforest.fit_pool(self.pool(spark, batch_id), self.cfg, "_k", n)
            if forest is not None:
                self._loaded.pop(batch_id, None)
                forest.save(f"{self.model_path}/batch_id={batch_id}", spark)


def fit_features(feats: DataFrame, cfg: EngineConfig, key: str) -> iforest.Forest | None:
    """A forest fitted on rows that already have the K1 features."""
    rows = feats.select(key, F.col("txn_count_f").alias("txn_count"), F.col("total_amount_f").alias("total_amount"),
                        F.lit(0).cast("bigint").alias("window_start"),
                        (F.col("duration_min") * 60000).cast("bigint").alias("window_end"))
    return iforest.fit(rows, cfg, key)


def scoring_sink(spark: SparkSession, out_path: str, cfg: EngineConfig, blacklist_path: str | None = None,
                 rings_path: str | None = None, model: ModelState | None = None):
    """Score each micro-batch of alert updates with the static side re-read per batch and
    write scored rows partitioned by routing (block / review / allow sinks), idempotently by batch id."""

    def handle(alerts: DataFrame, batch_id: int) -> None:
        bl = spark.read.parquet(blacklist_path) if blacklist_path else None
        rings = spark.read.parquet(rings_path) if rings_path else None
        forest = model.model_before(spark, batch_id) if model is not None else None
        scored = score_alerts(alerts, cfg, blacklist=bl, user_rings=rings,
                              ml_scorer=forest.scorer() if forest is not None else None,
                              model_version=forest.version if forest is not None else None)
        flat = scored.select(*ALERT_COLS, "score", "routing", F.array_join("reasons", " | ").alias("reasons"),
                             "model_version")
        flat.write.mode("overwrite").partitionBy("routing").parquet(f"{out_path}/batch_id={batch_id}")
        if model is not None:
            model.observe(spark, alerts, batch_id)

    return handle


def retrain_trigger(spark: SparkSession, cfg: EngineConfig, feedback_path: str, events_path: str, refit):
    """Per trigger (processingTime = retrain_check_seconds), count the labels of the batches since the last
    retrain; at the threshold refit on them and, if that gave a model, write a retrain event.

    ``refit`` takes the labels (feedback rows) and returns a model or None. Labels are counted by the batch that brought
    them, not by the time they carry, so one that arrives late counts once, and the mark is the newest event of a batch
    before this one, so a replayed batch decides alike."""

    def handle(feedback: DataFrame, batch_id: int) -> None:
        feedback.write.mode("overwrite").parquet(f"{feedback_path}/batch_id={batch_id}")
        earlier = [i for i in batch_ids(spark, events_path, "_SUCCESS") if i < batch_id]
        labels = spark.read.parquet(feedback_path).where(
            F.col("batch_id").between((earlier[-1] if earlier else -1) + 1, batch_id)).drop("batch_id")
        agg = labels.agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("t")).first()
        if agg["n"] < cfg.feedback_retrain_threshold or refit(labels) is None:
            return
        ev = spark.createDataFrame(
            [("model_retrained", str(agg["t"]), int(agg["n"]), int(agg["n"]))],
            "event string, timestamp string, samples_used bigint, feedback_count bigint")
        ev.write.mode("overwrite").parquet(f"{events_path}/batch_id={batch_id}")

    return handle


def refit_on_labels(spark: SparkSession, tx_path: str, cfg: EngineConfig, model_path: str):
    """M4: a ``refit`` for :func:`retrain_trigger`: the forest of the labelled transactions' window features, saved."""
    from riskstream.operators.feedback import retrain_set

    def refit(labels: DataFrame) -> iforest.Forest | None:
        forest = fit_features(retrain_set(labels, spark.read.parquet(tx_path), None, cfg), cfg, "transaction_id")
        if forest is not None:
            forest.save(f"{model_path}/{forest.version}", spark)
        return forest

    return refit


def review_queue_sink(spark: SparkSession, log_path: str):
    """Append the micro-batch's review-queue events (items from the human-review stream,
    reviews from feedback) to an event log, idempotently by batch id; the pending queue is
    :func:`riskstream.operators.state.review_pending` over the log, computed when read."""

    def handle(events: DataFrame, batch_id: int) -> None:
        events.select("transaction_id", "seq", "kind", "score").write.mode("overwrite").parquet(
            f"{log_path}/batch_id={batch_id}")

    return handle


def pending_reviews(spark: SparkSession, log_path: str) -> DataFrame:
    from riskstream.operators.state import review_pending

    return review_pending(spark.read.parquet(log_path).drop("batch_id"))


#: Of a group of transactions, one entry for each in the first four lists; ``n_items`` of the last two are its arrivals.
REVIEW_STATE = ("ids array<string>, untils array<long>, last_reviews array<long>, n_items array<int>, "
                "item_seqs array<long>, item_scores array<double>")
REVIEW_OUT = "transaction_id string, pending boolean, position long, score double, last_seq long"


#: How late an event may be: for so long, in event time, the state of a transaction without pending items is kept.
REVIEW_TTL_MS = 30 * 86_400_000


#: Groups that transactions are dealt into; a group's state is read and written at once.
REVIEW_GROUPS = 1 << 12


def _review_step(key, pdfs, state):
    """Per group of transactions: fold this micro-batch's events into the states of their transactions, in any arrival order.

    A transaction's state = the last review's seq and the item arrivals after it (deduplicated by seq). A review drops
    the arrivals it covers; the queue position is the earliest remaining arrival and the payload the
    latest one — the batch operator's rule, so late, reordered or replayed events give the same result.
    The state holds only arrivals since the last review, and goes when nothing is pending and the newest event is
    ``REVIEW_TTL_MS`` old; a transaction that waits for review keeps its state however long that takes. The group's timeout is
    the earliest of its transactions'; those that are due are looked after whenever the group is called."""
    import pandas as pd

    now, held, at = state.getCurrentWatermarkMs(), {}, 0
    if state.exists:
        ids, untils, reviews, counts, seqs, scores = state.get
        for me, until, review, n in zip(ids, untils, reviews, counts):
            held[me] = [until, review, dict(zip(seqs[at:at + n], scores[at:at + n]))]
            at += n
    newest: dict = {}
    for pdf in () if state.hasTimedOut else pdfs:
        for me, seq, kind, score, ms in zip(*(pdf[c].tolist() for c in ("transaction_id", "seq", "kind", "score", "at_ms"))):
            mine = held.setdefault(me, [0, -1, {}])
            newest[me] = max(newest.get(me, -1), int(ms))
            if kind == "review":
                mine[1] = max(mine[1], int(seq))
            elif kind == "item":
                mine[2][int(seq)] = None if score != score else score  # NaN -> None
    due = max(now, min(v[0] for v in held.values()) + 1) if state.hasTimedOut else now
    rows = []
    for me, mine in list(held.items()):
        if me in newest:
            last = mine[1]
            order = sorted(k for k in mine[2] if k > last)
            mine[0] = max(newest[me], now) + 1  # the watermark is REVIEW_TTL_MS behind
            mine[2] = {k: mine[2][k] for k in order}
            rows.append((me, bool(order), order[0] if order else None, mine[2][order[-1]] if order else None,
                         order[-1] if order else last))
        elif mine[0] < due:
            if mine[2]:
                mine[0] = now + REVIEW_TTL_MS
            else:
                del held[me]
    if held:
        untils, reviews, items = zip(*held.values())
        state.update((list(held), list(untils), list(reviews), [len(x) for x in items],
                      [k for x in items for k in x], [v for x in items for v in x.values()]))
        state.setTimeoutTimestamp(max(min(untils), now))
    else:
        state.remove()
    if rows:
        yield pd.DataFrame(dict(zip(("transaction_id", "pending", "position", "score", "last_seq"),
                                    (pd.Series(c, dtype=object) for c in zip(*rows)))))


def review_queue_stateful(events: DataFrame, event_time: str | None = None, groups: int = REVIEW_GROUPS) -> DataFrame:
    """I6 as a stateful streaming operator: ``applyInPandasWithState`` keeps
    one small state per transaction (bounded, not per event; removed some time after its last review) and emits its queue status on every change
    (update mode). The pending queue is ``where(pending)`` ordered by position.

    Transactions are dealt by hash into ``groups`` groups, and a group is one call and one stored row: a call for each
    transaction would cost far more than its few events. About a thousand live transactions a group is a good size; a
    checkpoint keeps the number of groups that it was begun with.

    States expire in event time: that of the column ``event_time`` (a timestamp), or ``seq`` read as epoch milliseconds. Any
    other sequence needs the column, or its states would expire at once or never. An event that comes again, in another batch
    or after a restart, counts once: arrivals are kept by their sequence."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    from riskstream.session import ship_package

    ship_package(events.sparkSession)
    at = F.col(event_time) if event_time else F.timestamp_millis(F.col("seq").cast("long"))
    e = events.select("transaction_id", F.col("seq").cast("long"), "kind", F.col("score").cast("double"),
                      at.alias("at"), F.unix_millis(at).alias("at_ms")).withWatermark("at", f"{REVIEW_TTL_MS // 1000} seconds")
    e = e.withColumn("review_group", F.pmod(F.xxhash64("transaction_id"), F.lit(groups)))
    return e.groupBy("review_group").applyInPandasWithState(
        _review_step, REVIEW_OUT, REVIEW_STATE, "update", GroupStateTimeout.EventTimeTimeout)
