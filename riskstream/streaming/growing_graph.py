"""J6 on a graph that grows by batches: vertices, edges and components without going through old edges again.

Vertices have dense numbers from a dictionary, so no two ever share one. A batch numbers its new vertices after the old ones.
Its new edges are taken to the labels of their ends; components of these few edges between labels tell which old components
have become one, and one join gives every vertex its new label.

Batch ``b`` is a folder that is valid once its ``meta``, written last, is there; it is made from the valid batches before it, so
a replayed or interrupted batch gives the same graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.operators import graph
from riskstream.streaming.velocity_stream import batch_ids


@dataclass
class GrowingGraph:
    """The graph of users, devices and addresses kept under ``path``."""

    spark: SparkSession
    path: str

    def _done(self, before: int | None = None) -> list[int]:
        return [b for b in batch_ids(self.spark, self.path, "meta/_SUCCESS") if before is None or b < before]

    def _all(self, name: str, ids: list[int], schema: str) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/batch_id={b}/{name}" for b in ids])

    def add(self, tx: DataFrame, batch_id: int) -> None:
        """foreachBatch writer of a batch of transactions."""
        done = self._done(batch_id)
        here = f"{self.path}/batch_id={batch_id}"
        meta = self.spark.read.parquet(f"{self.path}/batch_id={done[-1]}/meta").first() if done else None
        known = self._all("dictionary", done, "type string, id string, node long")
        verts = graph.graph_vertices(tx).select("type", "id")
        new = graph.dense_ids(verts.join(known, ["type", "id"], "left_anti"), meta["nodes"] if meta else 0)
        new.write.mode("overwrite").parquet(f"{here}/dictionary")
        new = self.spark.read.parquet(f"{here}/dictionary")
        ids = known.join(verts, ["type", "id"], "left_semi").unionByName(new)
        edges = graph.undirected_edges(tx, ids).join(self._all("edges", done, "u long, v long"), ["u", "v"], "left_anti")
        edges.write.mode("overwrite").parquet(f"{here}/edges")
        edges = self.spark.read.parquet(f"{here}/edges")
        labels = self._all("labels", done[-1:], "node long, label long").unionByName(new.select("node", F.col("node").alias("label")))
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias("l" + c))
        between = edges.join(of("u"), "u").join(of("v"), "v").where("lu <> lv").select(
            F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
        merged = graph.connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("new_label"))
        labels = labels.join(merged, "label", "left").select("node", F.coalesce("new_label", "label").alias("label"))
        labels.write.mode("overwrite").parquet(f"{here}/labels")
        n = [(meta["nodes"] if meta else 0) + new.count(), (meta["edges"] if meta else 0) + edges.count()]
        self.spark.createDataFrame([tuple(n)], "nodes long, edges long").write.mode("overwrite").parquet(f"{here}/meta")

    def components(self) -> DataFrame:
        """(type, id, label): two vertices have one label if they are connected."""
        done = self._done()
        labels = self._all("labels", done[-1:], "node long, label long")
        return self._all("dictionary", done, "type string, id string, node long").join(labels, "node").select("type", "id", "label")

    def stats(self) -> DataFrame:
        """node_count, edge_count, components: one row."""
        done = self._done()
        meta = self.spark.read.parquet(f"{self.path}/batch_id={done[-1]}/meta").first() if done else {"nodes": 0, "edges": 0}
        return self._all("labels", done[-1:], "node long, label long").agg(F.countDistinct("label").alias("components")).select(
            F.lit(meta["nodes"]).cast("long").alias("node_count"), F.lit(meta["edges"]).cast("long").alias("edge_count"), "components")
