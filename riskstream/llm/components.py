"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import discard, materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node of ``edges``: label is the smallest node of its component.

    Each round every node takes the smallest label among its own and its neighbours', then the label of that label; rounds
    go on until none changes. Null ends are not nodes, loops and repeated edges change nothing, and no edges give no rows."""
    e = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null")
    e = materialize(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "cc-edges")
    labels = held = materialize(e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
                                .select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:  # a round's tables are deleted when the next labels are written
        near = (e.join(labels, e["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near")))
        low = (labels.join(near, labels["node"] == near["src"])
               .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        low = materialize(low, "cc-low")
        up = low.select(F.col("node").alias("up"), F.col("label").alias("above"))
        after = materialize(low.join(up, low["label"] == up["up"]).select("node", "old", F.least("label", "above")
                                                                          .alias("label")), "cc-labels")
        discard(low)
        discard(held)
        labels, held = after.select("node", "label"), after
        if after.where("old != label").isEmpty():
            discard(e)
            labels.materialized_path = after.materialized_path
            return labels
