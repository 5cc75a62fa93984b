"""Connected components of an edge table by label propagation with pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import drop_stage, stage


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, comp): comp is the smallest node that a node reaches. Nodes without an edge
    are absent. Each round every node takes the least label of its neighbours, and then that label's own
    label; rounds are written to the shared folder, and the last one changed nothing."""
    both = stage(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.where("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("comp").alias("m"))
        low = labels.join(near, labels["node"] == near["u"]).select("node", F.least("comp", "m").alias("next"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("j"), F.col("comp").alias("to"))
        new = stage(low.join(jump, low["next"] == jump["j"]).select("node", F.least("next", "to").alias("comp"), "was"))
        changed = new.where("comp <> was").limit(1).count()
        drop_stage(labels)
        path, labels = new.scratch_path, new.select("node", "comp")
        labels.scratch_path = path
        if not changed:
            drop_stage(both)
            return labels
