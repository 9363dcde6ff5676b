"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WorkFolder


def components(edges: DataFrame, work: WorkFolder, name: str) -> DataFrame:
    """(node, label: the least node it can reach) for every node of ``edges`` (a, b); nulls, loops and repeats don't matter.

    Each round takes the least label among a node and its neighbours, then the
    label's label, so that long chains halve. Only the number of changes reaches the driver.
    """
    both = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = work.cut(both.union(both.select("b", "a")).distinct(), f"{name}_edges")
    labels = work.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}_0")
    turn = 0
    while True:
        turn += 1
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        nearer = labels.join(seen, F.col("node") == F.col("n")).select("node", "label", F.least("label", "m").alias("new"))
        step = labels.select(F.col("node").alias("n"), F.col("label").alias("m"))
        jumped = nearer.join(step, F.col("new") == F.col("n"), "left").select("node", F.least("new", F.coalesce("m", "new")).alias("new_label"), "label")
        found = work.cut(jumped, f"{name}_{turn}")
        changes = found.filter("new_label < label").count()
        work.drop(f"{name}_{turn - 1}")
        labels = found.select("node", F.col("new_label").alias("label"))
        if not changes:
            work.drop(f"{name}_edges")
            return labels
