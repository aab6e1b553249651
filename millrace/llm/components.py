"""Connected components by label propagation with pointer jumping, in files every executor can read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node id reachable over ``edges`` of long ids; nodes without edges are left out.

    Every round takes the smallest label among the neighbours and then the label's own
    label, so a chain of n nodes needs about log n rounds. Labels are written after every
    round, and the loop ends when none changed.
    """
    both = durable(
        edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
        .unionByName(edges.select(F.col(b).cast("long").alias("x"), F.col(a).cast("long").alias("y")).where("x <> y"))
        .distinct()
    )
    labels = durable(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        offered = both.hint("merge").join(labels.hint("merge"), F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("offer"))
        lower = labels.hint("merge").join(offered.hint("merge"), F.col("node") == F.col("x")).select("node", F.col("component").alias("old"), F.least("component", "offer").alias("c"))
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        moved = durable(lower.hint("merge").join(jump.hint("merge"), F.col("c") == F.col("_n"), "left").select("node", "old", F.least("c", F.coalesce("_c", "c")).alias("component")))
        labels = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return labels
