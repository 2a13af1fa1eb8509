"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of an edge, ``component`` being
    the smallest node reachable from it.

    Each round sends labels over the edges, hooks the old label's node onto
    the smaller label found and follows one pointer, so the number of rounds
    grows with the logarithm of the component's diameter.  Labels live in a
    table under the checkpoint folder; nothing but the count of changed
    labels reaches the driver.  Joins read plain tables on both sides, so
    adaptive execution can split the partition of a hot node; minima are
    aggregated before they are shuffled.  Loops and rows with a null end
    link nothing.
    """
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = materialise(one.union(one.select("dst", "src")).distinct(), "edges")
    labels = materialise(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
        .select("node", F.least("node", "m").alias("label"), F.lit(True).alias("changed")), "labels")
    for _ in range(max_rounds):
        if labels.where("changed").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        old = labels.select("node", "label")
        seen = (both.join(old.select(F.col("node").alias("dst"), F.col("label").alias("far")), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("far").alias("far")))
        low = old.join(seen, "node").select("node", "label", F.least("label", "far").alias("low"))
        ends = F.explode(F.array("node", "label"))
        hooked = low.select(ends.alias("node"), "low").groupBy("node").agg(F.min("low").alias("low"))
        jump = old.select(F.col("node").alias("low"), F.col("label").alias("next"))
        stepped = hooked.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("next", "low")).alias("label"))
        labels = materialise(
            stepped.join(old.withColumnRenamed("label", "was"), "node")
            .select("node", "label", (F.col("label") < F.col("was")).alias("changed")), "labels")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
