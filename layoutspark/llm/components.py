"""Connected components by min-label hooking and pointer jumping; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def components(links: DataFrame) -> DataFrame:
    """links (a, b long) -> (id, component): the smallest id reachable, for every id in a link.

    Each round hangs every node under the smallest label in its neighbourhood, then jumps labels twice; depth shrinks
    geometrically, so the number of rounds is logarithmic in the longest path. Every round is written to the shared folder.
    """
    both = links.where("a <> b").select("a", "b")
    both = materialize(both.union(both.select("b", "a")).distinct().toDF("a", "b"), "links")
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id")
    label = materialize(label, "labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        hooked = label.join(near, label.id == near.a, "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        # the label's own label moves too, so that whole trees hook at once
        up = hooked.groupBy("component").agg(F.min("low").alias("root")).select(F.col("component").alias("was"), "root")
        moved = hooked.join(up, hooked.component == up.was).select("id", "component", F.least("low", "root").alias("low"))
        jump = moved.select(F.col("id").alias("key"), F.col("low").alias("next"))
        new = moved.join(jump, moved.low == jump.key, "left").select("id", F.least("low", F.coalesce("next", "low")).alias("new"), F.col("component").alias("old"))
        new = materialize(new, "labels")
        changed = new.where("new <> old").limit(1).count()
        label = new.select("id", F.col("new").alias("component"))
        if not changed:
            return label
