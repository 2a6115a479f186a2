"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import materialise, tasks_for


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has an edge; a component is named by its least node.

    Labels travel along edges and, in the same round, to where the label's own label points,
    so that rounds grow with the logarithm of a component's width. Each round is materialised;
    only the number of labels that changed comes to the driver. Null ends are left out.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = materialise(pairs.select(F.explode(ways).alias("way")).select("way.*").distinct())
    # A few labels need few tasks and files; the number follows the edges.
    parts = tasks_for(both.count())
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("least")).select(
        F.col("u").alias("node"), F.least("u", "least").alias("component")
    ).coalesce(parts))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels["node"] == near["u"]).select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("now")
        )
        moved = materialise(moved.coalesce(parts))
        target = moved.select(F.col("node").alias("at"), F.col("now").alias("jump"))
        jumped = materialise(moved.join(target, moved["now"] == target["at"], "left").select(
            "node", "was", F.least(F.col("now"), F.coalesce("jump", "now")).alias("component")
        ).coalesce(parts))
        changed = jumped.where("was <> component").count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
