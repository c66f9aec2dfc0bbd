"""Connected components of links between documents, by spreading the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, split_join, stored


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """id, component (the smallest id reachable) of every id in ``links`` (columns a, b).

    Each round a node takes the smallest label among itself and its neighbours and then the label of that label, so
    labels travel twice as far every round. Labels are written to the shared folder each round; only the number of
    changed labels comes to the driver. A node with very many links meets its neighbours' labels pre-combined, and
    where its own label goes to them, or where very many nodes ask for one label, the rows are dealt to many tasks.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = stored(both, folder, f"{name}-edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), folder, f"{name}-0")
    count = F.count("*").alias("n")
    hubs = hot_keys(stored(edges.groupBy("b").agg(count), folder, f"{name}-degrees"), "b")
    step = 0
    while True:
        step += 1
        near = split_join(edges, labels.toDF("b", "component"), ["b"], "a", hubs).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("was"), F.least("component", "near").alias("at"))
        new = stored(new, folder, f"{name}-{step}-near")
        asked = hot_keys(new.groupBy("at").agg(count), "at")
        new = split_join(new, labels.toDF("at", "beyond"), ["at"], "id", asked, "left").select("id", "was", F.least("at", F.coalesce("beyond", "at")).alias("component"))
        new = stored(new, folder, f"{name}-{step}")
        labels = new.select("id", "component")
        if not new.where("component <> was").limit(1).count():
            return labels
