"""Connected components of a link table by smallest-label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that every linked node reaches. Nodes without links don't appear.

    Each round gives a node the smallest label among its neighbours, then the label of that label, so chains
    shrink by doubling. Every round is written out: lineage stays short, and a lost executor repeats one round.
    Null ends are dropped; repeated links and self-links change nothing.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = staged(links.union(links.select("b", "a")).distinct())
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(
            F.min("root").alias("near"))
        hooked = labels.join(seen, labels["node"] == seen["a"]).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("at"), F.col("root").alias("top"))
        labels = staged(hooked.join(up, hooked["root"] == up["at"]).select("node", "old", F.col("top").alias("root")))
        if labels.where("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
