"""Connected components of a graph whose links are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraspark.llm.common import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Labels flow along the links and then jump to the label of their label, so the
    rounds grow with the logarithm of a component's diameter. Each round is cut off in the
    shared folder; only a count of changes comes to the driver.
    """
    both = cut_lineage(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("component")
        )
    )
    while True:
        sent = (
            both.join(labels, both["a"] == labels["node"])
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("component").alias("sent"))
        )
        lower = labels.join(sent, "node").select(
            "node", "component", F.least("component", "sent").alias("target")
        )
        jump = labels.select(F.col("node").alias("target"), F.col("component").alias("jumped"))
        moved = cut_lineage(
            lower.join(jump, "target").select(
                "node", F.least("target", "jumped").alias("component"), (F.col("component") > F.least("target", "jumped")).alias("moved")
            )
        )
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels
