"""Connected components of nodes that share groups, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, checkpoint


def components(pairs: DataFrame) -> DataFrame:
    """node, label: the least node of the component, from rows (node, group).

    Nodes of one group belong together. A round gives each group the least label of its
    nodes and each node the least of its groups, then every label is replaced by its own label, so
    that chains halve. Hot groups are aggregated before they are shuffled, and joins with
    them can be split. Rounds end when no label has changed. Rows whose node or group is null belong to nothing and are left out;
    rows that repeat count once; without rows the result is empty.
    """
    links = checkpoint(pairs.select("node", "group").dropna().distinct())
    rows = links.count()  # of labels there are no more
    labels = checkpoint(links.groupBy("node").agg(F.min("node").alias("label")), rows)
    while True:
        of_group = links.join(labels, "node").groupBy("group").agg(F.min("label").alias("label"))
        by_group = links.select("node", apart("group").alias("at"))
        near = by_group.join(of_group.select(apart("group").alias("at"), "label"), "at").groupBy("node").agg(F.min("label").alias("label"))
        further = near.select(apart("node").alias("at"), F.col("label").alias("further"))
        jump = near.select("node", "label", apart("label").alias("at")).join(further, "at", "left")
        jump = jump.select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = checkpoint(jump.join(labels.withColumnRenamed("label", "old"), "node"), rows)
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
