"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklog.llm.common import through_table


def _flat(parents: DataFrame) -> DataFrame:
    """Follow parents to their ends; a parent is never greater than its node, so each step halves the way."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = through_table(parents.join(up, "parent", "left").select("node", F.col("parent").alias("old"), F.coalesce("grand", "parent").alias("parent")), "parents")
        if parents.filter("old <> parent").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the component is its smallest node.

    Each round hangs every node under its smallest neighbour and contracts the links to the nodes on top, which are
    at most half as many; nothing is collected.
    """
    links = through_table(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = _flat(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("parent")))
        if labels is None:
            labels = parents.withColumnRenamed("parent", "component")
        else:
            step = parents.select(F.col("node").alias("component"), "parent")
            labels = through_table(labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("top_a"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("top_b"))
        moved = links.join(a, "a").join(b, "b").filter("top_a <> top_b")
        links = through_table(moved.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
