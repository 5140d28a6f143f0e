"""Connected components of a link table by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm import textops as T


def _through(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace ``column`` by its parent where it has one."""
    p = parents.select(F.col("x").alias("_x"), F.col("p").alias("_p"))
    return (df.join(p, F.col(column) == F.col("_x"), "left")
            .withColumn(column, F.coalesce("_p", column)).drop("_x", "_p"))


def _ordered(links: DataFrame) -> DataFrame:
    return (links.where("a != b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: longs); the label is a node of its component.

    Each round gives every node its smallest smaller neighbour as parent, jumps to that one's
    parent, and contracts the links; stars vanish in one round, chains of n nodes in about log n,
    as node numbers are hashes.  Links and labels are written to the shared folder each round.
    An empty table gives an empty result.
    """
    labels = (links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
              .withColumn("label", F.col("node")))
    links = _ordered(links)
    while not links.isEmpty():
        near = T.stored(links.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("p")), "parents")
        parents = _through(near, "p", near)
        labels = T.stored(_through(labels, "label", parents), "labels")
        links = T.stored(_ordered(_through(_through(links, "a", parents), "b", parents)), "links")
    return labels
