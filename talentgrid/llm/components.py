"""Connected components over any number of links, in a logarithmic number of rounds.

Each round every node hooks to its least neighbour, pointers are halved until they meet a root, and links are
moved to roots; what lies inside a component vanishes. All rounds are joins of written tables, whose hot nodes
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.staging import staged, temporary


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (a, b): root is one node of its component, the same for all."""
    with temporary(links.sparkSession):
        labels = _components(links)
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if labels is None else staged(labels, "roots", up=1)


def _components(links: DataFrame) -> DataFrame | None:
    open_ = staged(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels, rows = None, open_.count()
    while left := open_.count():
        hooks = open_.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        roots = open_.select(F.col("a").alias("node")).distinct().join(hooks.select("node"), "node", "left_anti")
        hooks = staged(hooks.unionByName(roots.withColumn("root", F.col("node"))), "hooks", 2 * left)
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = staged(hooks.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "hooks", 2 * left)
            hooks = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        a = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = open_.join(a, "a").join(b, "b").where("ra <> rb")
        open_ = staged(across.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links", left)
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = staged(labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels", 2 * rows)
    return labels
