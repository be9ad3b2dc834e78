"""Connected components of a link table, by contraction in written rounds.

Every round each node takes the smallest node among itself and its neighbours as its
root, roots are followed two steps, links are rewritten between roots and those within
one root vanish. Rounds are few (links at least halve their nodes) and each is a table in
the shared folder, so lost executors cost one round at most. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.session import is_empty, stage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of (``a``, ``b``) links; root is the smallest node reachable."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(both.where("a <> b").distinct())
    labels = None
    while not is_empty(edges):
        near = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        up = near.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        roots = stage(near.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("root")))
        if labels is None:
            labels = roots.select(F.col("a").alias("node"), "root")
        else:
            moved = roots.select(F.col("a").alias("root"), F.col("root").alias("_to"))
            labels = stage(labels.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root")))
        left = roots.select("a", F.col("root").alias("ra"))
        right = roots.select(F.col("a").alias("b"), F.col("root").alias("rb"))
        again = edges.join(left, "a").join(right, "b").where("ra <> rb").select("ra", "rb")
        # Roots that are still someone's child keep that link.
        live = roots.select(F.col("root").alias("x")).distinct()
        chain = roots.where("a <> root").join(live, F.col("a") == F.col("x"), "left_semi").select(
            F.col("a").alias("ra"), F.col("root").alias("rb"))
        edges = stage(again.union(chain).union(again.select("rb", "ra")).union(chain.select("rb", "ra"))
                      .toDF("a", "b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
