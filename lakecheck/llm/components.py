"""Connected components of a large graph, round by round, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.session import fits_broadcast, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of a link, root being the smallest node of its component.

    Every node points to a smaller one. In a round a link is replaced by one between the
    targets of its ends, and a node's target by the smallest target seen (a node points to
    the target of its target, too); links inside a tree go away. Rounds grow with the
    logarithm of the longest path, not with the size of a component. A node with very many
    links is only ever aggregated (partial sums before the shuffle) or the large side of a
    join on it, which adaptive execution splits. Nothing is brought to the driver but counts.
    """
    def joined(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
        return left.join(F.broadcast(right) if fits_broadcast(right) else right, on, "left")

    links = materialize(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "links")
    ends = links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select(F.col("a").alias("node"), F.col("a").alias("root")))
    roots = materialize(ends.groupBy("node").agg(F.min("root").alias("root")), "roots")
    while True:
        # every node points to the root of its tree
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = materialize(joined(roots, up, "root").select("node", F.least("root", "higher").alias("root"), (F.col("higher") < F.col("root")).alias("moved")), "roots")
            roots = jumped.drop("moved")
            if not jumped.where("moved").take(1):
                break
        names = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        across = joined(joined(links, names, "a"), names.toDF("b", "rb"), "b")
        links = materialize(across.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if not links.take(1):
            return roots
        # of all links between two trees, the larger root hooks onto the smallest other one
        hooks = links.groupBy("b").agg(F.min("a").alias("hook")).withColumnRenamed("b", "node")
        roots = materialize(joined(roots, hooks, "node").select("node", F.coalesce("hook", "root").alias("root")), "roots")
