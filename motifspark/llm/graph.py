"""Connected components by contraction."""

from pyspark.sql import functions as F

from motifspark.session import materialize


def components(edges):
    """(node, root) for every node of `edges` (a, b): root is the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour and contracts the edges, so stars end after one or two rounds
    and chains after a logarithm of their length. Every round is written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "edges")
    roots = None
    while not both.isEmpty():
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parents = materialize(parents.select("node", F.least("node", "low").alias("parent")), "parents")
        if roots is None:
            roots = parents.withColumnRenamed("parent", "root")
        else:
            above = parents.withColumnRenamed("node", "root")
            roots = materialize(roots.join(above, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        both = both.join(left, "a").join(right, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        both = materialize(both.distinct(), "edges")
    if roots is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
