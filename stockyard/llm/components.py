"""Connected components of a graph given as an edge table."""

from pyspark.sql import functions as F

from stockyard.session import materialize


def connected(edges, label="components"):
    """(node, root) for every node of the edges (a, b); the root is the smallest node.

    Alternating stars (Kiveris et al., "Connected Components in MapReduce and Beyond"):
    every node hangs its larger neighbours, then its smaller ones, on its smallest
    neighbour, until nothing changes. Every round is a minimum by node, combined
    before the shuffle, joined back to the edges; a hub's edges may be split by
    adaptive execution. Each round is written to the shared folder. Loops and repeated
    edges change nothing; null ends are left out.
    """
    edges = edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = materialize(edges, label)
    before = None
    while True:
        stamp = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if stamp == before or stamp[0] == 0:
            break
        before = stamp
        edges = materialize(_small_star(_large_star(edges)), label)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _large_star(edges):
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges):
    """``edges`` point from the larger end ``a`` to the smaller ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
