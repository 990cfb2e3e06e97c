"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import stage


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, label): the smallest id reachable, for every id on an edge (columns a, b, of one ordered type).

    Large-star and small-star steps by turns: each hooks a node's neighbours to the smallest of them, until every node
    hangs on its label. The minimum of a node is a partial aggregate and the edges of a busy node are joined to one row, so
    no node's neighbours are gathered. Rounds grow with the logarithm of the longest path; each is written to shared storage.
    """
    e = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    previous = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a node go to its minimum.
        e1 = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: neighbours below a node, and the node, go to the lowest of them.
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        e2 = e1.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                                        F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = stage(e2.select("x.a", "x.b").filter("a <> b").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == previous:
            return e.select(F.col("a").alias("id"), F.col("b").alias("label")).union(
                e.select(F.col("b").alias("id"), F.col("b").alias("label"))).distinct()
        previous = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
