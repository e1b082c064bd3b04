"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainledger.llm.tables import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (or smaller) neighbours to the smallest node around it.

    The smallest nodes are stored before they are joined: both sides are then bare shuffles, and adaptive execution deals
    the neighbours of the centre of a large star over many tasks.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = keep(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "star-least")
        tied = around.join(small, "a").where(F.col("b") > F.col("a"))
        return tied.select(F.col("least").alias("a"), "b").where("a < b").distinct()
    down = edges.select(F.col("b").alias("node"), F.col("a").alias("lower"))
    small = keep(down.groupBy("node").agg(F.min("lower").alias("least")), "star-least")
    tied = down.join(small, "node").select(F.col("least").alias("a"), F.col("lower").alias("b"))
    own = small.select(F.col("least").alias("a"), F.col("node").alias("b"))
    return tied.unionByName(own).where("a < b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Each node hangs on one centre, and no centre hangs on another: then the edges are the answer."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("leaf")), F.struct(F.col("b").alias("node"), F.lit(1).alias("leaf")))).alias("end"))
    roles = ends.groupBy("end.node").agg(F.sum("end.leaf").alias("leaves"), F.min("end.leaf").alias("least"))
    return roles.where((F.col("leaves") > 1) | ((F.col("leaves") == 1) & (F.col("least") == 0))).isEmpty()


def connect(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of edges (a, b), but for the smallest nodes themselves.

    Each round is stored, so a lost executor costs no more than that round. Loops and repeated edges don't matter.
    """
    current = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    current = keep(current, "edges")
    while not _settled(current):
        current = keep(_star(_star(current, large=True), large=False), "edges")
    return current.select(F.col("b").alias("node"), F.col("a").alias("component"))
