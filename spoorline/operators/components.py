"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import Rounds

#: How often a vertex goes on to what its target points to, within a round.
JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """(v, label): of every vertex of ``edges`` (a, b) the least vertex it can reach, itself included.

    In a round every vertex points to its least neighbour that is less than itself, goes on to where that one points,
    and the graph is contracted along the pointers: ends of edges are replaced, repeated edges and loops go. Chains,
    stars and mixtures of them lose at least half of their vertices, so rounds grow with the logarithm, whatever the
    order of the vertices. Rounds are written to the shared folder. No edges give no rows.
    """
    rounds = Rounds(edges.sparkSession)
    cut = rounds.cut
    ways = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = cut(ways.distinct())
    labels = cut(left.select(F.col("a").alias("v"), F.col("a").alias("label")).distinct())
    left = cut(left.where("a <> b"))
    while not left.isEmpty():
        to = left.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("near")).select("v", F.least("v", "near").alias("to"))
        to = cut(to)
        for _ in range(JUMPS):
            further = to.select(F.col("v").alias("at"), F.col("to").alias("further"))
            to = to.join(further, F.col("to") == F.col("at"), "left").select("v", F.coalesce("further", "to").alias("to"))
        to = cut(to)
        labels = cut(labels.join(to.withColumnRenamed("v", "_at"), F.col("label") == F.col("_at"), "left").select("v", F.coalesce("to", "label").alias("label")))
        ends = [to.select(F.col("v").alias(c), F.col("to").alias(f"_{c}")) for c in "ab"]
        left = left.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b")
        left = cut(left.distinct())
        rounds.keep(left, labels)
    rounds.keep(labels)
    return labels
