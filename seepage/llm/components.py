"""Connected components of an edge table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(v, rep): the representative of every vertex of ``edges`` (a, b).

    Each round lets every vertex point to its smallest neighbour, follows the
    pointers twice, and relabels the edges; edges inside one group vanish and
    parallel ones merge, so the table shrinks by half or more a round and the
    number of rounds grows with the logarithm of the longest chain. Representatives
    are the smallest vertex only within a round; they are the same for all
    vertices of a component and no other. The driver learns one count a round.
    """
    left = materialise(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    members = left.select(F.col("a").alias("v")).union(left.select("b")).distinct()
    found = members.withColumn("rep", F.col("v"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        pointer = materialise(
            both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "pointers"
        )
        up = pointer.select(F.col("a").alias("p"), F.col("p").alias("q"))
        twice = pointer.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        twice = materialise(twice, "pointers")
        found = materialise(
            found.join(twice.select(F.col("a").alias("rep"), F.col("p").alias("_to")), "rep", "left").select(
                "v", F.coalesce("_to", "rep").alias("rep")
            ),
            "members",
        )
        ends = twice.select(F.col("a").alias("b"), F.col("p").alias("_b"))
        left = materialise(
            left.join(twice, "a").join(ends, "b").select(F.col("p").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct(),
            "edges",
        )
    return found
