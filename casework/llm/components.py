"""Connected components of a graph that lies in a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.shared import kept as stored


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``: the smallest node it is connected with.

    Large-star and small-star steps in turn: every node hands its greater neighbours, then its
    smaller ones, to the smallest node it knows, until every component is a star, which is
    counted and takes no further step. The number of
    steps grows as the logarithm of the graph. Runs jobs; every step is stored, minima are
    formed before the shuffle, and a hub's links are joined, not gathered. Both ends of a link come
    out of one row: a union would double the tasks, and each shuffle's files.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not stars(edges):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        least = both.groupBy("e.u").agg(F.min("e.v").alias("m")).select("u", F.least("u", "m").alias("m"))
        greater = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = greater.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # A node and its smaller neighbour both go to the smallest of these.
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        edges = stored(small.select("e.u", "e.v").filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def stars(edges: DataFrame) -> bool:
    """Whether every node ``u`` has one link, to a ``v`` that has none as ``u``: then every component is a star."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))
    ups = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return ups.filter("ups > 1 OR ups = 1 AND least = 0").isEmpty()
