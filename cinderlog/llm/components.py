"""Connected components by alternating star contractions.

Each round links every node's larger neighbours to its smallest neighbour, then every
node and its smaller neighbours to the smallest of them.  The edges end up as stars
around each component's smallest node.  Rounds grow with the logarithm of the number of
nodes; every round is an aggregation and a join, and is stored before the next.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.sources.staging import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    others = down.join(low, "u").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return others.unionByName(low.withColumnRenamed("low", "v")).distinct()


def _state(edges: DataFrame) -> tuple:
    code = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(code)).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (u, v); the root is the component's smallest node."""
    edges = materialize(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    state = _state(edges)
    while True:
        edges = materialize(_small(_large(edges)), "stars")
        now = _state(edges)
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
