"""Connected components of a link table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlab.llm.common import drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    return edges.join(least, edges.lo == least.node).select("hi", F.col("least").alias("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    edges = edges.withColumn("least", F.min("lo").over(Window.partitionBy("hi")))
    pair = F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo"))
    moved = edges.select(F.explode(F.array_distinct(F.array(pair, F.col("hi")))).alias("hi"), F.col("least").alias("lo"))
    return moved.distinct()


def _is_settled(edges: DataFrame) -> bool:
    """True if every node has one link, to a node that has none further down."""
    twice = edges.groupBy("hi").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).filter("a < b").select("hi")
    chained = edges.select(F.col("lo").alias("hi")).join(edges.select("hi"), "hi", "left_semi")
    return twice.union(chained).isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of a link whose component is not itself; component is the smallest id reachable.

    Alternates the large-star and small-star steps until a forest of stars
    remains, which takes a number of rounds that grows with the logarithm of the
    longest path. Each round is written to the shared folder. Links of an id
    with itself and null ids are ignored; an empty table gives an empty result.
    """
    edges = stored(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _is_settled(edges):
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        after = stored(_small_star(_large_star(edges)))
        drop_stored(edges)
        edges = after
    raise RuntimeError("the components did not settle")
