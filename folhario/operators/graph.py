"""Connected components of an undirected graph, by label propagation with short cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhario.runtime import cut, skew_join


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50, hub: int = 100_000) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    In each round every node takes the smallest label among itself and its neighbours,
    and then the label of that label (the short cut), so chains shrink by half and stars
    are done at once. Rounds are cut from their lineage in the shared checkpoint folder
    and end when nothing changes; more than `rounds` is an error, never a wrong result.
    Aggregation is map-side first, and a label goes to the neighbours of a node with very
    many edges over many tasks (`skew_join`), so such a node is no hot spot.
    Null ends are ignored; loops and repeated edges change nothing.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    degrees = cut(both.groupBy(F.col("v")).agg(F.count("*").alias("_n")).where(F.col("_n") > hub))
    hubs = not degrees.isEmpty()
    labels = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    for _ in range(rounds):
        known = labels.withColumnRenamed("u", "v")
        met = skew_join(both, known, ["v"], degrees, floor=hub) if hubs else both.join(known, "v")
        near = met.groupBy("u").agg(F.min("label").alias("low"))
        best = labels.join(near, "u").select("u", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        jump = best.select(F.col("u").alias("label"), F.col("label").alias("next"))
        new = cut(best.join(jump, "label", "left").select("u", F.least("label", F.coalesce("next", "label")).alias("label"), "was"))
        if new.where("label <> was").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = new.select("u", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
