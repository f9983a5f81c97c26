"""Groups of linked rows, for the catalogue's own links (short chains)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.session import cut, shuffled


def linked_groups(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, group): the least id each end of an edge is linked with, directly or not. Ids can be of any type with an order, structs too.

    Minimum labels travel along the edges and then jump to their own label, a join and an aggregate a round, written to the
    shared folder; rounds grow with the logarithm of the longest chain for the usual shapes. Null ends are no links.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(e.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("l")))
    while True:
        near = e.join(shuffled(labels.select(F.col("u").alias("v"), F.col("l").alias("nl"))), "v").groupBy("u").agg(F.min("nl").alias("nl"))
        step = labels.join(shuffled(near), "u", "left").select("u", F.least("l", "nl").alias("n"), "l")
        jump = step.join(shuffled(labels.select(F.col("u").alias("n"), F.col("l").alias("j"))), "n", "left").select("u", F.least("n", F.coalesce("j", "n")).alias("new"), "l")
        jump = cut(jump)
        moved = jump.where("new < l").limit(1).count()
        labels = jump.select("u", F.col("new").alias("l"))
        if not moved:
            return labels.select(F.col("u").alias("id"), F.col("l").alias("group"))
