"""Consolidating pairwise matches into groups.

1. Peel: a breadth-first search by frontier joins from the vertex with most neighbours takes the giant component out, and
   an anti-join leaves the rest. Its rounds grow with the component's diameter, so after peel_rounds the part reached so
   far is contracted into one vertex and what it still touches goes on in step 2 (a chain of a million links ends, too).
2. Small components: minimum propagation over alternating stars (every vertex hands the smallest vertex it knows to its
   larger, then to its smaller neighbours), which halves distances, so rounds grow with the logarithm of the diameter.

Only counters come to the driver. Every round is written to the shared checkpoint folder. Sides that follow the data are
joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.session import cut, shuffled


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum: equal in two rounds when nothing moved."""
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def _star_round(edges: DataFrame) -> DataFrame:
    """edges (u > v): first every vertex links its larger neighbours to the least vertex around, then its smaller ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(shuffled(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    large = cut(large)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(shuffled(least), "u")
    # each smaller neighbour except the least, and the vertex itself, hang on the least
    return small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _propagate(edges: DataFrame) -> DataFrame:
    """edges (u, v), u <> v -> (id, label): the least vertex of the component, for every vertex that is not the least itself."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state: tuple[int, int] | None = None
    while (now := _state(edges)) != state and now[0]:
        state, edges = now, cut(_star_round(edges))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", peel_rounds: int = 6) -> DataFrame:
    """post id and group id for every vertex of pairs: (id long, group_id long), group_id the least id of the group.

    Pairs with a null end are no links and give no row; a pair of a vertex with itself gives a group of its own; repeated
    and turned-round pairs count once; an empty input gives an empty result. Other columns of pairs are ignored.
    peel_rounds only divides the work between the two steps, never the result.
    """
    links = pairs.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    links = cut(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    proper = links.where("u <> v")
    both = cut(proper.unionByName(proper.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    vertices = links.select(F.col("u").alias("id")).unionByName(links.select(F.col("v").alias("id"))).distinct()

    top = both.groupBy("u").count().orderBy(F.desc("count"), "u").first()
    if top is None:
        return vertices.select("id", F.col("id").alias("group_id"))
    spark = pairs.sparkSession
    seen = frontier = spark.createDataFrame([(top["u"],)], "id long")
    for _ in range(peel_rounds):
        reached = both.join(shuffled(frontier.select(F.col("id").alias("u"))), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        frontier = cut(reached.join(shuffled(seen), "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # of written parts, peel_rounds of them at most

    # contract what was reached into its least vertex; links inside it vanish, links out of it stay
    core = seen.agg(F.min("id")).first()[0]
    inside = seen.withColumn("_in", F.lit(True))
    rest = (
        proper.join(shuffled(inside.select(F.col("id").alias("u"), F.col("_in").alias("_iu"))), "u", "left")
        .join(shuffled(inside.select(F.col("id").alias("v"), F.col("_in").alias("_iv"))), "v", "left")
        .where("_iu is null or _iv is null")
        .select(F.when(F.col("_iu"), F.lit(core)).otherwise(F.col("u")).alias("u"), F.when(F.col("_iv"), F.lit(core)).otherwise(F.col("v")).alias("v"))
    )
    labels = cut(_propagate(rest))
    # where the contracted part hangs on a smaller vertex, all of it does
    core_label = labels.where(F.col("id") == core).agg(F.min("label")).first()[0]
    peeled = seen.select("id", F.lit(core if core_label is None else core_label).cast("long").alias("group_id"))
    others = vertices.join(shuffled(seen), "id", "left_anti").join(shuffled(labels), "id", "left").select("id", F.coalesce("label", "id").alias("group_id"))
    return others.unionByName(peeled)
