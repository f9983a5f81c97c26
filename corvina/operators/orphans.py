"""References to records that do not exist.

State: per key the signed number of references to it and of records that carry it. A change delta is (key, refs, exists)
with signs; applying one is a union and a sum, so deltas commute, late records heal their orphans and deletions make new
ones. Orphans are the keys with refs > 0 and exists <= 0. Sums combine before the shuffle: a key that holds a third of all
references costs one row per task.

Redirects are counted the same way, by (former, current) pair. Which former keys lead to an existing one is part of the state,
and a delta moves only what it can touch: the keys behind changed redirects and behind keys that came or went (see advance).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.session import cut, shuffled


def reference_delta(rows: DataFrame, key: Column, sign: int = 1) -> DataFrame:
    """One reference to key per row; null keys refer to nothing."""
    return rows.select(key.cast("long").alias("key"), F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("exists")).where("key is not null")


def existence_delta(rows: DataFrame, key: Column, sign: int = 1) -> DataFrame:
    """One record carrying key per row; null keys carry nothing."""
    return rows.select(key.cast("long").alias("key"), F.lit(0).cast("long").alias("refs"), F.lit(sign).cast("long").alias("exists")).where("key is not null")


def apply_deltas(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The new state; keys whose counts are both zero leave it. Without a state and with empty deltas: an empty state."""
    parts = ([] if state is None else [state]) + list(deltas)
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists")).where("refs <> 0 or exists <> 0")


def orphan_keys(state: DataFrame) -> DataFrame:
    return state.where("refs > 0 and exists <= 0").select("key", "refs")


def snapshot_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """The delta that turns one state into another, for sources that deliver full snapshots."""
    return apply_deltas(None, new.select("key", "refs", "exists"), old.select("key", (-F.col("refs")).alias("refs"), (-F.col("exists")).alias("exists")))


def reaching_keys(redirects: DataFrame, existing: DataFrame, old: str, new: str) -> DataFrame:
    """Former keys that lead to an existing one over any number of redirects (key long, each once).

    Walks backwards from the existing keys, a frontier join a round, so circles and dead ends are never entered and a key
    with several redirects needs one that leads there. The frontier is written to the shared folder every round.
    """
    edges = redirects.select(F.col(old).cast("long").alias("o"), F.col(new).cast("long").alias("n")).where("o is not null and n is not null and o <> n").distinct()
    edges = cut(edges)
    found = frontier = cut(edges.join(shuffled(existing.select(F.col("key").alias("n")).distinct()), "n", "left_semi").select(F.col("o").alias("key")).distinct())
    while not frontier.isEmpty():
        step = edges.join(shuffled(frontier.select(F.col("key").alias("n"))), "n", "left_semi").select(F.col("o").alias("key")).distinct()
        frontier = cut(step.join(shuffled(found), "key", "left_anti"))
        found = cut(found.unionByName(frontier))
    return found


@dataclass
class OrphanState:
    """counts: key, refs, exists; redirects: o, n, times; reached: key, those that lead to an existing key. All are plain
    tables with unique keys, to be kept from run to run (the three names of tables())."""

    counts: DataFrame
    redirects: DataFrame
    reached: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"orphan_counts": self.counts, "orphan_redirects": self.redirects, "orphan_reached": self.reached}

    def orphans(self) -> DataFrame:
        """key and refs of every key that is referred to, is not there and leads nowhere."""
        return orphan_keys(self.counts).join(shuffled(self.reached), "key", "left_anti")


def redirect_delta(rows: DataFrame, old: str, new: str, sign: int = 1) -> DataFrame:
    """One redirect per row; rows with a null end, or of a key to itself, lead nowhere."""
    return rows.select(F.col(old).cast("long").alias("o"), F.col(new).cast("long").alias("n"), F.lit(sign).cast("long").alias("times")).where("o is not null and n is not null and o <> n")


def _behind(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """keys and every key from which they can be reached: a frontier join a round, each key entered once."""
    found = frontier = cut(keys)
    while not frontier.isEmpty():
        step = edges.join(shuffled(frontier.select(F.col("key").alias("n"))), "n", "left_semi").select(F.col("o").alias("key")).distinct()
        frontier = cut(step.join(shuffled(found), "key", "left_anti"))
        found = cut(found.unionByName(frontier))
    return found


def advance(state: OrphanState | None, counts: list[DataFrame], redirects: DataFrame | None = None) -> OrphanState:
    """The state after deltas of counts (reference_delta, existence_delta) and of redirects (redirect_delta), in any order.

    Touched are the former keys of redirects that came or went and those that point at a key that came or went, with all that
    lead to them. Whatever else was reached stays reached; the touched ones are walked anew, from existing keys and from
    reached untouched ones, so circles whose exit is gone do not hold themselves up. Without a state all is new.
    """
    if state is None:
        total = cut(apply_deltas(None, *counts))
        spark = total.sparkSession
        edges = (spark.createDataFrame([], "o long, n long, times long") if redirects is None else redirects).groupBy("o", "n").agg(F.sum("times").alias("times")).where("times <> 0")
        edges = cut(edges)
        return OrphanState(total, edges, reaching_keys(edges.where("times > 0"), total.where("exists > 0"), "o", "n"))
    now = cut(apply_deltas(state.counts, *counts))
    edges = state.redirects if redirects is None else state.redirects.unionByName(redirects)
    edges = cut(edges.groupBy("o", "n").agg(F.sum("times").alias("times")).where("times <> 0"))
    there = lambda x: x.where("exists > 0").select("key")
    was, is_ = there(state.counts), there(now)
    flipped = was.join(shuffled(is_), "key", "left_anti").unionByName(is_.join(shuffled(was), "key", "left_anti"))
    before, after = (x.where("times > 0").select("o", "n") for x in (state.redirects, edges))
    changed = before.join(shuffled(after), ["o", "n"], "left_anti").unionByName(after.join(shuffled(before), ["o", "n"], "left_anti"))
    both = cut(before.unionByName(after).distinct())
    touched = changed.select(F.col("o").alias("key")).unionByName(both.join(shuffled(flipped.select(F.col("key").alias("n"))), "n", "left_semi").select(F.col("o").alias("key"))).distinct()
    touched = _behind(both, touched)
    kept = cut(state.reached.join(shuffled(touched), "key", "left_anti"))
    open_ = cut(after.join(shuffled(touched.select(F.col("key").alias("o"))), "o", "left_semi"))
    found = reaching_keys(open_, is_.unionByName(kept), "o", "n")
    return OrphanState(now, edges, cut(kept.unionByName(found).distinct()))


def orphan_rows(references: DataFrame, orphans: DataFrame) -> DataFrame:
    """The rows of references (with a key column) whose key is among the orphans (key, once each). Adaptive execution splits a
    key that holds most of the rows."""
    return references.join(shuffled(orphans.select("key")), "key", "left_semi")
