"""Insert-or-update, authoritative replacement, new ids: what a table's next version is, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.session import cut, shuffled

Rule = Callable[[Column, Column], Column]


def take_new(old: Column, new: Column) -> Column:
    return new


def keep_old(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def new_if_given(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def sticky(value: str) -> Rule:
    """Once a column has the value it keeps it."""
    return lambda old, new: F.when(old == value, old).otherwise(F.coalesce(new, old))


def ignoring(value: str) -> Rule:
    """A new value of this kind never overwrites."""
    return lambda old, new: F.when(new.isNull() | (new == value), F.coalesce(old, new)).otherwise(new)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, Rule] | None = None, action: str | None = None) -> DataFrame:
    """old with new's rows inserted or, where the keys are equal, merged column by column (take_new unless a rule says else).

    A null in a key equals nothing, as in a unique index: such rows are always inserted. new must have unique keys (see
    latest_per_key). Columns only one side has stay, null on the other. action names a column that tells what happened.
    """
    rules = rules or {}
    marks_old, marks_new = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    joined = marks_old.join(marks_new, on, "full_outer")
    out = []
    for c in dict.fromkeys([*old.columns, *new.columns]):
        if c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c not in old.columns:
            out.append(F.col(f"n.{c}").alias(c))
        elif c in keys:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        else:
            o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
            out.append(F.when(F.col("_new").isNull(), o).when(F.col("_old").isNull(), n).otherwise(rules.get(c, take_new)(o, n)).alias(c))
    if action:
        out.append(F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").otherwise("updated").alias(action))
    return joined.select(*out)


def replace_children(old: DataFrame, new: DataFrame, parent: Sequence[str], parents: DataFrame | None = None) -> DataFrame:
    """All rows of the given parents (those in new unless given) go, then new's rows come."""
    gone = (new if parents is None else parents).select(*parent).distinct()
    return old.join(gone, list(parent), "left_anti").unionByName(new, allowMissingColumns=True)


def assign_ids(rows: DataFrame, id_column: str, order: Sequence[str], highest: int) -> DataFrame:
    """Sequential ids after highest, in the order of the natural key, without gathering the rows in one task.

    Rows are ranged by key into partitions; a count per partition (one small row each) gives every partition its offset.
    """
    parts = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    parts = cut(parts)
    counts = parts.groupBy("_p").count()
    offsets = counts.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_n", inside).join(offsets, "_p").withColumn(id_column, (F.lit(highest) + F.col("_offset") + F.col("_n")).cast("long")).drop("_p", "_n", "_offset")


def ordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected pairs with the smaller end first; pairs with a null end or of one with itself are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def remap(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str, drop_unmapped: bool = False) -> DataFrame:
    """The column's values through a map of unique old values; unmapped ones stay, or their rows go."""
    m = mapping.select(F.col(old).alias("_from"), F.col(new).alias("_to"))
    out = df.join(m, F.col(column) == F.col("_from"), "inner" if drop_unmapped else "left")
    return out.withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def final_targets(redirects: DataFrame, old: str, new: str) -> DataFrame:
    """_from, _to: for every former key the key its redirects end at, each former key once.

    Of several redirects of a key the one to the least key counts. Keys that run into a circle end nowhere and have no row; null
    ends lead nowhere. Steps double every round, so rounds are the logarithm of the longest chain.
    """
    step = redirects.where(F.col(old).isNotNull() & F.col(new).isNotNull()).groupBy(F.col(old).alias("_from")).agg(F.min(new).alias("_to"))
    step = cut(step)
    ends = step.select(F.col("_to").alias("_k")).distinct().join(shuffled(step.select(F.col("_from").alias("_k"))), "_k", "left_anti")
    at = cut(step.join(shuffled(ends.select(F.col("_k").alias("_to"), F.lit(True).alias("_done"))), "_to", "left").select("_from", "_to", F.coalesce("_done", F.lit(False)).alias("_done")))
    for _ in range(at.count().bit_length() + 1):
        nxt = at.select(F.col("_from").alias("_to"), F.col("_to").alias("_n"), F.col("_done").alias("_d"))
        open_ = at.where("not _done").join(shuffled(nxt), "_to", "left").select("_from", F.coalesce("_n", "_to").alias("_to"), F.coalesce("_d", F.lit(False)).alias("_done"))
        if open_.isEmpty():
            break
        at = cut(at.where("_done").unionByName(open_))
    return at.where("_done").select("_from", "_to")
