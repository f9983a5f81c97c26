"""Keep the first, the best, or what adds up, per key. All combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The row with the least position per key (positions are unique per key); null keys are a key of their own."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def keep_best(df: DataFrame, keys: Sequence[str], best: Sequence[Column], position: str) -> DataFrame:
    """The row with the greatest values of best per key, ties to the least position. Nulls are least."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[b.alias(f"_b{i}") for i, b in enumerate(best)], (-F.col(position)).alias("_p"))
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_x"))
    return top.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def best_merged(df: DataFrame, keys: Sequence[str], score: str, position: str) -> DataFrame:
    """Per key the last row whose score is at least all before it, with its nulls filled from the row before that one, and
    so on: a fold in order, written as a window over records of equal keys' running maximum."""
    w = Window.partitionBy(*keys).orderBy(position)
    s = F.coalesce(F.col(score), F.lit(float("-inf")))
    kept = df.withColumn("_m", F.max(s).over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_m").isNull() | (s >= F.col("_m")))
    rest = [c for c in df.columns if c not in keys]
    # the latest non-null value of each column in that order
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in rest]
    return kept.groupBy(*keys).agg(*latest).select(*df.columns)


def collapse(df: DataFrame, keys: Sequence[str], best: Sequence[Column], position: str) -> DataFrame:
    """The best row per key at the place of the key's first row."""
    first = df.groupBy(*keys).agg(F.min(position).alias("_first"))
    return keep_best(df, keys, best, position).join(first, list(keys)).withColumn(position, F.col("_first")).drop("_first")


def distinct_in_order(df: DataFrame, key: Column, position: str) -> DataFrame:
    """The first row of each key's value (the first spelling stays)."""
    rest = df.columns
    return df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_x")).select(*[F.col(f"_x.{c}").alias(c) for c in rest])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per key. Spark keeps n rows per key and task before the shuffle (window group limit)."""
    return df.withColumn("_rank_in_key", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank_in_key") <= n).drop("_rank_in_key")


def job_merge(pending: DataFrame, fresh: DataFrame, key: str, position: str) -> DataFrame:
    """Pending jobs keep their window and attempts; new ones come after; each key once."""
    both = pending.withColumn("_late", F.lit(0)).unionByName(fresh.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_late")]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_late", position)).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in rest])
