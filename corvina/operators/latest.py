"""Keep one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest order columns; equal rows count once.

    A max_by over a struct, so it combines before the shuffle and a hot key never gathers in one task (a window would).
    Ties go to the greatest remaining columns; null order values come last; rows with a null key form their own group.
    """
    rank: Column = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in columns])
    best = df.groupBy(*keys).agg(F.max(rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in columns])
