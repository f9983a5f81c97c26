"""Counts, differences and fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_delta(before: DataFrame, after: DataFrame, key: str, count: str) -> DataFrame:
    """key, before, after, delta over all keys of either; a missing count is 0."""
    b, a = before.select(key, F.col(count).alias("before")), after.select(key, F.col(count).alias("after"))
    return b.join(a, key, "full_outer").fillna(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and order-free checksums of the content. Equal tables have equal fingerprints; no row travels.

    Each row's SHA-256 is taken over its columns by name: whole numbers as digits, fractions with six decimals, times as
    microseconds, booleans as true and false; a null has no text, unlike an empty one. checksum: exclusive or of the first 60
    bits of all; total: sum of the first 32, so that pairs of equal rows do not cancel out.
    """

    def text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        as_text = F.unix_micros(c.cast("timestamp")).cast("string") if kind.startswith("timestamp") else F.format_string("%.6f", c.cast("double")) if kind in ("double", "float") else c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), as_text))

    sha = F.sha2(F.concat_ws("\x1f", *[text(n, k) for n, k in sorted(df.dtypes)]), 256)
    number = lambda digits: F.conv(F.substring(sha, 1, digits), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(number(15)), F.lit(0)).alias("checksum"), F.coalesce(F.sum(number(8)), F.lit(0)).alias("total"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, each as often."""
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def changed(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys both have whose columns differ (nulls are equal to nulls)."""
    o, n = old.alias("o"), new.alias("n")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return o.join(n, keys).where(differs).select(*keys)


def stale(done: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """What still has to be done: wanted rows whose keys (id, content hash, model, ...) are not done yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
