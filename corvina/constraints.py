"""Constraints a Parquet table cannot hold itself, as DataFrames of violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a key with a null is unique."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return df.where(whole).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and meets nothing."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def failing(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which the check is false; null passes, as in SQL."""
    return df.where(~F.coalesce(check, F.lit(True)))


@dataclass
class Rules:
    """What must hold of one table."""

    unique: list[Sequence[str]] = field(default_factory=list)
    references: list[tuple[str, str, str]] = field(default_factory=list)  # column, table, key
    checks: dict[str, Column] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)


def violations(name: str, df: DataFrame, rules: Rules, tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rule, n: every broken rule and how many keys or rows break it."""
    found = []
    for keys in rules.unique:
        found.append((f"unique({', '.join(keys)})", duplicates(df, keys)))
    for column, table, key in rules.references:
        found.append((f"{column} in {table}.{key}", dangling(df, column, tables[table], key)))
    for label, check in rules.checks.items():
        found.append((label, failing(df, check)))
    for c in rules.required:
        found.append((f"{c} not null", df.where(F.col(c).isNull())))
    out = None
    for rule, bad in found:
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return (out if out is not None else df.sparkSession.createDataFrame([], "table_name string, rule string, n long")).where("n > 0")
