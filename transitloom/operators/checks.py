"""Checks of tables: rows that break a rule, and reports that count them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nulls(df: DataFrame, *columns: str) -> DataFrame:
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).isNull()
    return df.where(cond)


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).count().where("count > 1")


def outside(df: DataFrame, column: str, least, most) -> DataFrame:
    return df.where(~F.col(column).between(least, most))


def unknown(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value is no key of `other`; nulls are not counted."""
    keys = other.select(F.col(other_column).alias("_key")).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, df[column] == keys["_key"], "left_anti")


def unordered(df: DataFrame, group: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """Rows whose value is below the one before in their group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_prev", F.lag(column).over(w)).where(F.col(column) < F.col("_prev")).drop("_prev")


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def report(found: dict[str, DataFrame]) -> DataFrame:
    """(check, violations): the number of rows of each frame."""
    out = None
    for name, df in found.items():
        row = df.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def require(report_frame: DataFrame) -> None:
    """Raise if a report has violations."""
    bad = report_frame.where("violations > 0").collect()  # one row a check
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))


def any_of(*flags: str):
    """Whether one of a row's flags is true; a flag that is null counts as false."""
    return F.exists(F.array(*[F.coalesce(F.col(c), F.lit(False)) for c in flags]), lambda x: x)


def all_of(*flags: str):
    """Whether all of a row's flags are true; a flag that is null counts as false."""
    return F.forall(F.array(*[F.coalesce(F.col(c), F.lit(False)) for c in flags]), lambda x: x)
