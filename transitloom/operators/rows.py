"""Row-level operators: projection, filters, keys, duplicates and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitloom.params import BUS_TYPES, RAIL_TYPES


def rail_flag(route_type: Column) -> Column:
    """True for rail, False for bus, null for any other route type."""
    return F.when(route_type.isin(*RAIL_TYPES), True).when(route_type.isin(*BUS_TYPES), False)


def export_route_type(rail: Column) -> Column:
    return F.when(rail, 2).otherwise(3)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first by `order`, which should leave no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def exactly_once(df: DataFrame) -> DataFrame:
    """Rows that occur once in the table."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def surrogate_key(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """Dense ids from 0 in the order of natural keys, without a global sort in one task.

    Rows are range-partitioned by the keys; ids are a partition's offset and a row number within it.  Offsets come
    from one count a partition.
    """
    from transitloom.plans.staging import staged

    ranged = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    w = Window.partitionBy("_part").orderBy(*order)
    numbered = ranged.join(F.broadcast(table), "_part").withColumn(name, F.col("_offset") + F.row_number().over(w) - 1)
    return numbered.drop("_part", "_offset")


def dense_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Codes from 0 of the sorted distinct values of a column; null stays null."""
    codes = surrogate_key(df.select(column).where(F.col(column).isNotNull()).distinct(), name, [column])
    return df.join(codes, column, "left")


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows by column name; columns that are missing somewhere are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row for each key, from the first frame that has it."""
    marked = [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)]
    return keep_first(union_all(*marked), keys, [F.col("_from"), *[F.col(c) for c in frames[0].columns if c not in keys]]).drop("_from")


def within_box(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def finite(*columns: Column) -> Column:
    """Whether all values are numbers other than null, NaN and the infinities."""
    return reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns])


def ordered_times(arr: Column, dep: Column, most: int = 1440) -> Column:
    """0 <= arr <= dep <= most."""
    return (arr >= 0) & (dep >= arr) & (dep <= most)


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, name: str, keep_missing: bool = False) -> DataFrame:
    """`value` of the row of `table` with this key; missing keys give null, or the key itself with `keep_missing`."""
    t = table.select(F.col(table_key).alias("_key"), F.col(value).alias("_value"))
    joined = df.join(t, df[key] == F.col("_key"), "left")
    found = F.coalesce("_value", key) if keep_missing else F.col("_value")
    return joined.withColumn("_found", found).drop("_key", "_value").withColumn(name, F.col("_found")).drop("_found")


def many_to_one(df: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join whose right side has each key once at most; a repeated key is an error."""
    if not right.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys are not unique: {', '.join(keys)}")
    return df.join(right, list(keys), how)


def reindexed(keys: DataFrame, df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of `df` for given keys; missing ones are null."""
    return keys.join(df, list(on), "left")


def as_of(df: DataFrame, keys: Sequence[str], at: str, snapshot, ties: Sequence[str] = ()) -> DataFrame:
    """The latest row of each key that isn't later than `snapshot`."""
    return keep_last(df.where(F.col(at) <= snapshot), keys, [at, *ties])
