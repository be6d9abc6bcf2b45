"""Ordered sequences: gathering, gathering by position, pairs, and the expansion of journeys into stop pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitloom.plans.staging import staged


def ordered_list(value: Column, *order: Column) -> Column:
    """Aggregate: the values of a group as an array, in an order without ties."""
    entry = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"])


def relative(a: Column) -> Column:
    """Differences from the first element."""
    return F.transform(a, lambda x: x - F.get(a, F.lit(0)))


def gather(a: Column, positions: Column) -> Column:
    """Elements at positions counted from 0."""
    return F.transform(positions, lambda i: F.get(a, i))


def consecutive(a: Column) -> Column:
    """array<struct<src, trg>> of neighbours; empty for fewer than two elements."""
    return F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("src"), F.get(a, i + 1).alias("trg")))


def downstream(a: Column) -> Column:
    """array<struct<i, j, src, trg>> of all pairs i < j of a sequence."""
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y, j: F.struct(i.alias("i"), (i + 1 + j).alias("j"), x.alias("src"), y.alias("trg")))))


def undirected(u: Column, v: Column) -> tuple[Column, Column]:
    return F.least(u, v), F.greatest(u, v)


def timetable_pairs(events: DataFrame, trip: str, order: Sequence[str], station: str, arr: str, dep: str, drop_self: bool = False, positive_only: bool = False) -> DataFrame:
    """(trip, src, trg, dep, arr) for every stop and every later stop of each trip.

    One shuffle by trip numbers the stops; the self-join reuses that partitioning.
    """
    # the number comes before any renaming, so that the window's partitioning by trip serves the join as well
    numbered = events.withColumn("pos", F.row_number().over(Window.partitionBy(trip).orderBy(*order)))
    stops = numbered.select(F.col(trip).alias("trip"), F.col(station).alias("stn"), F.col(arr).alias("arr"), F.col(dep).alias("dep"), "pos")
    a = stops.select("trip", F.col("stn").alias("src"), "dep", F.col("pos").alias("i"))
    b = stops.select("trip", F.col("stn").alias("trg"), "arr", F.col("pos").alias("j"))
    pairs = a.join(b, "trip").where("i < j")
    if drop_self:
        pairs = pairs.where("src <> trg")
    if positive_only:
        pairs = pairs.where("arr > dep")
    return pairs.select("trip", "src", "trg", "dep", "arr")


def first_visits(events: DataFrame, trip: str, order: Sequence[str], station: str) -> DataFrame:
    """Events without later visits of a station by the same trip."""
    w = Window.partitionBy(trip, station).orderBy(*order)
    return events.withColumn("_visit", F.row_number().over(w)).where("_visit = 1").drop("_visit")


def cumulative_pairs(legs: DataFrame, line: str, position: str, length: str) -> DataFrame:
    """Cumulative length and number of missing lengths at each position of a line: the distance between two positions
    is the difference of `cum`, and null if `missing` differs."""
    w = Window.partitionBy(line).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return legs.withColumn("cum", F.sum(F.coalesce(F.col(length), F.lit(0))).over(w)).withColumn("missing", F.sum(F.col(length).isNull().cast("int")).over(w))


def distinct_sequences(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(seq, n): distinct sequences of the groups and how many groups have each."""
    return df.groupBy(*keys).agg(ordered_list(F.col(value), *[F.col(c) for c in order]).alias("seq")).groupBy("seq").agg(F.count("*").alias("n"))


def run_starts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start, n): the runs of equal keys in the table ordered by them, with the place of each run's first row,
    counted from 0.

    Runs are dealt to tasks by range; only one number a task is collected.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    parts = staged(counts.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "runs")
    before, total = {}, 0
    for r in parts.groupBy("_part").agg(F.sum("n").alias("n")).orderBy("_part").collect():
        before[r["_part"]], total = total, total + r["n"]
    w = Window.partitionBy("_part").orderBy(*keys)
    offset = F.element_at(F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(max(before, default=0) + 1)]), F.col("_part") + 1)
    return parts.select(*keys, (offset + F.sum("n").over(w) - F.col("n")).alias("start"), "n")


def flattened(df: DataFrame, key: str, lists: str) -> tuple[DataFrame, DataFrame]:
    """Lists laid end to end in the order of their unique keys: (key, start, n), with n = 0 for null and empty ones, and
    (place, value)."""
    items = df.select(F.col(key), F.posexplode_outer(lists).alias("_i", "value"))
    sizes = df.select(F.col(key), F.greatest(F.lit(0), F.coalesce(F.size(lists), F.lit(0))).alias("n"))
    starts = run_starts(items.where("_i is not null").select(key), [key])
    heads = sizes.join(starts.select(key, "start"), key, "left").select(key, "start", "n")
    return heads, items.where("_i is not null").join(starts.select(key, "start"), key).select((F.col("start") + F.col("_i")).alias("place"), "value")
