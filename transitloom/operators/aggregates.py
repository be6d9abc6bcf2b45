"""Aggregations of links, weights and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def link_statistics(pairs: DataFrame, keys: Sequence[str], time: Column, total_days: int | None = None) -> DataFrame:
    """nservices, avg_time, median_time, std_time (of a sample) and, with `total_days`, avg_freq."""
    out = pairs.groupBy(*keys).agg(F.count("*").alias("nservices"), F.avg(time).alias("avg_time"), F.median(time).alias("median_time"), F.stddev_samp(time).alias("std_time"))
    return out if total_days is None else out.withColumn("avg_freq", F.col("nservices") / total_days)


def weighted_link_statistics(pairs: DataFrame, keys: Sequence[str], time: str, weight: str, total_days: int) -> DataFrame:
    """The same for pairs that each stand for `weight` equal services: dates are never exploded.

    Moments are weighted sums; the median is the weighted percentile.  Equal times are added up first, so no task sorts its
    pairs for the percentile.
    """
    t, w = F.col("_t"), F.col("_w")
    times = pairs.where(F.col(weight) > 0).groupBy(*keys, F.col(time).cast("double").alias("_t")).agg(F.sum(weight).alias("_w"))
    sums = times.groupBy(*keys).agg(F.sum(w).alias("nservices"), (F.sum(t * w) / F.sum(w)).alias("avg_time"), F.percentile(t, F.lit(0.5), w).alias("median_time"), F.sum(t * t * w).alias("_s2"), F.sum(t * w).alias("_s1"))
    n = F.col("nservices")
    var = F.greatest(F.lit(0.0), (F.col("_s2") - F.col("_s1") * F.col("_s1") / n) / (n - 1))
    return sums.withColumn("std_time", F.when(n > 1, F.sqrt(var))).withColumn("avg_freq", n / total_days).drop("_s1", "_s2")


def active_frequency(pairs: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """med_active_freq: the median number of services over the days that have any."""
    daily = pairs.groupBy(*keys, day).agg(F.count("*").alias("_n"))
    return daily.groupBy(*keys).agg(F.median("_n").alias("med_active_freq"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean by weight over rows where both are known."""
    ok = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(ok, value * weight)) / F.sum(F.when(ok, weight))


def mode_label(flags: Column) -> Column:
    """Aggregate over rail flags: Bus, Rail or Both."""
    found = F.array_sort(F.collect_set(flags.cast("int")))
    return F.when(found == F.array(F.lit(0)), "Bus").when(found == F.array(F.lit(1)), "Rail").when(F.size(found) == 2, "Both")


def set_union(sets: Column) -> Column:
    """Aggregate: the sorted union of arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(sets))))


def presence(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """A boolean column for each of `values`: whether the row key occurs with it."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return wide.select(row, *[(F.coalesce(F.col(f"`{v}`"), F.lit(0)) > 0).alias(str(v)) for v in values])


def incidence(df: DataFrame, key: str, columns: Sequence[str], name: str = "column") -> DataFrame:
    """(key, name) of the true cells of a boolean matrix."""
    return df.unpivot(key, list(columns), name, "_value").where("_value").select(key, name)


def coverage(provides: DataFrame, mode: str, provider: str, item: str) -> DataFrame:
    """Providers by descending number of items in a mode, and n_new, the items no larger provider of the mode has.

    Equivalent to adding providers one by one: each item goes to the first provider that has it.  Ties go to the
    smaller provider name.
    """
    items = provides.select(mode, provider, item).distinct()
    size = items.groupBy(mode, provider).agg(F.count("*").alias("n_items"))
    w = Window.partitionBy(mode, item).orderBy(F.desc("n_items"), provider)
    first = items.join(size, [mode, provider]).withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    new = first.groupBy(mode, provider).agg(F.count("*").alias("n_new"))
    return size.join(new, [mode, provider], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)).cast("long"))


def names_by_frequency(df: DataFrame, keys: Sequence[str], name: str, separator: str = " | ") -> DataFrame:
    """names: the distinct names of each group by descending count, ties by name."""
    counts = df.groupBy(*keys, name).agg(F.count("*").alias("_n"))
    entry = F.struct((-F.col("_n")).alias("n"), F.col(name).alias("name"))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["name"]), separator).alias("names"))


def median_lengths(segments: DataFrame, keys: list[str], length: str = "len_km") -> DataFrame:
    """The median of the known lengths of each key's segments; keys without a known length are left out."""
    return segments.where(F.col(length).isNotNull()).groupBy(*keys).agg(F.median(length).alias(length))
