"""Service calendars: expansion of ranges and day masks, additions and removals, and sets of dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def active_dates(start: Column, end: Column, mask: Column) -> Column:
    """Dates of a range whose Monday-first flag in the array `mask` is 1; empty for a range that ends before it starts."""
    days = F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))
    return F.filter(days, lambda d: F.get(mask, F.weekday(d)) == 1)


def op_days_dates(start: Column, end: Column, op_days: Column) -> Column:
    """Dates of a range whose ISO weekday digit occurs in `op_days`."""
    days = F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))
    return F.filter(days, lambda d: F.contains(op_days, (F.weekday(d) + 1).cast("string")))


def combined(regular: DataFrame, added: DataFrame, removed: DataFrame, mode: str = "set") -> DataFrame:
    """Active (service, date) rows of three tables of (service, date).

    `set` gives (regular or added) without removed; `symdiff` gives rows that occur once in all three together, so that
    a removal of an inactive date counts as active and an addition of an active one is lost.
    """
    if mode == "set":
        return regular.union(added).distinct().join(removed.distinct(), ["service", "date"], "left_anti")
    if mode != "symdiff":
        raise ValueError(f"unknown mode: {mode}")
    every = regular.distinct().union(added.distinct()).union(removed.distinct())
    return every.groupBy("service", "date").agg(F.count("*").alias("n")).where("n = 1").select("service", "date")


def compile_services(calendar: DataFrame, exceptions: DataFrame, start, end, mode: str = "set", shift_months: int = 0) -> DataFrame:
    """(service, date) of a feed's calendar and exceptions (types 1 added, 2 removed), within [start, end).

    Dates are YYYYMMDD numbers.  `shift_months` moves all dates first, for feeds whose years are off.
    """
    day = lambda c: F.add_months(F.try_to_date(F.col(c).cast("string"), "yyyyMMdd"), shift_months)
    lo, hi = F.lit(start), F.date_sub(F.lit(end), 1)
    mask = F.array(*[F.col(d).cast("int") for d in DAYS])
    regular = calendar.select(F.col("service_id").alias("service"), F.explode(active_dates(F.greatest(day("start_date"), lo), F.least(day("end_date"), hi), mask)).alias("date"))
    extra = exceptions.select(F.col("service_id").alias("service"), day("date").alias("date"), F.col("exception_type").cast("int").alias("kind")).where(F.col("date").between(lo, hi))
    pick = lambda k: extra.where(F.col("kind") == k).select("service", "date")
    return combined(regular, pick(1), pick(2), mode)


def datesets(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dateset, dates) of the distinct sets of dates, ids following their order, and (service, dateset)."""
    from transitloom.operators.rows import surrogate_key

    sets = active.groupBy("service").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    ids = surrogate_key(sets.select("dates").distinct(), "dateset", ["dates"])
    return ids, sets.join(ids, "dates").select("service", "dateset")
