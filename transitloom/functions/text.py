"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_take(c: Column, separator: str, n: int = 1) -> Column:
    """The n-th part (from 1, or from the end if negative) at a literal separator, trimmed."""
    return F.trim(F.split_part(c, F.lit(separator), F.lit(n)))


def strip_chars(c: Column, chars: str) -> Column:
    """Without any leading or trailing characters of the set `chars`."""
    return F.btrim(c, F.lit(chars))


def concat_nulls_empty(separator: str, *cs: Column) -> Column:
    """All parts joined, nulls as empty strings."""
    parts = []
    for i, c in enumerate(cs):
        parts += ([F.lit(separator)] if i else []) + [F.coalesce(c, F.lit(""))]
    return F.concat(*parts)


def padded_id(prefix: str, c: Column, width: int) -> Column:
    """`prefix` and the number, zero-padded to `width`; longer numbers stay whole."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{width}d", c.cast("long")))


def without(c: Column, part: str) -> Column:
    return F.replace(c, F.lit(part), F.lit(""))


def has_digit(c: Column, digit: Column) -> Column:
    return F.contains(c, digit.cast("string"))


def path_leaf(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def without_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def region_of_zone(c: Column) -> Column:
    """`Europe` of `Europe/Paris`."""
    return F.split_part(c, F.lit("/"), F.lit(1))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def is_yyyymmdd(c: Column) -> Column:
    return c.rlike(r"^\d{8}$")


def is_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def blank_to(c: Column, default: str) -> Column:
    """The trimmed text, or `default` where null or blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def top_names(names: Column, separator: str = " | ") -> Column:
    """Names of an array joined by descending frequency, ties by name."""
    distinct = F.array_distinct(names)
    counted = F.transform(distinct, lambda x: F.struct((-F.size(F.filter(names, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(counted), lambda s: s["x"]), separator)


def first_sorted(values: Column, k: int, separator: str = ",") -> Column:
    """The first k of the sorted distinct values, joined."""
    return F.array_join(F.slice(F.array_sort(F.array_distinct(values)), 1, k), separator)
