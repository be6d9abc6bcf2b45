"""Scans and sinks of plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, path: str, columns: Sequence[str] | None = None, missing_ok: bool = False) -> DataFrame | None:
    """A Parquet table, or None where it is missing and that is allowed."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        if missing_ok:
            return None
        raise
    return df.select(*columns) if columns else df


def save(df: DataFrame, path: str, compression: str = "zstd", partition_by: Sequence[str] = (), overwrite: bool = True) -> None:
    """Write a table; an existing one is replaced only with `overwrite`."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).partitionBy(*partition_by).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, names: Mapping[str, str] | None = None, separator: str = ",") -> DataFrame:
    """CSV with a header; `names` selects and renames columns.  Values that don't fit the schema are null."""
    df = spark.read.csv(path, schema=schema, header=True, sep=separator, mode="PERMISSIVE", enforceSchema=False)
    return df.select(*[F.col(a).alias(b) for a, b in names.items()]) if names else df


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; `single` writes one file and is meant for finished, small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def read_many_csv(spark: SparkSession, path: str, schema: StructType | str, name: str, pattern: str = r"([^/]+)\.csv$") -> DataFrame:
    """All CSV files of a folder, with a column taken from the file's name."""
    return spark.read.csv(path, schema=schema, header=True).withColumn(name, F.regexp_extract(F.input_file_name(), pattern, 1))


#: Columns of a flight schedule as published, and as used.
SCHEDULE = {"DEP_AIRPORT_CODE": "src", "ARR_AIRPORT_CODE": "trg", "AIRLINE_CODE": "carrier", "FLIGHT_NO": "flight", "DEPARTURE_TIME": "dep", "ARRIVAL_TIME": "arr", "STOPS": "nstops", "LOCALDAYSOFOP": "op_days", "SEATS_ECO": "seats", "EFFFROM": "start_date", "EFFTO": "end_date"}


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """A flight schedule: distinct rows, times as minutes of the day, dates as dates."""
    from transitloom.functions.times import hhmm_minutes

    raw = spark.read.csv(path, header=True).select(*[F.col(a).alias(b) for a, b in SCHEDULE.items()])
    number = {c: F.col(c).try_cast("int") for c in ("flight", "dep", "arr", "nstops", "seats")}
    day = {c: F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd") for c in ("start_date", "end_date")}
    return raw.withColumns(number | day).withColumns({c: hhmm_minutes(F.col(c)) for c in ("dep", "arr")}).distinct()


def latest_versions(versions: DataFrame, snapshot, key: str = "feed", at: str = "downloaded") -> DataFrame:
    """The catalogue of a snapshot date: each feed's latest version that isn't newer."""
    from transitloom.operators.rows import as_of

    return as_of(versions, [key], at, snapshot, [c for c in versions.columns if c not in (key, at)])


def active_resource(items: DataFrame, keys: Sequence[str], kind: str, active: str = "is_active", order: str = "position") -> DataFrame:
    """The first active item of the format `kind` in the catalogue's order, for each of `keys`."""
    from transitloom.operators.rows import keep_first

    return keep_first(items.where((F.col("format") == kind) & F.col(active)), keys, [F.col(order)])


def newest_resources(packages: DataFrame, period: str, kind: str = "xml") -> DataFrame:
    """For each package the resource of a format, whatever its case or leading dots, whose name holds `period` and that
    was last modified, or else created, latest; the first listed of equals.  Packages without one have no row.

    Packages have `resources`, an array of structs with format, name, last_modified and created.
    """
    fits = lambda r: (F.ltrim(F.lower(F.coalesce(r["format"], F.lit(""))), F.lit(".")) == kind) & F.contains(F.coalesce(r["name"], F.lit("")), F.lit(period))
    at = lambda r: F.coalesce(F.nullif(r["last_modified"], F.lit("")), r["created"], F.lit(""))
    listed = F.transform("resources", lambda r, i: F.struct(at(r).alias("at"), (-i).alias("i"), r.alias("r")))
    ranked = packages.withColumn("_best", F.array_max(F.transform(F.filter(listed, lambda x: fits(x["r"])), lambda x: F.struct(x["at"], x["i"]))))
    found = ranked.where("_best is not null").withColumn("resource", F.get("resources", -F.col("_best.i")))
    return found.drop("_best", "resources")


def verified_files(spark: SparkSession, path: str, expected: DataFrame, name: str = "name", digest: str = "hash") -> DataFrame:
    """(name, state) of files by SHA-256: ok, changed, missing or stale (not expected any more)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.sha2("content", 256).alias("_hash"))
    joined = expected.select(name, digest).join(files, expected[name] == files["_name"], "full")
    state = F.when(F.col("_name").isNull(), "missing").when(F.col(name).isNull(), "stale").when(F.col(digest) == F.col("_hash"), "ok").otherwise("changed")
    return joined.select(F.coalesce(name, "_name").alias("name"), state.alias("state"))
