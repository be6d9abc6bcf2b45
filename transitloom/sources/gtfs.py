"""GTFS archives: scans of their members, inventory, and normalisation of whole feeds.

Feeds are read as binary files and opened in the tasks, so that all feeds make one job; the feed is a column (`fid`).
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Sequence
from itertools import islice, zip_longest

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitloom.functions.text import blank_to, is_digits, strip_chars
from transitloom.functions.times import clock_seconds
from transitloom.operators import calendar
from transitloom.operators.rows import surrogate_key
from transitloom.operators.sequences import relative
from transitloom.params import DEFAULTS, Params
from transitloom.plans.staging import staged

TABLES = ("agency", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates")
REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")
#: Rows of a member that a task holds at a time.
ROWS = 50_000


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(fid, content) of the ZIP files of a folder; fid is the file's name without its ending."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("fid"), "content")


def read_table(feeds: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Text columns of one member of all archives, with fid.

    Header cells are trimmed; missing columns, members and unreadable archives give nulls or no rows.
    """
    schema = ", ".join(f"`{c}` string" for c in ("fid", *columns))
    names = ["fid", *columns]

    def parts(batches):
        for batch in batches:
            for fid, content in zip(batch.column("fid").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except (zipfile.BadZipFile, TypeError):
                    continue
                member = next((x for x in archive.namelist() if x.rsplit("/", 1)[-1].rsplit(".", 1)[0] == table), None)
                if member is None:
                    continue
                with archive.open(member) as raw:
                    reader = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline=""))
                    header = [h.strip() for h in next(reader, [])]
                    place = [header.index(c) if c in header else None for c in columns]
                    while block := list(islice(reader, ROWS)):
                        lines = [line for line in block if line]
                        cells = list(zip_longest(*lines, fillvalue=""))
                        texts = [pa.array(cells[i], pa.string()) if i is not None and i < len(cells) else pa.nulls(len(lines), pa.string()) for i in place]
                        yield pa.record_batch([pa.repeat(pa.scalar(fid, pa.string()), len(lines)), *[pc.if_else(pc.equal(x, ""), pa.scalar(None, pa.string()), x) for x in texts]], names=names)

    def run(batches):
        held, n = [], 0
        for part in parts(batches):
            held.append(part)
            n += part.num_rows
            if n >= ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if n:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return feeds.mapInArrow(run, schema)


def inventory(feeds: DataFrame) -> DataFrame:
    """fid, size_zip and size_unzip (MiB), one flag for each table, and valid: required members present and intact."""

    def run(batches):
        for batch in batches:
            out = []
            for fid, content in zip(batch.column("fid").to_pylist(), batch.column("content").to_pylist(), strict=True):
                size, found, intact = 0, set(), True
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    size = sum(x.file_size for x in archive.infolist())
                    found = {x.rsplit("/", 1)[-1].rsplit(".", 1)[0] for x in archive.namelist()}
                    intact = archive.testzip() is None
                except (zipfile.BadZipFile, TypeError):
                    intact = False
                out.append((fid, len(content or b"") / 2**20, size / 2**20, *[t in found for t in TABLES], intact and found.issuperset(REQUIRED)))
            if out:
                kinds = [pa.string(), pa.float64(), pa.float64(), *[pa.bool_()] * (len(TABLES) + 1)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["fid", "size_zip", "size_unzip", *[f"f_{t}" for t in TABLES], "valid"])

    return feeds.mapInArrow(run, "fid string, size_zip double, size_unzip double, " + ", ".join(f"f_{t} boolean" for t in TABLES) + ", valid boolean")


def stops(feeds: DataFrame) -> DataFrame:
    raw = read_table(feeds, "stops", ["stop_id", "stop_name", "stop_lon", "stop_lat"])
    return raw.select("fid", "stop_id", F.col("stop_name").alias("name"), F.trim("stop_lon").try_cast("double").alias("lon"), F.trim("stop_lat").try_cast("double").alias("lat"))


def routes(feeds: DataFrame) -> DataFrame:
    """fid, route_id, name (short | long), agency, tz and mode_id (numeric route type); agencies join on their id, and
    where a feed has one agency its routes may leave it out."""
    r = read_table(feeds, "routes", ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type"]).where(is_digits(F.trim("route_type")))
    a = read_table(feeds, "agency", ["agency_id", "agency_name", "agency_timezone"])
    only = a.groupBy("fid").agg(F.count("*").alias("n"), F.first("agency_name").alias("only_name"), F.first("agency_timezone").alias("only_tz")).where("n = 1").drop("n")
    name = strip_chars(F.concat(F.coalesce("route_short_name", F.lit("")), F.lit(" | "), F.coalesce("route_long_name", F.lit(""))), " |")
    joined = r.join(a, ["fid", "agency_id"], "left").join(only, "fid", "left")
    return joined.select("fid", "route_id", name.alias("name"), blank_to(F.coalesce("agency_name", "only_name"), "Unknown").alias("agency"), F.coalesce("agency_timezone", "only_tz").alias("tz"), F.trim("route_type").cast("int").alias("mode_id"))


def _active(feeds: DataFrame, params: Params, mode: str, shift_months: int) -> DataFrame:
    """(service, date) of all feeds; a service is a struct of fid and service_id."""
    cal = read_table(feeds, "calendar", ["service_id", *calendar.DAYS, "start_date", "end_date"])
    extra = read_table(feeds, "calendar_dates", ["service_id", "date", "exception_type"])
    key = F.struct("fid", "service_id")
    return calendar.compile_services(cal.withColumn("service_id", key), extra.withColumn("service_id", key), params.calendar_start, params.calendar_end, mode, shift_months)


def _times(feeds: DataFrame, params: Params) -> DataFrame:
    """fid, trip_id, stop_id, pos, arr and dep of all stop times with a place and both times."""
    times = read_table(feeds, "stop_times", ["trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"])
    times = times.select("fid", "trip_id", "stop_id", F.trim("stop_sequence").try_cast("int").alias("pos"), clock_seconds(F.col("arrival_time")).alias("arr"), clock_seconds(F.col("departure_time")).alias("dep"))
    return times.where(F.col("pos") <= params.max_stop_sequence).na.drop(subset=["arr", "dep"])


def used_routes(feeds: DataFrame, params: Params = DEFAULTS, mode: str = "set", shift_months: int = 0) -> DataFrame:
    """The routes of `normalised` by themselves: no sequence is put together, sorted or numbered for them."""
    route_table = staged(routes(feeds), "routes")
    services = _active(feeds, params, mode, shift_months).select("service.fid", "service.service_id").distinct()
    trips = read_table(feeds, "trips", ["trip_id", "route_id", "service_id"]).join(route_table.select("fid", "route_id"), ["fid", "route_id"], "left_semi").join(services, ["fid", "service_id"], "left_semi")
    called = _times(feeds, params).select("fid", "trip_id", "stop_id").join(trips.select("fid", "trip_id", "route_id"), ["fid", "trip_id"]).select("fid", "route_id", "stop_id").distinct()
    used = called.join(stops(feeds).select("fid", "stop_id"), ["fid", "stop_id"], "left_semi").select("fid", "route_id").distinct()
    return route_table.join(used, ["fid", "route_id"], "left_semi")


def normalised(feeds: DataFrame, params: Params = DEFAULTS, mode: str = "set", shift_months: int = 0) -> dict[str, DataFrame]:
    """Tables of all feeds: stops, routes, datesets, stop_seq, time_seq and trips, with repeated sequences stored once.

    Trips without an active date, without a known route or without usable stop times vanish; routes without trips too.
    """
    t = read_table(feeds, "trips", ["trip_id", "route_id", "service_id"])
    dates, of = calendar.datesets(staged(_active(feeds, params, mode, shift_months), "active"))
    of = of.select("service.fid", "service.service_id", "dateset")

    # members are read from their archives once: the tables below use these several times
    stop_table, route_table = stops(feeds), staged(routes(feeds), "routes")
    trips = staged(t.join(route_table.select("fid", "route_id"), ["fid", "route_id"], "left_semi").join(of, ["fid", "service_id"]), "trips")
    times = _times(feeds, params).join(stop_table.select("fid", "stop_id"), ["fid", "stop_id"], "left_semi").join(trips.select("fid", "trip_id"), ["fid", "trip_id"], "left_semi")
    call = F.struct("pos", "arr", "stop_id", (F.col("dep") - F.col("arr")).alias("wait"))
    calls = times.groupBy("fid", "trip_id").agg(F.array_sort(F.collect_list(call)).alias("c"))
    by_trip = staged(calls.select("fid", "trip_id", F.col("c.stop_id").alias("stops"), relative(F.col("c.arr")).alias("rel"), F.col("c.wait").alias("wait"), F.element_at("c.arr", 1).alias("start"), F.element_at("c.arr", -1).alias("end")), "by_trip")
    stop_seq = surrogate_key(by_trip.select("fid", "stops").distinct(), "stop_seq", ["fid", "stops"])
    time_seq = surrogate_key(by_trip.groupBy("fid", "rel").agg(F.min_by("wait", "trip_id").alias("wait")), "time_seq", ["fid", "rel"])
    used = trips.join(by_trip.select("fid", "trip_id"), ["fid", "trip_id"]).select("fid", "route_id").distinct()
    full = trips.join(by_trip, ["fid", "trip_id"]).join(stop_seq, ["fid", "stops"]).join(time_seq.select("fid", "rel", "time_seq"), ["fid", "rel"])
    full = full.select("fid", "trip_id", "route_id", "dateset", "stop_seq", "time_seq", "start", "end")
    return {"stops": stop_table, "routes": route_table.join(used, ["fid", "route_id"], "left_semi"), "datesets": dates, "stop_seq": stop_seq, "time_seq": time_seq, "trips": full}
