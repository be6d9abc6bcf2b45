"""GTFS export: stop times with day shifts, services, calendar dates, and archives."""

from __future__ import annotations

import csv
import io
import os
import tempfile
import zipfile
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitloom.functions.times import date_code, minutes_clock
from transitloom.operators.rows import export_route_type, surrogate_key
from transitloom.operators.sequences import consecutive
from transitloom.operators.shapes import cumulative_m

#: Of compression in `archives`: stop times take a quarter of the time that they do by default, and 15 % more room.
LEVEL = 4


def shifted(times: DataFrame) -> DataFrame:
    """jrn, stn, arr, dep in minutes of a service day that no journey begins before, and day_shift (0 or -1).

    Journeys whose first arrival is negative move to the day before; more than a day before is an error.
    """
    first = times.groupBy("jrn").agg(F.min("arr").alias("first"))
    early = F.when(F.col("first") < -1440, F.raise_error(F.lit("a journey begins more than a day before its date"))).when(F.col("first") < 0, 1440).otherwise(0)
    t = times.join(first, "jrn").withColumn("_move", early.cast("int"))
    return t.select("jrn", "stn", (F.col("arr") + F.col("_move")).alias("arr"), (F.col("dep") + F.col("_move")).alias("dep"), F.when(F.col("_move") > 0, -1).otherwise(0).alias("day_shift"))


def services(journeys: DataFrame) -> DataFrame:
    """(dateset, day_shift, service_id) of the distinct pairs."""
    s = surrogate_key(journeys.select("dateset", "day_shift").distinct(), "service", ["dateset", "day_shift"])
    return s.select("dateset", "day_shift", F.format_string("S%06d", "service").alias("service_id"))


def calendar_dates(datesets: DataFrame, service_table: DataFrame) -> DataFrame:
    """service_id, date (YYYYMMDD) and exception_type 1 of every active date, moved by the day shift."""
    d = service_table.join(datesets, "dateset").select("service_id", F.explode("dates").alias("d"), "day_shift")
    return d.select("service_id", date_code(F.date_add("d", F.col("day_shift"))).alias("date"), F.lit(1).alias("exception_type"))


def stop_times(times: DataFrame) -> DataFrame:
    """trip_id, arrival_time, departure_time, stop_id and stop_sequence of shifted times."""
    w = Window.partitionBy("jrn").orderBy("arr", "dep", "stn")
    return times.select(F.col("jrn").cast("string").alias("trip_id"), minutes_clock(F.col("arr")).alias("arrival_time"), minutes_clock(F.col("dep")).alias("departure_time"), F.col("stn").cast("string").alias("stop_id"), F.row_number().over(w).alias("stop_sequence"))


def routes(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Routes of lines (line, agency, rail, first, last): `first - last` by the stations' first names."""
    n = names.select("stn", F.trim(F.split_part("name", F.lit(" | "), F.lit(1))).alias("n"))
    a, b = n.select(F.col("stn").alias("first"), F.col("n").alias("na")), n.select(F.col("stn").alias("last"), F.col("n").alias("nb"))
    return lines.join(a, "first").join(b, "last").select(F.format_string("IC-%05d", F.col("line").cast("long")).alias("route_id"), F.col("agency").alias("agency_id"), F.concat_ws(" - ", "na", "nb").alias("route_long_name"), export_route_type(F.col("rail")).alias("route_type"))


def agencies(lines: DataFrame, url: str, timezone: str, unknown: str = "Unknown agency") -> tuple[DataFrame, DataFrame]:
    """Agencies with ids from 1 in the order of their trimmed names, and `lines` with agency_id; lines without a name
    are of the agency `unknown`."""
    named = lines.withColumn("agency_name", F.coalesce(F.nullif(F.trim("agency"), F.lit("")), F.lit(unknown)))
    keyed = surrogate_key(named.select("agency_name").distinct(), "_k", ["agency_name"]).select((F.col("_k") + 1).alias("agency_id"), "agency_name")
    table = keyed.select("agency_id", "agency_name", F.lit(url).alias("agency_url"), F.lit(timezone).alias("agency_timezone"))
    return table, named.join(keyed, "agency_name").drop("agency_name")


def stops(stations: DataFrame) -> DataFrame:
    """Stops of stations (stn, name, lon, lat); a coordinate outside its range is an error."""

    def within(c: str, bound: int):
        return F.when(F.col(c).between(-bound, bound), F.col(c)).otherwise(F.raise_error(F.lit(f"a station's {c} is missing or out of range")).cast("double"))

    return stations.select(F.col("stn").alias("stop_id"), F.trim("name").alias("stop_name"), within("lat", 90).alias("stop_lat"), within("lon", 180).alias("stop_lon"), F.lit(0).alias("location_type"))


def _legs(segments: DataFrame, stations: DataFrame) -> DataFrame:
    """(src, trg, mode, pts, km): each segment's points (x, y, d) from station to station, d in kilometres from its start.

    A line that ends nearer to the source than it starts is turned; points that repeat the one before are left out.
    """
    a = stations.select(F.col("stn").alias("src"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("a"))
    b = stations.select(F.col("stn").alias("trg"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("b"))
    away = lambda q: F.pow(q["x"] - F.col("a.x"), 2) + F.pow(q["y"] - F.col("a.y"), 2)
    line = F.when(away(F.element_at("line", -1)) < away(F.element_at("line", 1)), F.reverse("line")).otherwise(F.col("line"))
    short = segments.where(F.size("line") > 0).join(a, "src").join(b, "trg")
    short = short.select("src", "trg", "mode", F.transform(F.concat(F.array("a"), line, F.array("b")), lambda q: F.struct(F.round(q["x"], 7).alias("x"), F.round(q["y"], 7).alias("y"))).alias("q"))
    short = short.withColumn("q", F.filter("q", lambda p, i: (i == 0) | (p != F.get("q", i - 1))))
    points = short.select(F.struct("src", "trg", "mode").alias("leg"), F.posexplode("q").alias("i", "q")).select("leg", "i", F.col("q.x").alias("lon"), F.col("q.y").alias("lat"))
    g = cumulative_m(points, "leg", "i").groupBy("leg").agg(F.array_sort(F.collect_list(F.struct("i", F.col("lon").alias("x"), F.col("lat").alias("y"), (F.col("dist") / 1000).alias("d")))).alias("pts"))
    return g.select("leg.*", "pts", F.element_at("pts", -1)["d"].alias("km"))


def line_shapes(lines: DataFrame, segments: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shape points, (line, shape_id), and (line, stop_sequence, shape_dist_traveled) of lines (line, rail, stns).

    Lines of one mode with the same stations share a shape; a line without a geometry for each of its legs has none.
    Segments are (src, trg, mode, line), with a mode of Rail or Bus; each is measured once, however many lines use it.
    """
    mode = F.when(F.col("rail"), "Rail").otherwise("Bus")
    pattern = lines.select("rail", "stns").where(F.size("stns") > 1).distinct()
    legs = pattern.select("rail", "stns", F.posexplode(consecutive(F.col("stns"))).alias("leg", "e")).select("rail", "stns", "leg", "e.*", mode.alias("mode"))
    met = legs.join(_legs(segments, stations), ["src", "trg", "mode"])
    whole = met.groupBy("rail", "stns").agg(F.count("*").alias("n")).where(F.col("n") == F.size("stns") - 1).select("rail", "stns")
    ids = surrogate_key(whole, "_k", ["rail", "stns"]).select("rail", "stns", (F.col("_k") + 1).alias("shape_id"))
    before = Window.partitionBy("shape_id").orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    placed = met.join(ids, ["rail", "stns"]).withColumn("start", F.coalesce(F.sum("km").over(before), F.lit(0.0)))
    # a leg's first point is the last of the leg before
    points = placed.select("shape_id", "leg", "start", F.explode("pts").alias("p")).where("leg = 0 or p.i > 0")
    order = Window.partitionBy("shape_id").orderBy("leg", "p.i")
    shape = points.select("shape_id", F.col("p.y").alias("shape_pt_lat"), F.col("p.x").alias("shape_pt_lon"), F.row_number().over(order).alias("shape_pt_sequence"), (F.col("start") + F.col("p.d")).alias("shape_dist_traveled"))
    of = lines.select("line", "rail", "stns").join(ids, ["rail", "stns"]).select("line", "shape_id")
    at = lambda k, d: F.struct(k.cast("int").alias("stop_sequence"), d.alias("shape_dist_traveled"))
    end = F.array(at(F.col("leg") + 2, F.col("start") + F.col("km")))
    ends = placed.select("shape_id", F.inline(F.when(F.col("leg") == 0, F.concat(F.array(at(F.lit(1), F.lit(0.0))), end)).otherwise(end)))
    return shape, of, of.join(ends, "shape_id").drop("shape_id")


def feed_info(dates: DataFrame, publisher: str, url: str, language: str, version: str) -> DataFrame:
    """One row: the publisher, and the first and last date of calendar dates."""
    span = dates.agg(F.min("date").alias("feed_start_date"), F.max("date").alias("feed_end_date"))
    return span.select(F.lit(publisher).alias("feed_publisher_name"), F.lit(url).alias("feed_publisher_url"), F.lit(language).alias("feed_lang"), "feed_start_date", "feed_end_date", F.lit(version).alias("feed_version"), F.lit(url).alias("feed_contact_url"))


def feed(stations: DataFrame, lines: DataFrame, journeys: DataFrame, datesets: DataFrame, timetable: DataFrame, segments: DataFrame, *, publisher: str, url: str, timezone: str, version: str, language: str = "en") -> dict[str, DataFrame]:
    """All members of a feed of lines (line, agency, rail, stns), journeys (jrn, line, dateset) and a timetable (jrn,
    stn, arr, dep); stations are those of `stops`, segments those of `line_shapes`."""
    agency, owned = agencies(lines, url, timezone)
    first_name = stations.select("stn", F.trim(F.split_part("name", F.lit(" | "), F.lit(1))).alias("n"))
    a, b = first_name.toDF("_from", "na"), first_name.toDF("_to", "nb")
    named = owned.withColumns({"_from": F.element_at("stns", 1), "_to": F.element_at("stns", -1)}).join(a, "_from", "left").join(b, "_to", "left")
    long_name = F.when(F.col("na").isNull() | F.col("nb").isNull(), F.raise_error(F.lit("a line ends at an unknown station")).cast("string")).otherwise(F.concat("na", F.lit(" \u2013 "), "nb"))
    route = named.select(F.col("line").alias("route_id"), "agency_id", F.concat(F.lit("IC-"), F.lpad(F.col("line").cast("string"), F.greatest(F.lit(5), F.length(F.col("line").cast("string"))), F.lit("0"))).alias("route_short_name"), long_name.alias("route_long_name"), export_route_type(F.col("rail")).alias("route_type"))
    moved = shifted(timetable)
    run = journeys.join(moved.select("jrn", "day_shift").distinct(), "jrn")
    service = services(run)
    shape, shape_of, at = line_shapes(lines, segments, stations)
    trip = run.join(service, ["dateset", "day_shift"]).join(shape_of, "line", "left").select(F.col("line").alias("route_id"), "service_id", F.col("jrn").cast("string").alias("trip_id"), "shape_id")
    times = stop_times(moved).join(trip.select("trip_id", F.col("route_id").alias("line")), "trip_id").join(at, ["line", "stop_sequence"], "left")
    dates = calendar_dates(datesets, service)
    return {
        "agency": agency,
        "stops": stops(stations),
        "routes": route,
        "trips": trip,
        "stop_times": times.select("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "shape_dist_traveled"),
        "calendar_dates": dates,
        "shapes": shape,
        "feed_info": feed_info(dates, publisher, url, language, version),
    }


def all_days(trips: DataFrame, validity: DataFrame) -> DataFrame:
    """A calendar: every service of `trips` runs on all days of the one row (from_date, to_date) of `validity`."""
    days = [F.lit(1).alias(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")]
    code = lambda c: F.date_format(c, "yyyyMMdd")
    return trips.select("service_id").distinct().crossJoin(F.broadcast(validity)).select("service_id", *days, code("from_date").alias("start_date"), code("to_date").alias("end_date"))  # one row


def minimal_feed(agency: tuple[str, str, str, str], validity: DataFrame, stop_table: DataFrame, routes_: DataFrame, trips: DataFrame, times: DataFrame, language: str) -> dict[str, DataFrame]:
    """The members of a feed without calendars of its own; `agency` is its id, name, URL and time zone."""
    code = lambda c: F.date_format(c, "yyyyMMdd")
    row = validity.select(*[F.lit(v).alias(c) for v, c in zip(agency, ("agency_id", "agency_name", "agency_url", "agency_timezone"), strict=True)])
    info = validity.select(F.lit(agency[1]).alias("feed_publisher_name"), F.lit(agency[2]).alias("feed_publisher_url"), F.lit(language).alias("feed_lang"), code("from_date").alias("feed_start_date"), code("to_date").alias("feed_end_date"))
    return {"agency": row, "stops": stop_table, "routes": routes_, "trips": trips, "stop_times": times, "calendar": all_days(trips, validity), "feed_info": info}


def archives(tables: dict[str, DataFrame]) -> DataFrame:
    """(fid, content): a GTFS ZIP of each feed, made in the tasks, as `gtfs.archives` reads them.

    Every table has a text column `fid`; its other columns are the member's.  Rows come to their feed's task as sorted
    CSV lines and are compressed as they come, so that a task holds one archive, of at most 2 GB.  An archive that is
    made again has the same names and dates.  Rows without a feed are left out, and so are members without rows.
    """
    options = {"escape": '"', "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names, headers, lines = list(tables), [], None
    for k, df in enumerate(tables.values()):
        columns = [c for c in df.columns if c != "fid"]
        headers.append(",".join(columns))
        part = df.where("fid is not null").select("fid", F.lit(k).alias("k"), F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string") for c in columns]), options).alias("line"))
        lines = part if lines is None else lines.union(part)

    def runs(batches):
        """(fid, k, text) of the lines of a batch that belong to one member."""
        for b in batches:
            fids, k, text = b.columns
            place = fids.dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (np.diff(k.to_numpy()) != 0)))[: b.num_rows]
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, b.num_rows], pa.int32()), text.cast(pa.string())), "\n")
            for i, lines in zip(starts.tolist(), whole.to_pylist(), strict=True):
                yield fids[i].as_py(), k[i].as_py(), lines

    def run(batches):
        for fid, own in groupby(runs(batches), key=itemgetter(0)):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as archive:
                for k, member in groupby(own, key=itemgetter(1)):
                    entry = zipfile.ZipInfo(f"{names[k]}.txt")
                    entry.compress_type, entry.compress_level = zipfile.ZIP_DEFLATED, LEVEL
                    with archive.open(entry, "w", force_zip64=True) as raw:
                        raw.write(f"{headers[k]}\n".encode())
                        for _, _, text in member:
                            raw.write(f"{text}\n".encode())
            yield pa.record_batch([pa.array([fid]), pa.array([held.getvalue()])], names=["fid", "content"])

    return lines.repartition("fid").sortWithinPartitions("fid", "k", "line").mapInArrow(run, "fid string, content binary")


def write_archive(tables: dict[str, DataFrame], path: str) -> None:
    """A GTFS ZIP of finished tables on the driver's disk: rows stream through the driver one partition at a time, and
    the file appears under its name only when complete and readable."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".part")
    os.close(handle)
    try:
        with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, df in tables.items():
                with archive.open(f"{name}.txt", "w", force_zip64=True) as raw, io.TextIOWrapper(raw, encoding="utf-8", newline="") as out:
                    writer = csv.writer(out)
                    writer.writerow(df.columns)
                    for row in df.toLocalIterator():
                        writer.writerow(["" if v is None else v for v in row])
        with zipfile.ZipFile(temporary) as archive:
            if (bad := archive.testzip()) is not None:
                raise zipfile.BadZipFile(f"{bad} is damaged")
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
