"""NeTEx documents: stops, lines, journeys and their passing times, read by the XML source with one row tag each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "Location struct<Latitude: string, Longitude: string, pos: string, coordinates: string>"
PLACE = f"_id string, Name string, Latitude string, Longitude string, Centroid struct<{POINT.replace('Location ', 'Location: ')}>, {POINT}, StopPlaceRef struct<_ref: string>"
PASSING = "struct<StopPointInJourneyPatternRef: struct<_ref: string>, ScheduledStopPointRef: struct<_ref: string>, StopPointRef: struct<_ref: string>, QuayRef: struct<_ref: string>, StopPlaceRef: struct<_ref: string>, ArrivalTime: string, DepartureTime: string, Arrival: struct<Time: string>, Departure: struct<Time: string>>"
JOURNEY = f"_id string, Name string, LineRef struct<_ref: string>, RouteRef struct<_ref: string>, dayTypes struct<DayTypeRef: array<struct<_ref: string>>>, passingTimes struct<TimetabledPassingTime: array<{PASSING}>>"


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)


def mentions(spark: SparkSession, path: str, tag: str) -> bool:
    """Whether a document's text holds the name of an element that begins: far cheaper than a search for its elements."""
    pieces = spark.read.option("lineSep", ">").text(path)
    return not pieces.where(F.col("value").contains(tag) & F.col("value").rlike(f"<([^<>/\\s]+:)?{tag}(\\s|/|$)")).isEmpty()


def iso_date(c: Column) -> Column:
    """The date that begins an ISO date or time; null otherwise."""
    return F.try_to_date(F.nullif(F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")


def iso_time(c: Column) -> Column:
    """HH:MM:SS of an ISO time or date and time; null otherwise."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"T(\d{2}:\d{2}:\d{2})", 1), F.lit("")), F.nullif(F.regexp_extract(F.trim(c), r"^(\d{2}:\d{2}:\d{2})", 1), F.lit("")))


def _pair(c: Column) -> tuple[Column, Column]:
    """lat and lon of two numbers in one text: lat first, unless only the first can't be a latitude."""
    parts = F.split(F.trim(c), "[ ,]+")
    a, b = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    swap = (F.abs(a) > 90) & (F.abs(b) <= 90)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(swap, b).otherwise(a)), F.when(a.isNotNull() & b.isNotNull(), F.when(swap, a).otherwise(b))


def coordinates() -> tuple[Column, Column]:
    """lat and lon of a place: named elements, then `pos`, then `coordinates`."""
    lat, lon = [], []
    for at in ("", "Centroid.Location.", "Location."):
        a, b = F.trim(f"{at}Latitude").try_cast("double"), F.trim(f"{at}Longitude").try_cast("double")
        known = a.isNotNull() & b.isNotNull()
        lat.append(F.when(known, a))
        lon.append(F.when(known, b))
    for field in ("pos", "coordinates"):
        for at in ("Centroid.Location.", "Location."):
            a, b = _pair(F.col(f"{at}{field}"))
            lat.append(a)
            lon.append(b)
    return F.coalesce(*lat), F.coalesce(*lon)


def validity(spark: SparkSession, path: str, start: str = "2026-01-01", end: str = "2026-12-31") -> DataFrame:
    """One row (from_date, to_date): the document's first validity, or the given dates for what it lacks.

    The format puts a composite frame's validity before those of the frames in it, so no task reads a whole frame.
    """
    v = elements(spark, path, "ValidBetween", "FromDate string, ToDate string")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    first = v.select(place.alias("place"), F.struct(iso_date(F.col("FromDate")).alias("a"), iso_date(F.col("ToDate")).alias("b")).alias("v")).agg(F.min_by("v", "place").alias("v"))
    return first.select(F.coalesce("v.a", F.lit(start).cast("date")).alias("from_date"), F.coalesce("v.b", F.lit(end).cast("date")).alias("to_date"))


def stops(spark: SparkSession, path: str) -> DataFrame:
    """stop_id, stop_name, stop_lat, stop_lon, location_type and parent_station of stop places, quays and stop points.

    Rows of one id are merged, stop places first, then quays, then stop points: the first known value of each column
    stays.  Quays and points without coordinates take those of their stop place.
    """
    lat, lon = coordinates()
    parts = []
    for order, (tag, kind) in enumerate((("StopPlace", 1), ("Quay", 0), ("ScheduledStopPoint", 0))):
        e = elements(spark, path, tag, PLACE).where("_id is not null")
        parent = F.lit(None).cast("string") if kind else F.col("StopPlaceRef._ref")
        parts.append(e.select(F.lit(order).alias("o"), F.col("_id").alias("stop_id"), F.coalesce(F.nullif(F.trim("Name"), F.lit("")), "_id").alias("name"), lat.alias("lat"), lon.alias("lon"), F.lit(kind).alias("kind"), parent.alias("parent")))
    places = parts[0].groupBy(F.col("stop_id").alias("place")).agg(F.first("lat", True).alias("plat"), F.first("lon", True).alias("plon"))
    every = parts[0].union(parts[1]).union(parts[2]).join(places, F.col("parent") == F.col("place"), "left")
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    every = every.withColumns({"lat": F.when(known, F.col("lat")).otherwise(F.col("plat")), "lon": F.when(known, F.col("lon")).otherwise(F.col("plon"))})
    first = lambda c: F.get(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(c).alias("v")))), lambda x: x["v"]), lambda v: v.isNotNull()), 0)
    return every.groupBy("stop_id").agg(first("name").alias("stop_name"), first("lat").alias("stop_lat"), first("lon").alias("stop_lon"), F.max("kind").alias("location_type"), first("parent").alias("parent_station"))


def routes(spark: SparkSession, path: str, agency: str) -> DataFrame:
    """Lines as routes or, in a document without lines, its routes."""

    def of(tag: str) -> DataFrame:
        e = elements(spark, path, tag, "_id string, Name string, PublicCode string").where("_id is not null")
        name = F.coalesce(F.nullif(F.trim("Name"), F.lit("")), "_id")
        short = F.coalesce(F.nullif(F.trim("PublicCode"), F.lit("")), name) if tag == "Line" else name
        return e.select(F.col("_id").alias("route_id"), F.lit(agency).alias("agency_id"), F.left(short, F.lit(50)).alias("route_short_name"), F.left(name, F.lit(1000)).alias("route_long_name"), F.lit(2).alias("route_type"))

    found = of("Line")
    return (of("Route") if found.isEmpty() else found).dropDuplicates(["route_id"])


def journeys(spark: SparkSession, path: str, route_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """trips (route_id, service_id, trip_id, trip_headsign) and stop_times of service and vehicle journeys.

    A journey's route is its line, or else its route, if known, or else the first route; without a day type its service
    is ALL_DAYS.  Stops without any time or reference are left out; of one missing time the other is used.
    """
    j = elements(spark, path, "ServiceJourney", JOURNEY)
    if mentions(spark, path, "VehicleJourney"):
        j = j.unionByName(elements(spark, path, "VehicleJourney", JOURNEY))
    j = j.where("_id is not null")
    known = route_table.select("route_id")
    fallback = known.agg(F.coalesce(F.min("route_id"), F.lit("UNKNOWN_ROUTE")).alias("fallback"))
    line, route = known.withColumnRenamed("route_id", "line"), known.withColumnRenamed("route_id", "route")
    t = j.join(line, F.col("LineRef._ref") == F.col("line"), "left").join(route, F.col("RouteRef._ref") == F.col("route"), "left").crossJoin(F.broadcast(fallback))  # one row
    service = F.element_at(F.transform("dayTypes.DayTypeRef", lambda d: d["_ref"]), -1)
    trips = t.select(F.coalesce("line", "route", "fallback").alias("route_id"), F.coalesce(F.when(F.size("dayTypes.DayTypeRef") > 0, service), F.lit("ALL_DAYS")).alias("service_id"), F.col("_id").alias("trip_id"), F.coalesce(F.nullif(F.trim("Name"), F.lit("")), F.lit("")).alias("trip_headsign"))
    p = j.select(F.col("_id").alias("trip_id"), F.posexplode("passingTimes.TimetabledPassingTime").alias("at", "p"))
    ref = F.coalesce(*[F.col(f"p.{k}._ref") for k in ("StopPointInJourneyPatternRef", "ScheduledStopPointRef", "StopPointRef", "QuayRef", "StopPlaceRef")])
    arr, dep = F.coalesce(iso_time(F.col("p.ArrivalTime")), iso_time(F.col("p.Arrival.Time"))), F.coalesce(iso_time(F.col("p.DepartureTime")), iso_time(F.col("p.Departure.Time")))
    s = p.select("trip_id", "at", F.coalesce(arr, dep).alias("arrival_time"), F.coalesce(dep, arr).alias("departure_time"), ref.alias("stop_id")).where("stop_id is not null and arrival_time is not null")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("trip_id").orderBy("at"))
    return trips, s.withColumn("stop_sequence", number).drop("at")


def pattern_stops(spark: SparkSession, path: str) -> DataFrame:
    """(point, stop_id) of points in journey patterns: quays before scheduled stop points before stop places."""
    e = elements(spark, path, "StopPointInJourneyPattern", "_id string, QuayRef struct<_ref: string>, ScheduledStopPointRef struct<_ref: string>, StopPlaceRef struct<_ref: string>")
    stop = F.coalesce("QuayRef._ref", "ScheduledStopPointRef._ref", "StopPlaceRef._ref")
    return e.select(F.col("_id").alias("point"), stop.alias("stop_id")).where("point is not null and stop_id is not null").dropDuplicates(["point"])


def with_station_coordinates(stop_table: DataFrame, stations: DataFrame) -> DataFrame:
    """Names and coordinates of a station list (uic, name, lon, lat), matched by the number after the country code."""
    code = F.substring(F.element_at(F.split("stop_id", ":"), -1), 3, 100).try_cast("int")
    s = stations.na.drop().select(F.substring(F.col("uic").cast("string"), 3, 100).try_cast("int").alias("code"), F.col("name").alias("stop_name"), F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"))
    return stop_table.select("stop_id", "location_type", "parent_station", code.alias("code")).join(s, "code").drop("code")
