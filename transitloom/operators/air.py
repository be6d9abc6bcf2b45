"""The aviation layer: airports and their catchments, the flight timetable and its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.functions.geo import haversine_km, project
from transitloom.functions.times import day_offset, to_gmt
from transitloom.operators import aggregates, calendar, rows, spatial
from transitloom.params import DEFAULTS, Params


def airports(listed: DataFrame, schedule: DataFrame, offsets: DataFrame, cities: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Airports (iata, icao, lon, lat, zone) that the schedule serves, with node_id, utc_offset (minutes) and `fuas`,
    the cities (fua, x, y) whose centres lie in the catchment; airports without any are dropped."""
    served = schedule.select(F.col("src").alias("iata")).union(schedule.select("trg")).distinct()
    known = listed.dropDuplicates(["iata"]).join(served, "iata", "left_semi").join(offsets.select("zone", F.col("offset").alias("utc_offset")), "zone").where("utc_offset is not null")
    x, y = project(F.col("lon"), F.col("lat"))
    placed = known.withColumn("x", x).withColumn("y", y)
    near = spatial.within_distance(placed.select("iata", "x", "y"), cities.select("fua", F.col("x").alias("rx"), F.col("y").alias("ry")), params.airport_catchment_m)
    fuas = near.groupBy("iata").agg(F.array_sort(F.collect_set("fua")).alias("fuas"))
    return placed.join(fuas, "iata").withColumn("node_id", F.concat(F.lit("AIR_"), "iata"))


def timetable(schedule: DataFrame, airport_table: DataFrame, carriers: DataFrame, params: Params = DEFAULTS, wrap_overnight: bool = False, strict: bool = False) -> DataFrame:
    """Flights between retained airports in UTC minutes, with the array `dates` of active dates and `operator`.

    Carriers without a name keep their code, or are dropped with `strict`; with `wrap_overnight` an arrival before its
    departure counts as on the next day.
    """
    a = airport_table.select("iata", "utc_offset")
    f = schedule.where("src <> trg").join(a.toDF("src", "_s"), "src").join(a.toDF("trg", "_t"), "trg")
    f = f.withColumns({"dep": to_gmt(F.col("dep"), F.col("_s")), "arr": to_gmt(F.col("arr"), F.col("_t"))}).drop("_s", "_t")
    if wrap_overnight:
        f = f.withColumn("arr", F.when(F.col("arr") < F.col("dep"), F.col("arr") + 1440).otherwise(F.col("arr")))
    start, end = F.greatest("start_date", F.lit(params.service_start)), F.least("end_date", F.lit(params.service_end))
    f = f.withColumn("dates", calendar.op_days_dates(start, end, F.col("op_days"))).where(F.size("dates") > 0)
    named = rows.lookup(f, carriers, "carrier", "carrier", "name", "operator", keep_missing=not strict)
    return named.where("operator is not null")


def dated(timetable_: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row a flight and date; `date` counts days of the service window."""
    d = timetable_.withColumn("_d", F.explode("dates"))
    return d.withColumn("date", day_offset(F.col("_d"), params.service_start)).drop("_d", "dates")


def links(timetable_: DataFrame, airport_table: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """src, trg, operator, nservices, time statistics, avg_freq and dist (whole km along the great circle)."""
    t = timetable_.withColumn("days", F.size("dates").cast("long")).withColumn("time", F.col("arr") - F.col("dep"))
    s = aggregates.weighted_link_statistics(t, ["src", "trg", "operator"], "time", "days", params.total_days)
    a = airport_table.select("iata", "lon", "lat")
    j = s.join(a.toDF("src", "lon1", "lat1"), "src").join(a.toDF("trg", "lon2", "lat2"), "trg")
    return j.withColumn("dist", haversine_km(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")).cast("int")).drop("lon1", "lat1", "lon2", "lat2")
