"""The scheduled network: urban stops, stations, station sequences, timetable, lines, segments and operators.

Frames of a normalised feed are those of `sources.gtfs.normalised`; stops carry x and y in metres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitloom.functions.times import to_gmt, truncated_minutes
from transitloom.operators import aggregates, sequences, spatial
from transitloom.operators.rows import keep_first, surrogate_key
from transitloom.params import DEFAULTS, Params


def urban_stops(stops: DataFrame, city_edges: DataFrame, band: float = 10_000.0) -> DataFrame:
    """Stops (fid, stop_id, ...) that lie in a city, with `fua`; edges are those of `spatial.polygon_edges`."""
    keyed = stops.withColumn("_stop", F.struct("fid", "stop_id"))
    inside = spatial.points_in_polygons(keyed, city_edges, "_stop", "fua", band)
    one = inside.groupBy("_stop").agg(F.min("fua").alias("fua"))
    return keyed.join(one, "_stop").drop("_stop")


def intercity_sequences(stop_seq: DataFrame, urban: DataFrame) -> DataFrame:
    """Stop sequences whose urban stops lie in two cities or more."""
    at = stop_seq.select("fid", "stop_seq", F.explode("stops").alias("stop_id")).join(urban.select("fid", "stop_id", "fua"), ["fid", "stop_id"])
    keep = at.groupBy("stop_seq").agg(F.countDistinct("fua").alias("n")).where("n >= 2").select("stop_seq")
    return stop_seq.join(keep, "stop_seq", "left_semi")


def stations(sequences_: DataFrame, urban: DataFrame, city_edges: DataFrame, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Stations from the urban first and last stops of sequences, and their members (fid, stop_id, stn).

    Stops within the cluster radius of each other, directly or in a chain, form a station at their mean; its name lists
    theirs by frequency.  Stations outside all cities are dropped.
    """
    ends = sequences_.select("fid", F.explode(F.array(F.element_at("stops", 1), F.element_at("stops", -1))).alias("stop_id")).distinct().join(urban, ["fid", "stop_id"])
    ends = ends.withColumn("key", F.concat_ws("|", "fid", "stop_id"))
    clustered = ends.join(spatial.clusters(ends, "key", params.stop_cluster_radius_m), "key")
    centre = clustered.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    named = centre.join(aggregates.names_by_frequency(clustered, ["cluster"], "name"), "cluster")
    inside = spatial.points_in_polygons(named, city_edges, "cluster", "fua", 10_000.0).groupBy("cluster").agg(F.min("fua").alias("fua"))
    table = surrogate_key(named.join(inside, "cluster"), "stn", ["cluster"])
    members = clustered.join(table.select("cluster", "stn"), "cluster").select("fid", "stop_id", "stn")
    return table.select("stn", F.format_string("STN_%04d", "stn").alias("node_id"), F.col("names").alias("name"), "fua", "x", "y"), members


def catchment(stops: DataFrame, station_table: DataFrame, members: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(fid, stop_id, stn): stops within the buffer of a station, and the stations' members."""
    right = station_table.select("stn", F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = spatial.within_distance(stops.select("fid", "stop_id", "x", "y"), right, params.station_buffer_m).select("fid", "stop_id", "stn")
    return members.unionByName(near).distinct()


def station_sequences(stop_seq: DataFrame, stop_stations: DataFrame) -> DataFrame:
    """(stop_seq, positions, stns): the first visit of each station, one station a stop, in order; two stations or more.

    Where a stop belongs to several stations the smallest id stays.
    """
    at = stop_seq.select("fid", "stop_seq", F.posexplode("stops").alias("pos", "stop_id")).join(stop_stations, ["fid", "stop_id"])
    first = keep_first(at, ["stop_seq", "stn"], [F.col("pos")])
    several = first.withColumn("_n", F.count("*").over(Window.partitionBy("stop_seq"))).where("_n > 1").drop("_n")
    one = keep_first(several, ["stop_seq", "pos"], [F.col("stn")])
    g = one.groupBy("stop_seq").agg(F.array_sort(F.collect_list(F.struct("pos", "stn"))).alias("p")).where(F.size("p") > 1)
    return g.select("stop_seq", F.transform("p", lambda e: e["pos"]).alias("positions"), F.transform("p", lambda e: e["stn"]).alias("stns"))


def interstation_timetable(journeys: DataFrame, station_seq: DataFrame, time_seq: DataFrame) -> DataFrame:
    """(jrn, stn, arr, dep) in minutes of GMT for journeys (jrn, stop_seq, time_seq, start, tz_gap in hours)."""
    j = journeys.join(station_seq, "stop_seq").join(time_seq.select("time_seq", "rel", "wait"), "time_seq")
    e = j.select("jrn", "start", "tz_gap", F.inline(F.arrays_zip("stns", sequences.gather(F.col("rel"), F.col("positions")).alias("rel"), sequences.gather(F.col("wait"), F.col("positions")).alias("wait")))).toDF("jrn", "start", "tz_gap", "stn", "rel", "wait").where("rel >= 0")
    arr = to_gmt(F.col("rel") + F.col("start"), 3600 * F.col("tz_gap"))
    t = e.select("jrn", "stn", truncated_minutes(arr).alias("arr"), truncated_minutes(arr + F.col("wait")).alias("dep")).where("arr <= dep")
    return t.withColumn("_n", F.count("*").over(Window.partitionBy("jrn"))).where("_n >= 2").drop("_n")


def lines(timetable: DataFrame, journeys: DataFrame, station_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (agency, rail, tz_gap, stations in order) as lines, with `intercity`, and (jrn, line)."""
    seq = timetable.groupBy("jrn").agg(sequences.ordered_list(F.col("stn"), F.col("arr"), F.col("dep"), F.col("stn")).alias("stns"))
    keys = ["agency", "rail", "tz_gap", "stns"]
    full = seq.join(journeys.select("jrn", "agency", "rail", "tz_gap"), "jrn")
    table = surrogate_key(full.select(*keys).distinct(), "line", keys)
    fuas = table.select("line", F.explode("stns").alias("stn")).join(station_table.select("stn", "fua"), "stn").groupBy("line").agg((F.countDistinct("fua") > 1).alias("intercity"))
    return table.join(fuas, "line", "left").withColumn("intercity", F.coalesce("intercity", F.lit(False))), full.join(table, keys).select("jrn", "line")


def od_support(line_table: DataFrame, station_table: DataFrame) -> DataFrame:
    """(stn, partner, od): for each line's pairs of stations in different cities, the mode and the pair of cities."""
    at = line_table.select("line", "rail", F.posexplode(F.array_distinct("stns")).alias("pos", "stn")).join(station_table.select("stn", "fua"), "stn")
    a, b = at.select("line", "rail", "stn", F.col("fua").alias("fa")), at.select("line", F.col("stn").alias("partner"), F.col("fua").alias("fb"))
    od = F.concat_ws("-", F.col("rail").cast("int").cast("string"), F.least("fa", "fb").cast("string"), F.greatest("fa", "fb").cast("string"))
    return a.join(b, "line").where("fa <> fb").select("stn", "partner", od.alias("od")).distinct()


def served_relations(line_table: DataFrame, station_table: DataFrame) -> DataFrame:
    """(stn, n): for every station the number of relations (mode and pair of cities) of the lines through it."""
    at = line_table.select("line", "rail", F.explode(F.array_distinct("stns")).alias("stn")).join(station_table.select("stn", "fua"), "stn")
    chain = at.groupBy("line", "rail").agg(F.array_sort(F.collect_set("fua")).alias("f"))
    od = chain.select("line", F.explode(sequences.downstream(F.col("f"))).alias("p"), "rail").select("line", F.struct("rail", "p.src", "p.trg").alias("od"))
    n = at.select("line", "stn").join(od, "line").groupBy("stn").agg(F.countDistinct("od").alias("n"))
    return station_table.select("stn").join(n, "stn", "left").select("stn", F.coalesce("n", F.lit(0)).alias("n"))


def truncated_lines(line_table: DataFrame, kept: DataFrame) -> DataFrame:
    """Lines cut to the stations of `kept` (stn); lines with fewer than two are dropped."""
    at = line_table.select("line", F.posexplode("stns").alias("pos", "stn")).join(kept.select("stn"), "stn", "left_semi")
    g = at.groupBy("line").agg(sequences.ordered_list(F.col("stn"), F.col("pos")).alias("_stns")).where(F.size("_stns") > 1)
    return line_table.join(g, "line").withColumn("stns", F.col("_stns")).drop("_stns")


def segments(line_table: DataFrame, station_table: DataFrame) -> DataFrame:
    """(src, trg, mode, lines, intercity) of consecutive stations; mode is Bus, Rail or Both."""
    e = line_table.select("line", "rail", F.inline(sequences.consecutive(F.col("stns"))))
    s = e.groupBy("src", "trg").agg(F.array_sort(F.collect_set("line")).alias("lines"), aggregates.mode_label(F.col("rail")).alias("mode"))
    a, b = station_table.select(F.col("stn").alias("src"), F.col("fua").alias("_a")), station_table.select(F.col("stn").alias("trg"), F.col("fua").alias("_b"))
    return s.join(a, "src").join(b, "trg").withColumn("intercity", F.col("_a") != F.col("_b")).drop("_a", "_b")


def agency_coverage(line_table: DataFrame, station_table: DataFrame, cities: DataFrame, most: int = 5) -> DataFrame:
    """Agencies by mode with n_items, n_new (city pairs no larger agency has) and country codes, in coverage order.

    A line's city pairs chain its cities in the order of their ids.
    """
    at = line_table.select("line", "agency", "rail", F.explode("stns").alias("stn")).join(station_table.select("stn", "fua"), "stn")
    chain = at.groupBy("line", "agency", "rail").agg(F.array_sort(F.collect_set("fua")).alias("f")).where(F.size("f") > 1)
    items = chain.select("agency", "rail", F.explode(sequences.consecutive(F.col("f"))).alias("od"))
    covered = aggregates.coverage(items, "rail", "agency", "od")
    codes = at.join(cities.select("fua", "icc"), "fua").groupBy("agency", "rail").agg(F.array_join(F.slice(F.array_sort(F.collect_set("icc")), 1, most), ",").alias("country"))
    return covered.join(codes, ["agency", "rail"], "left").where("n_new > 0")


def harmonised(line_table: DataFrame, operators: DataFrame, kept: DataFrame, local: str = ".Local") -> DataFrame:
    """Lines with `operator`: intercity lines of known (agency, rail) take theirs; other lines that are not intercity
    keep stations of `kept`, two or more, and the operator `local`."""
    known = operators.select("agency", "rail", "operator").dropDuplicates(["agency", "rail"])
    intercity = line_table.where("intercity").join(known, ["agency", "rail"])
    return intercity.unionByName(truncated_lines(line_table.where("not intercity"), kept).withColumn("operator", F.lit(local)))


def operator_pairs(line_table: DataFrame, segment_lengths: DataFrame, local: str = ".Local") -> DataFrame:
    """(src, trg, rail, operator, dist, n_lines, intercity): median length along the lines' segments of all downstream
    pairs; null if any segment's length is missing for all lines.

    One sort by line gives each stop those after it, and equal distances are counted before medians are taken: no task sorts
    or holds the pairs of its lines.
    """
    steps = F.transform("stns", lambda x, i: F.struct(F.get("stns", i - 1).alias("prev"), x.alias("stn")))
    legs = line_table.where(F.col("operator") != local).select("line", "rail", "operator", "intercity", F.posexplode(steps).alias("pos", "e")).select("line", "rail", "operator", "intercity", "pos", "e.prev", "e.stn")
    legs = legs.join(segment_lengths.select(F.col("src").alias("prev"), F.col("trg").alias("stn"), "rail", "len_km"), ["prev", "stn", "rail"], "left")
    legs = legs.withColumn("len_km", F.when(F.col("pos") == 0, 0.0).otherwise(F.col("len_km")))
    c = sequences.cumulative_pairs(legs, "line", "pos", "len_km")
    w = Window.partitionBy("line").orderBy("pos")
    at = F.struct("stn", "cum", "missing")
    before = F.collect_list("stn").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.collect_list(at).over(w.rowsBetween(1, Window.unboundedFollowing))
    # the first pair of two stations is from the first visit of one to the next visit of the other
    p = c.select("rail", "operator", "intercity", at.alias("a"), before.alias("before"), after.alias("after")).where(~F.array_contains("before", F.col("a.stn")))
    p = p.select("rail", "operator", "intercity", "a", F.transform("after", lambda x: x["stn"]).alias("stns"), F.posexplode("after").alias("j", "b"))
    p = p.where((F.col("a.stn") != F.col("b.stn")) & (F.array_position("stns", F.col("b.stn")) == F.col("j") + 1))
    p = p.select(F.col("a.stn").alias("src"), F.col("b.stn").alias("trg"), "rail", "operator", "intercity", F.when(F.col("a.missing") == F.col("b.missing"), F.col("b.cum") - F.col("a.cum")).alias("dist"))
    n = p.groupBy("src", "trg", "rail", "operator", "dist").agg(F.count("*").alias("n"), F.max("intercity").alias("intercity"))
    return n.groupBy("src", "trg", "rail", "operator").agg(F.percentile("dist", F.lit(0.5), F.col("n")).alias("dist"), F.sum("n").alias("n_lines"), F.max("intercity").alias("intercity"))


def pt_links(timetable: DataFrame, journey_table: DataFrame, line_table: DataFrame, datesets: DataFrame, segment_lengths: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One table of public-transport links: time statistics over all services, and distances.

    Dates stay lists: each timetable pair counts as many services as its dateset has dates.
    """
    pairs = sequences.timetable_pairs(timetable, "jrn", ["arr", "dep", "stn"], "stn", "arr", "dep")
    days = datesets.select("dateset", F.size("dates").cast("long").alias("days"))
    # journeys find their lines before they meet the pairs, which so stay where their trips are
    j = journey_table.select(F.col("jrn").alias("trip"), "line", "dateset").join(days, "dateset").join(line_table.where("operator <> '.Local'").select("line", "rail", "operator"), "line").select("trip", "rail", "operator", "days")
    full = pairs.join(j, "trip").withColumn("time", F.col("arr") - F.col("dep"))
    keys = ["src", "trg", "rail", "operator"]
    return aggregates.weighted_link_statistics(full, keys, "time", "days", params.total_days).join(operator_pairs(line_table, segment_lengths), keys, "left")


def local_links(stops: DataFrame, hubs: DataFrame, trips: DataFrame, stop_seq: DataFrame, time_seq: DataFrame, datesets: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Links between hubs of one city by local trips.

    Hubs have hub, x, y and `fuas`, an array of cities; trips have trip, stop_seq, time_seq, start, dateset and tz_gap.
    Equal departures of a pair on one date count once.
    """
    near = spatial.nearest(stops.select("fid", "stop_id", "x", "y"), hubs.select("hub", F.col("x").alias("rx"), F.col("y").alias("ry")), params.station_buffer_m, ["fid", "stop_id"], "hub").select("fid", "stop_id", "hub")
    at = stop_seq.select("fid", "stop_seq", F.posexplode("stops").alias("pos", "stop_id")).join(near, ["fid", "stop_id"])
    several = at.groupBy("stop_seq").agg(F.array_sort(F.collect_list(F.struct("pos", "hub"))).alias("p")).where(F.size("p") > 1)
    t = trips.join(several, "stop_seq").join(time_seq.select("time_seq", "rel", "wait"), "time_seq").select("trip", "dateset", "start", "tz_gap", F.explode("p").alias("p"), "rel", "wait")
    arr = (F.get("rel", F.col("p.pos")) + F.col("start")) / 60 - 60 * F.col("tz_gap")
    t = t.select("trip", "dateset", F.col("p.hub").alias("hub"), arr.cast("int").alias("arr"), (arr + F.get("wait", F.col("p.pos")) / 60).cast("int").alias("dep")).where("arr >= 0 and dep >= arr and dep <= 1440")
    m = t.groupBy("trip", "dateset", "hub").agg(F.median("arr").cast("int").alias("arr"), F.median("dep").cast("int").alias("dep"))
    fuas = hubs.select("hub", "fuas")
    a = m.join(fuas, "hub").select("trip", "dateset", F.col("hub").alias("src"), "dep", F.col("fuas").alias("fa"))
    b = m.join(fuas, "hub").select("trip", F.col("hub").alias("trg"), "arr", F.col("fuas").alias("fb"))
    pairs = a.join(b, "trip").where("src <> trg and arr > dep").where(F.arrays_overlap("fa", "fb"))
    # dates stay lists: equal departures of a pair have the union of their datesets
    united = pairs.join(datesets, "dateset").groupBy("src", "trg", "dep", "arr").agg(F.array_distinct(F.flatten(F.collect_set("dates"))).alias("dates"))
    weighted = united.select("src", "trg", (F.col("arr") - F.col("dep")).alias("time"), F.size("dates").cast("long").alias("days"))
    return aggregates.weighted_link_statistics(weighted, ["src", "trg"], "time", "days", params.total_days)


def european_routes(routes: DataFrame) -> DataFrame:
    """Routes (tz, ...) whose time zone lies in Europe; unknown zones are left out."""
    return routes.where(F.split_part("tz", F.lit("/"), F.lit(1)) == "Europe")


def reduced(kept_lines: DataFrame, journey_lines: DataFrame, timetable: DataFrame, datesets: DataFrame, segment_table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Journeys (jrn, line, dateset, ...), timetable, datesets and segments that `kept_lines` (line, stns) still need.

    The timetable keeps the stops of a line's stations, of journeys with two or more; a segment stays if a kept line has
    it, with those lines alone.
    """
    j = journey_lines.join(kept_lines.select("line"), "line", "left_semi")
    at = kept_lines.select("line", F.explode(F.array_distinct("stns")).alias("stn"))
    t = timetable.join(j.select("jrn", "line"), "jrn").join(at, ["line", "stn"], "left_semi").drop("line")
    t = t.withColumn("_n", F.count("*").over(Window.partitionBy("jrn"))).where("_n >= 2").drop("_n")
    days = datesets.join(j.select("dateset").distinct(), "dateset", "left_semi")
    legs = kept_lines.select("line", F.inline(sequences.consecutive(F.col("stns")))).groupBy("src", "trg").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return j, t, days, segment_table.drop("lines").join(legs, ["src", "trg"])
