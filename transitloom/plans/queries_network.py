"""Queries of the scheduled network and of flights, each through the composite operator that it names.

Stand-ins: suppliers are stops, placed where `embeddings` has a row of their number, and nations the cities they lie in;
orders are journeys and their line items the stops of each, in order; flights lead from a customer's nation to a supplier's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from transitloom.operators import air, graph, network, sequences, spatial
from transitloom.params import DEFAULTS
from transitloom.plans.catalogue import query
from transitloom.plans.frames import ORDER, journeys, points
from transitloom.plans.queries_graph import EDGES, PT, RINGS
from transitloom.plans.queries_links import EV, rounded

STOP = PT + ", stop AS (SELECT s_suppkey AS stop_id, s_nationkey AS fua, s_name AS name, x, y FROM supplier JOIN pt ON id = s_suppkey)"
CROSSED = "e AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, a, b, c, d in EDGES) + ") v(poly, x0, y0, x1, y1))"
INSIDE = "((y0 > y) <> (y1 > y)) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0"
VISIT = "visit AS (SELECT l_orderkey AS trip, l_suppkey AS stop_id, CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INT) AS t, CAST(l_quantity AS INT) AS wait, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem)"


def stops(t):
    s = t("supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("fua"))
    return points(t).select(F.col("id").alias("stop_id"), "x", "y").join(s, "stop_id").select(F.lit("f").alias("fid"), "stop_id", "name", "fua", "x", "y")


def suppliers(t, name):
    return t("supplier").select(F.lit("f").alias("fid"), F.col("s_suppkey").alias("stop_id"), F.col("s_nationkey").alias(name))


def stop_sequences(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("stop_seq")).agg(sequences.ordered_list(F.col("l_suppkey"), *[F.col(c) for c in ORDER]).alias("stops")).select(F.lit("f").alias("fid"), "stop_seq", "stops")


def city_edges(spark):
    polygons = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in RINGS.items()], "fua int, ring array<struct<x: double, y: double>>")
    return spatial.polygon_edges(polygons, "fua", "ring")


@query(STOP + f", {CROSSED}, c AS (SELECT stop_id, poly FROM stop, e WHERE {INSIDE} GROUP BY ALL HAVING count(*) % 2 = 1) SELECT stop_id, min(poly) AS fua FROM c GROUP BY stop_id")
def urban_stops(t, spark):
    return network.urban_stops(stops(t).drop("fua"), city_edges(spark)).select("stop_id", "fua")


@query(f"WITH {VISIT} SELECT trip AS stop_seq FROM visit JOIN supplier ON stop_id = s_suppkey GROUP BY trip HAVING count(DISTINCT s_nationkey) >= 2")
def intercity_sequences(t, spark):
    return network.intercity_sequences(stop_sequences(t), suppliers(t, "fua")).select("stop_seq")


STATIONS = (
    STOP.replace("WITH", "WITH RECURSIVE")
    + f""", {CROSSED}, {VISIT}, tip AS (SELECT DISTINCT s.*, 'f|' || stop_id AS k FROM stop s JOIN (SELECT arg_min(stop_id, pos) AS stop_id FROM visit GROUP BY trip UNION SELECT arg_max(stop_id, pos) FROM visit GROUP BY trip) USING (stop_id)),
  near AS (SELECT a.k AS u, b.k AS v FROM tip a JOIN tip b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {DEFAULTS.stop_cluster_radius_m}),
  r AS (SELECT k, k AS c FROM tip UNION SELECT near.v, r.c FROM r JOIN near ON near.u = r.k), member AS (SELECT tip.*, cluster FROM tip JOIN (SELECT k, min(c) AS cluster FROM r GROUP BY k) USING (k)),
  centre AS (SELECT cluster, avg(x) AS x, avg(y) AS y FROM member GROUP BY 1), names AS (SELECT cluster, array_to_string(list(name ORDER BY n DESC, name), ' | ') AS name FROM (SELECT cluster, name, count(*) AS n FROM member GROUP BY ALL) GROUP BY 1),
  city AS (SELECT cluster, min(poly) AS fua FROM (SELECT cluster, poly FROM centre, e WHERE {INSIDE} GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY 1),
  station AS (SELECT row_number() OVER (ORDER BY cluster) - 1 AS stn, * FROM centre JOIN names USING (cluster) JOIN city USING (cluster))"""
)


@query(STATIONS + " SELECT stn, 'STN_' || lpad(CAST(stn AS VARCHAR), 4, '0') AS node_id, name, fua, round(x, 3) AS x, round(y, 3) AS y FROM station")
def stations(t, spark):
    table, _ = network.stations(stop_sequences(t), stops(t), city_edges(spark))
    return rounded(table, "x", "y", digits=3)


@query(STATIONS + f" SELECT stop_id, stn FROM member JOIN station USING (cluster) UNION SELECT stop.stop_id, stn FROM stop JOIN station s ON sqrt((stop.x - s.x) * (stop.x - s.x) + (stop.y - s.y) * (stop.y - s.y)) <= {DEFAULTS.station_buffer_m}")
def station_catchment(t, spark):
    table, members = network.stations(stop_sequences(t), stops(t), city_edges(spark))
    return network.catchment(stops(t), table, members).select("stop_id", "stn")


SEEN = f"{VISIT}, seen AS (SELECT trip, s_nationkey AS stn, min(pos) AS pos FROM visit JOIN supplier ON stop_id = s_suppkey GROUP BY ALL), ranked AS (SELECT *, count(*) OVER (PARTITION BY trip) AS k FROM seen)"


@query(f"WITH {SEEN} SELECT trip AS stop_seq, array_to_string(list(pos ORDER BY pos), ',') AS positions, array_to_string(list(stn ORDER BY pos), ',') AS stns FROM ranked WHERE k > 1 GROUP BY trip")
def station_sequences(t, spark):
    s = network.station_sequences(stop_sequences(t), suppliers(t, "stn"))
    return s.select("stop_seq", F.array_join("positions", ",").alias("positions"), F.array_join("stns", ",").alias("stns"))


@query(
    f"""WITH {SEEN}, timed AS (SELECT r.trip AS jrn, r.stn, 60 * (v.t - f.t) + 7 * v.pos + 600 * (r.trip % 7) - 3600 * (r.trip % 3) AS arr, v.wait FROM ranked r JOIN visit v ON r.trip = v.trip AND r.pos = v.pos JOIN visit f ON r.trip = f.trip AND f.pos = 0 WHERE k > 1),
  m AS (SELECT jrn, stn, CAST(trunc(arr / 60) AS INT) AS arr, CAST(trunc((arr + 30 * wait) / 60) AS INT) AS dep FROM timed), n AS (SELECT *, count(*) OVER (PARTITION BY jrn) AS k FROM m WHERE arr <= dep) SELECT jrn, stn, arr, dep FROM n WHERE k >= 2"""
)
def interstation_timetable(t, spark):
    e = t("lineitem").withColumn("t", F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")))
    g = e.groupBy(F.col("l_orderkey").alias("time_seq")).agg(*[sequences.ordered_list(F.col(c), *[F.col(o) for o in ORDER]).alias(c) for c in ("t", "l_quantity")])
    times = g.select("time_seq", F.transform(sequences.relative(F.col("t")), lambda x, i: 60 * x + 7 * i).alias("rel"), F.transform("l_quantity", lambda x: 30 * x.cast("int")).alias("wait"))
    trip = F.col("time_seq")
    j = g.select(trip.alias("jrn"), trip.alias("stop_seq"), "time_seq", (600 * (trip % 7)).alias("start"), (trip % 3).alias("tz_gap"))
    return network.interstation_timetable(j, network.station_sequences(stop_sequences(t), suppliers(t, "stn")), times)


LINES = (
    EV
    + """, jl AS (SELECT trip, list(stn ORDER BY t, t, stn) AS stns, trip % 7 AS agency, trip % 2 = 0 AS rail, trip % 3 AS tz_gap FROM ev GROUP BY trip),
  lines AS (SELECT row_number() OVER (ORDER BY agency, rail, tz_gap, stns) AS line, *, (SELECT count(DISTINCT n_regionkey) > 1 FROM nation WHERE list_contains(stns, n_nationkey)) AS intercity FROM (SELECT agency, rail, tz_gap, stns, count(*) AS n_journeys FROM jl GROUP BY ALL))"""
)


def line_tables(t):
    e = journeys(t).select(F.col("trip").alias("jrn"), "stn", F.col("t").alias("arr"), F.col("t").alias("dep"))
    trip = F.col("o_orderkey")
    j = t("orders").select(trip.alias("jrn"), (trip % 7).alias("agency"), (trip % 2 == 0).alias("rail"), (trip % 3).alias("tz_gap"))
    return network.lines(e, j, station_regions(t))


def station_regions(t):
    return t("nation").select(F.col("n_nationkey").alias("stn"), F.col("n_regionkey").alias("fua"))


@query(LINES + " SELECT agency, rail, tz_gap, array_to_string(stns, ',') AS stns, intercity, n_journeys FROM lines")
def line_table(t, spark):
    table, of = line_tables(t)
    return table.join(of.groupBy("line").agg(F.count("*").alias("n_journeys")), "line").select("agency", "rail", "tz_gap", F.array_join("stns", ",").alias("stns"), "intercity", "n_journeys")


@query(
    LINES
    + """, k AS (SELECT line, agency, rail, tz_gap, list_filter(stns, lambda s: s NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)) AS stns FROM lines) SELECT agency, rail, tz_gap, array_to_string(stns, ',') AS stns, count(*) AS n FROM k WHERE len(stns) > 1 GROUP BY ALL""".replace("list_filter(stns, lambda s: s NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0))", "(SELECT list(s ORDER BY i) FROM (SELECT unnest(stns) AS s, generate_subscripts(stns, 1) AS i) WHERE s IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0))")
)
def truncated_lines(t, spark):
    kept = station_regions(t).where("fua > 0").select("stn")
    return network.truncated_lines(line_tables(t)[0], kept).groupBy("agency", "rail", "tz_gap", F.array_join("stns", ",").alias("stns")).agg(F.count("*").alias("n"))


STEPS = LINES + ", st AS (SELECT line, agency, rail, intercity, unnest(stns) AS stn, generate_subscripts(stns, 1) AS pos FROM lines), leg AS (SELECT line, rail, lag(stn) OVER (PARTITION BY line ORDER BY pos) AS src, stn AS trg, pos FROM st)"


@query(STEPS + " SELECT src, trg, CASE WHEN bool_and(rail) THEN 'Rail' WHEN bool_or(rail) THEN 'Both' ELSE 'Bus' END AS mode, count(DISTINCT line) AS n_lines, any_value(a.n_regionkey <> b.n_regionkey) AS intercity FROM leg JOIN nation a ON src = a.n_nationkey JOIN nation b ON trg = b.n_nationkey GROUP BY src, trg")
def line_segments(t, spark):
    s = network.segments(line_tables(t)[0], station_regions(t))
    return s.select("src", "trg", "mode", F.size("lines").cast("long").alias("n_lines"), "intercity")


@query(STEPS + " SELECT DISTINCT a.stn, b.stn AS partner, CAST(CAST(a.rail AS INT) AS VARCHAR) || '-' || least(x.n_regionkey, y.n_regionkey) || '-' || greatest(x.n_regionkey, y.n_regionkey) AS od FROM st a JOIN st b ON a.line = b.line JOIN nation x ON a.stn = x.n_nationkey JOIN nation y ON b.stn = y.n_nationkey WHERE x.n_regionkey <> y.n_regionkey")
def od_support(t, spark):
    return network.od_support(line_tables(t)[0], station_regions(t))


@query(STEPS + ", f AS (SELECT DISTINCT line, rail, n_regionkey AS g FROM st JOIN nation ON stn = n_nationkey), od AS (SELECT a.line, a.rail, a.g AS fa, b.g AS fb FROM f a JOIN f b ON a.line = b.line AND a.g < b.g), u AS (SELECT DISTINCT st.stn, od.rail, fa, fb FROM st JOIN od ON st.line = od.line) SELECT n_nationkey AS stn, count(u.stn) AS n FROM nation LEFT JOIN u ON u.stn = n_nationkey GROUP BY 1")
def served_relations(t, spark):
    return network.served_relations(line_tables(t)[0], station_regions(t))


@query(
    STEPS.replace("WITH", "WITH RECURSIVE", 1)
    + """, sup AS (SELECT DISTINCT a.stn, b.stn AS partner, a.rail::INT || '-' || least(x.n_regionkey, y.n_regionkey) || '-' || greatest(x.n_regionkey, y.n_regionkey) AS od FROM st a JOIN st b ON a.line = b.line JOIN nation x ON a.stn = x.n_nationkey JOIN nation y ON b.stn = y.n_nationkey WHERE x.n_regionkey <> y.n_regionkey AND a.stn < b.stn),
  f AS (SELECT DISTINCT line, rail, n_regionkey AS g FROM st JOIN nation ON stn = n_nationkey), od AS (SELECT a.line, a.rail, a.g AS fa, b.g AS fb FROM f a JOIN f b ON a.line = b.line AND a.g < b.g), u AS (SELECT DISTINCT st.stn, od.rail, fa, fb FROM st JOIN od ON st.line = od.line),
  turn AS (SELECT stn, row_number() OVER (ORDER BY n, stn) AS i FROM (SELECT n_nationkey AS stn, count(u.stn) AS n FROM nation LEFT JOIN u ON u.stn = n_nationkey GROUP BY 1)),
  loop AS (SELECT 0 AS i, (SELECT list(struct_pack(a := stn, b := partner, od := od)) FROM sup) AS alive, NULL::INT AS stn, false AS gone
    UNION ALL SELECT i, CASE WHEN goes THEN list_filter(alive, lambda p: p.a <> stn AND p.b <> stn) ELSE alive END, stn, goes FROM (SELECT turn.i, alive, turn.stn,
      coalesce((SELECT bool_and(others > 0) FROM (SELECT p.od, count_if(p.a <> turn.stn AND p.b <> turn.stn) AS others FROM (SELECT unnest(alive) AS p) GROUP BY p.od)), true) AS goes FROM loop JOIN turn ON turn.i = loop.i + 1))
  SELECT stn FROM loop WHERE gone"""
)
def greedy_station_prune(t, spark):
    table, stations_ = line_tables(t)[0], station_regions(t)
    return graph.redundant_stations(network.od_support(table, stations_), network.served_relations(table, stations_))


@query(
    STEPS
    + """, len AS (SELECT a.n_nationkey AS src, b.n_nationkey AS trg, rail, 10.0 + abs(a.n_nationkey - b.n_nationkey) AS km FROM nation a, nation b, (VALUES (true), (false)) v(rail) WHERE a.n_regionkey > 0 OR b.n_regionkey > 1),
  o AS (SELECT st.line, st.rail, agency, intercity, st.stn, st.pos, CASE WHEN st.pos = 1 THEN 0.0 ELSE km END AS km FROM st LEFT JOIN leg ON st.line = leg.line AND st.pos = leg.pos LEFT JOIN len ON len.src = leg.src AND len.trg = leg.trg AND len.rail = st.rail WHERE agency > 0),
  c AS (SELECT *, sum(coalesce(km, 0)) OVER w AS cum, count(*) FILTER (km IS NULL) OVER w AS miss FROM o WINDOW w AS (PARTITION BY line ORDER BY pos)),
  p AS (SELECT a.line, a.rail, a.agency, a.intercity, a.stn AS src, b.stn AS trg, CASE WHEN a.miss = b.miss THEN b.cum - a.cum END AS dist, row_number() OVER (PARTITION BY a.line, a.stn, b.stn ORDER BY a.pos, b.pos) AS k FROM c a JOIN c b ON a.line = b.line AND a.pos < b.pos AND a.stn <> b.stn)
  SELECT src, trg, rail, 'A' || agency AS operator, median(dist)::DOUBLE AS dist, count(*) AS n_lines, bool_or(intercity) AS intercity FROM p WHERE k = 1 GROUP BY ALL"""
)
def operator_pair_distances(t, spark):
    table = line_tables(t)[0].withColumn("operator", F.when(F.col("agency") > 0, F.concat(F.lit("A"), "agency")).otherwise(".Local"))
    a = station_regions(t).select(F.col("stn").alias("src"), F.col("fua").alias("fa"))
    b = station_regions(t).select(F.col("stn").alias("trg"), F.col("fua").alias("fb"))
    modes = spark.createDataFrame([(True,), (False,)], "rail boolean")
    lengths = a.crossJoin(b).crossJoin(modes).where("fa > 0 or fb > 1").select("src", "trg", "rail", (10.0 + F.abs(F.col("src") - F.col("trg"))).alias("len_km"))
    return network.operator_pairs(table, lengths)


@query(
    STOP
    + f""", hub AS (SELECT stop_id AS hub, x, y, fua FROM stop WHERE stop_id IN (SELECT min(stop_id) FROM stop GROUP BY fua)),
  near AS (SELECT stop_id, hub, fua FROM (SELECT stop.stop_id, hub, hub.fua, row_number() OVER (PARTITION BY stop.stop_id ORDER BY sqrt((stop.x - hub.x) * (stop.x - hub.x) + (stop.y - hub.y) * (stop.y - hub.y)), hub) AS k FROM stop JOIN hub ON sqrt((stop.x - hub.x) * (stop.x - hub.x) + (stop.y - hub.y) * (stop.y - hub.y)) <= 4000.0) WHERE k = 1),
  {VISIT}, m AS (SELECT v.trip, hub, fua, 60.0 * (v.t - f.t) / 60 + 60 * (v.trip % 7) - 60 * (v.trip % 3) AS a, v.wait / 60.0 AS w FROM visit v JOIN near USING (stop_id) JOIN visit f ON v.trip = f.trip AND f.pos = 0),
  c AS (SELECT trip, hub, fua, CAST(trunc(a) AS INT) AS arr, CAST(trunc(a + w) AS INT) AS dep, count(*) OVER (PARTITION BY trip) AS k FROM m),
  h AS (SELECT trip, hub, fua, CAST(trunc(median(arr)) AS INT) AS arr, CAST(trunc(median(dep)) AS INT) AS dep FROM c WHERE k > 1 AND arr >= 0 AND dep >= arr AND dep <= 1440 GROUP BY ALL),
  q AS (SELECT DISTINCT a.hub AS src, b.hub AS trg, a.dep, b.arr, d.day FROM h a JOIN h b ON a.trip = b.trip AND a.hub <> b.hub AND b.arr > a.dep AND a.fua % 5 = b.fua % 5 JOIN (SELECT trip, unnest([trip % 5, trip % 11]) AS day FROM (SELECT DISTINCT trip FROM h)) d ON a.trip = d.trip)
  SELECT src, trg, count(*) AS nservices, round(avg(arr - dep), 6) AS avg_time, CAST(median(arr - dep) AS DOUBLE) AS median_time, round(stddev_samp(arr - dep), 5) AS std_time, round(count(*) / {DEFAULTS.total_days}.0, 6) AS avg_freq FROM q GROUP BY src, trg"""
)
def local_hub_links(t, spark):
    from dataclasses import replace

    p = stops(t)
    first = p.groupBy("fua").agg(F.min("stop_id").alias("hub")).select("hub")
    hubs = p.join(first, p["stop_id"] == first["hub"]).select("hub", "x", "y", F.array(F.col("fua") % 5).alias("fuas"))
    e = t("lineitem").withColumn("t", F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")))
    g = e.groupBy(F.col("l_orderkey").alias("time_seq")).agg(*[sequences.ordered_list(F.col(c), *[F.col(o) for o in ORDER]).alias(c) for c in ("t", "l_quantity")])
    times = g.select("time_seq", F.transform(sequences.relative(F.col("t")), lambda x: 60 * x).alias("rel"), F.transform("l_quantity", lambda x: x.cast("int")).alias("wait"))
    trip = F.col("time_seq")
    trips = g.select(trip.alias("trip"), trip.alias("stop_seq"), "time_seq", (3600 * (trip % 7)).alias("start"), trip.alias("dateset"), (trip % 3).alias("tz_gap"))
    days = g.select(trip.alias("dateset"), F.array_distinct(F.array(trip % 5, trip % 11)).alias("dates"))
    out = network.local_links(p, hubs, trips, stop_sequences(t), times, days, replace(DEFAULTS, station_buffer_m=4000.0))
    return rounded(rounded(out, "avg_time", "avg_freq"), "std_time", digits=5)


@query(
    f"""WITH f AS (SELECT c_nationkey AS src, s_nationkey AS trg, l_linenumber % 3 AS carrier, CAST(l_quantity AS INT) * 20 - 60 * (c_nationkey % 3) AS dep, CAST(l_quantity AS INT) * 20 + l_linenumber * 35 - 60 * (s_nationkey % 3) AS arr,
    CAST(o_orderdate AS DATE) + 11000 AS s, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS ops FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
  d AS (SELECT src, trg, CASE carrier WHEN 0 THEN 'Zero' WHEN 1 THEN 'One' ELSE '2' END AS operator, arr - dep AS tm FROM f, range(0, 6) r(g) WHERE s + CAST(g AS INT) BETWEEN DATE '{DEFAULTS.service_start}' AND DATE '{DEFAULTS.service_end}' AND contains(ops, CAST(isodow(s + CAST(g AS INT)) AS VARCHAR)))
  SELECT src, trg, operator, count(*) AS nservices, round(avg(tm), 6) AS avg_time, CAST(median(tm) AS DOUBLE) AS median_time, round(stddev_samp(tm), 5) AS std_time, round(count(*) / {DEFAULTS.total_days}.0, 6) AS avg_freq FROM d GROUP BY ALL"""
)
def flight_links(t, spark):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    q, day = F.col("l_quantity").cast("int") * 20, F.date_add(F.to_date("o_orderdate"), 11000)
    flights = j.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("trg"), (F.col("l_linenumber") % 3).cast("string").alias("carrier"), q.alias("dep"), (q + F.col("l_linenumber") * 35).alias("arr"), day.alias("start_date"), F.date_add(day, 5).alias("end_date"), F.floor("o_totalprice").cast("long").cast("string").alias("op_days"))
    n = F.col("n_nationkey")
    airports = t("nation").select(n.alias("iata"), (60 * (n % 3)).alias("utc_offset"), n.cast("double").alias("lon"), (n + 30).cast("double").alias("lat"))
    carriers = spark.createDataFrame([("0", "Zero"), ("1", "One")], "carrier string, name string")
    out = air.links(air.timetable(flights, airports, carriers), airports).drop("dist")
    return rounded(rounded(out, "avg_time", "avg_freq"), "std_time", digits=5)


@query("SELECT o_custkey, min(r) - 1 AS start, count(*) AS n FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS r FROM orders) GROUP BY o_custkey")
def customer_runs(t, spark):
    return sequences.run_starts(t("orders"), ["o_custkey"])


@query(f"WITH {VISIT}, v AS (SELECT trip, stop_id, row_number() OVER (ORDER BY trip, pos) - 1 AS place FROM visit) SELECT place, stop_id AS value FROM v")
def flattened_stops(t, spark):
    return sequences.flattened(stop_sequences(t), "stop_seq", "stops")[1]
