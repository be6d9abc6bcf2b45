"""Queries of the last steps: links of all lines with distances, operators, coverage, cities, nodes, services and matrices."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from transitloom.operators import assembly, calendar, links, network, shapes
from transitloom.params import DEFAULTS
from transitloom.plans.catalogue import ORACLE_SQL, query
from transitloom.plans.frames import journeys, order_nations, points
from transitloom.plans.queries_graph import PT, RINGS
from transitloom.plans.queries_links import rounded
from transitloom.plans.queries_network import CROSSED, INSIDE, LINES, STEPS, line_tables, station_regions, stops
from transitloom.plans.queries_rows import LONLAT, lonlat


def operator_lines(t):
    """Lines and (jrn, line); agency 0 runs local lines."""
    table, of = line_tables(t)
    return table.withColumn("operator", F.when(F.col("agency") > 0, F.concat(F.lit("A"), "agency")).otherwise(".Local")), of


def timetable(t):
    return journeys(t).select(F.col("trip").alias("jrn"), "stn", F.col("t").alias("arr"), F.col("t").alias("dep"))


def segment_lengths(t, spark):
    a, b = station_regions(t).toDF("src", "fa"), station_regions(t).toDF("trg", "fb")
    return a.join(b, (F.col("fa") > 0) | (F.col("fb") > 1)).select("src", "trg", F.explode(F.array(F.lit(True), F.lit(False))).alias("rail"), (10.0 + F.abs(F.col("src") - F.col("trg"))).alias("len_km"))


@query(
    LINES
    + f""", tp AS (SELECT trip, stn, t, row_number() OVER (PARTITION BY trip ORDER BY t, stn) AS k FROM ev), jj AS (SELECT jl.trip, rail, 'A' || agency AS operator, jl.trip % 5 + 1 AS days FROM jl WHERE agency > 0),
  w AS (SELECT a.stn AS src, b.stn AS trg, rail, operator, b.t - a.t AS tm FROM tp a JOIN tp b ON a.trip = b.trip AND a.k < b.k JOIN jj ON jj.trip = a.trip JOIN range(1, 6) r(d) ON d <= days),
  s AS (SELECT src, trg, rail, operator, count(*) AS nservices, round(avg(tm), 6) AS avg_time, CAST(median(tm) AS DOUBLE) AS median_time, round(stddev_samp(tm), 5) AS std_time, round(count(*) / {DEFAULTS.total_days}.0, 6) AS avg_freq FROM w GROUP BY ALL),
  km AS ({ORACLE_SQL["operator_pair_distances"]}) SELECT s.*, dist, n_lines, intercity FROM s LEFT JOIN km USING (src, trg, rail, operator)"""
)
def pt_links(t, spark):
    table, of = operator_lines(t)
    j = of.withColumn("dateset", F.col("jrn") % 5)
    days = t("orders").select((F.col("o_orderkey") % 5).alias("dateset")).distinct().withColumn("dates", F.transform(F.sequence(F.lit(0).cast("long"), F.col("dateset")), lambda d: F.date_add(F.lit("2024-01-01").cast("date"), d.cast("int"))))
    out = network.pt_links(timetable(t), j, table, days, segment_lengths(t, spark))
    return rounded(rounded(out, "avg_time", "avg_freq"), "std_time", digits=5)


@query(
    STEPS
    + """, city AS (SELECT DISTINCT line, agency, rail, n_regionkey AS g FROM st JOIN nation ON stn = n_nationkey), item AS (SELECT DISTINCT agency, rail, g, nxt FROM (SELECT *, lead(g) OVER (PARTITION BY line ORDER BY g) AS nxt FROM city) WHERE nxt IS NOT NULL),
  size AS (SELECT agency, rail, count(*) AS n_items FROM item GROUP BY ALL), own AS (SELECT agency, rail, row_number() OVER (PARTITION BY rail, g, nxt ORDER BY n_items DESC, agency) AS k FROM item JOIN size USING (agency, rail)),
  new AS (SELECT agency, rail, count(*) AS n_new FROM own WHERE k = 1 GROUP BY ALL), code AS (SELECT agency, rail, array_to_string(list_sort(list(DISTINCT r_name))[1:3], ',') AS country FROM city JOIN region ON g = r_regionkey GROUP BY ALL)
  SELECT agency, rail, n_items, n_new, country FROM size JOIN new USING (agency, rail) JOIN code USING (agency, rail)"""
)
def agency_coverage(t, spark):
    cities = t("region").select(F.col("r_regionkey").alias("fua"), F.col("r_name").alias("icc"))
    return network.agency_coverage(line_tables(t)[0], station_regions(t), cities, most=3)


KEPT = "cut AS (SELECT line, list(stn ORDER BY pos) AS stns FROM st JOIN nation ON stn = n_nationkey WHERE n_regionkey > 0 GROUP BY line HAVING count(*) > 1)"


@query(
    STEPS
    + f""", {KEPT}, known AS (SELECT DISTINCT o_orderkey % 7 AS agency, o_orderkey % 2 = 0 AS rail, 'Op' || (o_orderkey % 7 // 2) AS operator FROM orders WHERE o_orderkey % 7 < 5)
  SELECT operator, rail, array_to_string(stns, ',') AS stns, count(*) AS n FROM (SELECT operator, lines.rail, lines.stns FROM lines JOIN known ON known.agency = lines.agency AND known.rail = lines.rail WHERE intercity UNION ALL SELECT '.Local', rail, cut.stns FROM lines JOIN cut USING (line) WHERE NOT intercity) GROUP BY ALL"""
)
def harmonised_lines(t, spark):
    k = F.col("o_orderkey")
    # agencies 5 and 6 have no operator
    known = t("orders").select((k % 7).alias("agency"), (k % 2 == 0).alias("rail"), F.when(k % 7 < 5, F.concat(F.lit("Op"), F.floor(k % 7 / 2))).alias("operator")).where("operator is not null").distinct()
    h = network.harmonised(line_tables(t)[0], known, station_regions(t).where("fua > 0").select("stn"))
    return h.groupBy("operator", "rail", F.array_join("stns", ",").alias("stns")).agg(F.count("*").alias("n"))


@query(
    STEPS
    + f""", {KEPT}, jr AS (SELECT trip, line FROM jl JOIN lines USING (agency, rail, tz_gap, stns)), k AS (SELECT ev.trip AS jrn, ev.stn, ev.t AS arr, ev.t AS dep, count(*) OVER (PARTITION BY ev.trip) AS n FROM ev JOIN jr ON jr.trip = ev.trip JOIN cut ON cut.line = jr.line AND list_contains(cut.stns, ev.stn))
  SELECT jrn, stn, arr, dep FROM k WHERE n >= 2"""
)
def reduced_timetable(t, spark):
    table, of = line_tables(t)
    kept = network.truncated_lines(table, station_regions(t).where("fua > 0").select("stn"))
    days = t("orders").select((F.col("o_orderkey") % 5).alias("dateset")).distinct().withColumn("dates", F.array(F.lit("2024-01-01").cast("date")))
    return network.reduced(kept, of.withColumn("dateset", F.col("jrn") % 5), timetable(t), days, network.segments(table, station_regions(t)))[1]


@query(
    PT
    + f""", {CROSSED}, cell AS (SELECT DISTINCT x, y, 1000 * (1 + label) AS popu FROM pt), c AS (SELECT poly, x, y, popu FROM cell, e WHERE {INSIDE} GROUP BY ALL HAVING count(*) % 2 = 1),
  city AS (SELECT poly, sum(popu) AS popu, sum(x * popu) / sum(popu) AS x, sum(y * popu) / sum(popu) AS y FROM c GROUP BY poly HAVING sum(popu) >= 50000)
  SELECT 'FUA_' || lpad(CAST(row_number() OVER (ORDER BY popu DESC, poly) AS VARCHAR), 3, '0') AS node_id, CAST(poly AS VARCHAR) AS name, CAST(popu AS BIGINT) AS popu, round(x, 3) AS x, round(y, 3) AS y FROM city"""
)
def city_table(t, spark):
    polygons = spark.createDataFrame([("EU", str(k), [{"x": x, "y": y} for x, y in r]) for k, r in RINGS.items()], "icc string, name string, ring array<struct<x: double, y: double>>")
    grid = points(t).select(F.lit("EU").alias("icc"), (1000 * (1 + F.col("label"))).cast("long").alias("popu"), "x", "y").distinct()
    return assembly.cities(grid, polygons, replace(DEFAULTS, min_city_population=50_000), 700.0).select("node_id", "name", "popu", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


NODES = (
    PT
    + f""", hub AS (SELECT 'AIR_' || s_suppkey AS node_id, s_name AS name, x, y FROM supplier JOIN pt ON id = s_suppkey), stn AS (SELECT 'STN_' || c_custkey AS node_id, c_name || ' | ' || c_mktsegment AS name, x + 7 AS x, y + 5 AS y FROM customer JOIN pt ON id = c_custkey + 50),
  moved AS (SELECT stn.node_id AS node, max(hub.node_id) AS target FROM stn JOIN hub ON sqrt((stn.x - hub.x) * (stn.x - hub.x) + (stn.y - hub.y) * (stn.y - hub.y)) <= {DEFAULTS.airport_station_m} GROUP BY 1),
  node AS (SELECT 'FUA_' || r_regionkey AS node_id, 'City' AS kind, r_name AS name FROM region UNION ALL SELECT node_id, 'Airport', name FROM hub UNION ALL SELECT node_id, 'Bus', trim(split_part(name, ' | ', 1)) FROM stn WHERE node_id NOT IN (SELECT node FROM moved))"""
)


def node_parts(t):
    xy = points(t)
    here = lambda df: df.withColumns({"lon": F.lit(1.0), "lat": F.lit(2.0)})
    hub = here(stops(t).select(F.concat(F.lit("AIR_"), "stop_id").alias("node_id"), "name", "x", "y"))
    stn = xy.join(t("customer"), F.col("id") == F.col("c_custkey") + 50)
    stn = here(stn.select(F.concat(F.lit("STN_"), "c_custkey").alias("node_id"), F.concat("c_name", F.lit(" | "), "c_mktsegment").alias("name"), F.lit("Bus").alias("kind"), (F.col("x") + 7).alias("x"), (F.col("y") + 5).alias("y")))
    city = here(t("region").select(F.concat(F.lit("FUA_"), "r_regionkey").alias("node_id"), F.col("r_name").alias("name")))
    moved = assembly.merged_stations(stn, hub)
    return assembly.nodes(city, hub, stn, moved), moved


@query(NODES + " SELECT node_id, kind, name FROM node")
def graph_nodes(t, spark):
    return node_parts(t)[0].select("node_id", "kind", "name")


@query(
    NODES
    + """, ln AS (SELECT coalesce(a.target, 'STN_' || o_custkey) AS src, coalesce(b.target, 'AIR_' || l_suppkey) AS trg, l_linenumber AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN moved a ON a.node = 'STN_' || o_custkey LEFT JOIN moved b ON b.node = 'AIR_' || l_suppkey)
  SELECT src, trg, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM ln WHERE src <> trg AND src IN (SELECT node_id FROM node) AND trg IN (SELECT node_id FROM node) GROUP BY ALL"""
)
def graph_link_table(t, spark):
    nodes, moved = node_parts(t)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("STN_"), "o_custkey").alias("src"), F.concat(F.lit("AIR_"), "l_suppkey").alias("trg"), F.col("l_linenumber").alias("k"))
    return assembly.graph_links([j], moved, nodes).groupBy("src", "trg").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query(
    """WITH u AS (SELECT user_id AS service, CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) AS e FROM events GROUP BY 1), k AS (SELECT DISTINCT user_id AS service, CAST(ts AS DATE) AS day, event_type FROM events WHERE ts < TIMESTAMP '2024-01-25'),
  regular AS (SELECT service, CAST(s + CAST(g AS INT) AS DATE) AS day FROM u, range(0, 40) r(g) WHERE s + CAST(g AS INT) <= least(e, DATE '2024-01-24') AND (isodow(s + CAST(g AS INT)) - 1 + service) % 3 <> 0)
  SELECT service, strftime(day, '%Y-%m-%d') AS date FROM ((SELECT * FROM regular UNION SELECT service, day FROM k WHERE event_type = 'click') EXCEPT SELECT service, day FROM k WHERE event_type = 'purchase')"""
)
def compiled_services(t, spark):
    from datetime import date

    number = lambda c: F.date_format(c, "yyyyMMdd").cast("int")
    user, day = F.col("user_id"), F.to_date("ts")
    span = t("events").groupBy(user.alias("service_id")).agg(number(F.min(day)).alias("start_date"), number(F.max(day)).alias("end_date"))
    c = span.withColumns({d: ((i + F.col("service_id")) % 3 != 0).cast("int") for i, d in enumerate(calendar.DAYS)})
    x = t("events").select(user.alias("service_id"), number(day).alias("date"), F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).alias("exception_type")).where("exception_type is not null")
    return calendar.compile_services(c, x, date(2024, 1, 1), date(2024, 1, 25)).select("service", F.col("date").cast("string").alias("date"))


LEG = f"""p AS ({LONLAT.replace("c_custkey,", "c_custkey, c_nationkey,", 1)}), g AS (SELECT *, lag(lon) OVER w AS x, lag(lat) OVER w AS y FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
  q AS (SELECT c_custkey, c_nationkey, radians(lon - coalesce(x, lon))::DOUBLE AS turn, atan((1 - f) * tan(radians(coalesce(y, lat)))) AS u1, atan((1 - f) * tan(radians(lat))) AS u2, f, a, a * (1 - f) AS b FROM g, (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE AS f)),
  it AS (SELECT c_custkey, turn AS lam, 0 AS k FROM q UNION ALL SELECT c_custkey, turn + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1))), k + 1 FROM (SELECT *, f / 16 * (1 - sa * sa) * (4 + f * (4 - 3 * (1 - sa * sa))) AS c, atan2(ss, cs) AS sigma, CASE WHEN sa * sa = 1 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS cm
    FROM (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM (SELECT q.*, lam, k, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it JOIN q USING (c_custkey) WHERE k < 25)))),
  leg AS (SELECT c_custkey, c_nationkey, b * big * (sigma - sm * ss * (cm + sm / 4 * (cs * (2 * cm * cm - 1) - sm / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS m
    FROM (SELECT *, 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v))) AS big, v / 1024 * (256 + v * (-128 + v * (74 - 47 * v))) AS sm, atan2(ss, cs) AS sigma, CASE WHEN sa * sa = 1 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS cm
    FROM (SELECT *, (1 - sa * sa) * (a * a - b * b) / (b * b) AS v FROM (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM (SELECT q.*, lam, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM it JOIN q USING (c_custkey) WHERE k = 25)))))"""


@query(f"WITH RECURSIVE {LEG} SELECT c_custkey, round(sum(m) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 2) AS dist FROM leg")
def geodesic_shapes(t, spark):
    p = lonlat(t).join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return shapes.cumulative_m(p, "c_nationkey", "c_custkey").select("c_custkey", F.round("dist", 2).alias("dist"))


@query("WITH m AS (SELECT c_nationkey AS src, s_nationkey AS trg, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) SELECT a.n_nationkey AS src, b.n_nationkey AS trg, n, q FROM nation a JOIN nation b ON true LEFT JOIN m ON m.src = a.n_nationkey AND m.trg = b.n_nationkey")
def matrix_blocks(t, spark):
    m = order_nations(t).groupBy("src", "trg").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    blocks = links.matrix_blocks(t("nation"), t("nation"), "n_nationkey", 7)
    return links.unfolded(links.filled_blocks(blocks, m, ["n", "q"]), ["n", "q"])
