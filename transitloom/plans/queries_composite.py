"""Queries of the composite operators: stations, access, assembly, export and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitloom.functions import geo
from transitloom.operators import aggregates, assembly, calendar, graph, sequences, spatial
from transitloom.plans.catalogue import query
from transitloom.plans.frames import ORDER, journeys, points, service_days
from transitloom.plans.queries_graph import PT, RADIUS
from transitloom.plans.queries_links import EV
from transitloom.plans.queries_rows import LONLAT, lonlat
from transitloom.sources import export, tables


@query(
    PT.replace("WITH", "WITH RECURSIVE")
    + f""", e AS (SELECT a.id AS u, b.id AS v FROM pt a JOIN pt b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {RADIUS}),
  r AS (SELECT id, id AS c FROM pt UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id), k AS (SELECT id, min(c) AS cluster FROM r GROUP BY id), m AS (SELECT * FROM k JOIN pt USING (id)),
  n AS (SELECT cluster, label, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT cluster, array_to_string(list(label ORDER BY n DESC, label), ' | ') AS names FROM n GROUP BY cluster)
  SELECT cluster, round(avg(x), 3) AS x, round(avg(y), 3) AS y, count(*) AS n, any_value(names) AS names FROM m JOIN s USING (cluster) GROUP BY cluster"""
)
def station_table(t, spark):
    p = points(t)
    m = p.join(spatial.clusters(p, "id", RADIUS), "id")
    names = aggregates.names_by_frequency(m.withColumn("label", F.col("label").cast("string")), ["cluster"], "label")
    return m.groupBy("cluster").agg(F.round(F.avg("x"), 3).alias("x"), F.round(F.avg("y"), 3).alias("y"), F.count("*").alias("n")).join(names, "cluster")


@query(PT + ", h AS (SELECT * FROM pt WHERE label IN (SELECT min(label) FROM pt)) SELECT h.id AS hub, array_to_string(list(pt.id ORDER BY pt.id), ',') AS members FROM h JOIN pt ON sqrt((h.x - pt.x) * (h.x - pt.x) + (h.y - pt.y) * (h.y - pt.y)) <= 300 GROUP BY 1")
def catchment_members(t, spark):
    p = points(t)
    hubs = p.join(p.agg(F.min("label").alias("label")), "label", "left_semi").select(F.col("id").alias("hub"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = spatial.within_distance(p, hubs, 300.0)
    return near.groupBy("hub").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))


@query(
    """WITH m AS (SELECT o_custkey AS c, l_suppkey AS h, min(l_extendedprice) AS tm, min(l_quantity) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  x AS (SELECT c_nationkey AS fua, h, tm / 60 AS tm, d / 1000 AS d, c_acctbal + 1000 AS w FROM m JOIN customer ON c = c_custkey JOIN supplier ON h = s_suppkey AND s_nationkey = c_nationkey),
  g AS (SELECT fua, h, round(sum(tm * w) / sum(w), 3) AS time, round(sum(d * w) / sum(w), 6) AS dist FROM x GROUP BY 1, 2)
  SELECT 'Access' AS kind, CAST(fua AS VARCHAR) AS src, 'h' || h AS trg, time, dist, fua FROM g UNION ALL SELECT 'Egress', 'h' || h, CAST(fua AS VARCHAR), time, dist, fua FROM g"""
)
def access_connectors(t, spark):
    m = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("h"), "l_suppkey").alias("b")).agg(F.min("l_extendedprice").alias("time"), F.min("l_quantity").alias("dist"))
    both = m.toDF("src_id", "trg_id", "time", "dist").unionByName(m.toDF("trg_id", "src_id", "time", "dist"))
    cells = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("cell"), F.col("c_nationkey").alias("fua"), (F.col("c_acctbal") + 1000).alias("popu"))
    hubs = t("supplier").select(F.concat(F.lit("h"), "s_suppkey").alias("hub"), F.col("s_nationkey").alias("fua"))
    return assembly.access(both, cells, hubs).withColumns({"time": F.round("time", 3), "dist": F.round("dist", 6)})


@query(EV + ", l AS (SELECT a.stn AS src, b.stn AS trg, o_orderstatus = 'F' AS rail FROM ev a JOIN ev b ON a.trip = b.trip AND b.pos = a.pos + 1 JOIN orders ON a.trip = o_orderkey), e AS (SELECT src AS node, rail FROM l UNION ALL SELECT trg, rail FROM l) SELECT node, CASE WHEN bool_and(rail) THEN 'Rail' WHEN bool_or(rail) THEN 'Multimodal' ELSE 'Bus' END AS kind FROM e GROUP BY node")
def station_kind(t, spark):
    from pyspark.sql import Window

    w = Window.partitionBy("trip").orderBy(*ORDER)
    e = journeys(t).select("trip", F.col("stn").alias("src"), F.lead("stn").over(w).alias("trg"), "t").where("trg is not null")
    o = t("orders").select(F.col("o_orderkey").alias("trip"), (F.col("o_orderstatus") == "F").alias("rail"))
    return assembly.station_kinds(e.join(o, "trip"))


@query(EV + ", m AS (SELECT *, t - (trip % 1440) AS arr FROM ev), s AS (SELECT *, min(arr) OVER (PARTITION BY trip) AS f FROM m) SELECT trip, stn, CAST(CASE WHEN f < 0 AND f >= -1440 THEN arr + 1440 ELSE arr END AS BIGINT) AS arr, CASE WHEN f < 0 THEN -1 ELSE 0 END AS day_shift FROM s")
def shifted_times(t, spark):
    e = journeys(t).select(F.col("trip").alias("jrn"), "stn", (F.col("t") - F.col("trip") % 1440).cast("long").alias("arr"))
    s = export.shifted(e.withColumn("dep", F.col("arr")))
    return s.select(F.col("jrn").alias("trip"), "stn", "arr", "day_shift")


@query("WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), s AS (SELECT user_id, array_to_string(list(strftime(day, '%Y-%m-%d') ORDER BY day), ',') AS k FROM d GROUP BY 1), x AS (SELECT DISTINCT k, day FROM s JOIN d USING (user_id)) SELECT CAST(strftime(CAST(day - 1 AS DATE), '%Y%m%d') AS INT) AS date, count(*) AS n FROM x GROUP BY 1")
def calendar_export(t, spark):
    ids, _ = calendar.datesets(service_days(t).withColumnRenamed("day", "date"))
    s = export.services(ids.select("dateset", F.lit(-1).alias("day_shift")))
    return export.calendar_dates(ids, s).groupBy("date").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, round(lon, 5) AS lon, round(lat, 5) AS lat FROM ({LONLAT})")
def laea_roundtrip(t, spark):
    x, y = geo.project(F.col("lon"), F.col("lat"))
    xy = lonlat(t).select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = geo.unproject(F.col("x"), F.col("y"))
    return xy.select("c_custkey", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


@query(EV + ", p AS (SELECT trip, stn, t, lag(stn) OVER w AS ps, lag(t) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY trip ORDER BY pos)) SELECT trip, round(coalesce(sum(sqrt((stn - ps) * (stn - ps) + (t - pt) * (t - pt))), 0), 4) AS length, count(*) AS n_points FROM p GROUP BY trip")
def line_lengths(t, spark):
    point = F.struct(F.col("stn").cast("double").alias("x"), F.col("t").cast("double").alias("y"))
    g = journeys(t).groupBy("trip").agg(sequences.ordered_list(point, *[F.col(c) for c in ORDER]).alias("p"))
    return g.select("trip", F.round(geo.line_length(F.col("p")), 4).alias("length"), F.size("p").cast("long").alias("n_points"))


@query(
    PT
    + ", a AS (SELECT label AS target, avg(x) AS ax, avg(y) AS ay FROM pt GROUP BY label), n AS (SELECT id, max(target) AS target FROM pt JOIN a ON sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) <= 400 GROUP BY id) SELECT id AS node, target FROM n"
)
def merged_hubs(t, spark):
    p = points(t)
    hubs = p.groupBy(F.col("label").alias("node_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return assembly.merged_stations(p.withColumnRenamed("id", "node_id"), hubs)


@query(
    PT.replace("WITH", "WITH RECURSIVE")
    + f""", e AS (SELECT a.id AS u, b.id AS v FROM pt a JOIN pt b ON a.label = b.label AND a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {RADIUS}),
  r AS (SELECT u AS id, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id), k AS (SELECT id, min(c) AS c FROM r GROUP BY id), m AS (SELECT * FROM k JOIN pt USING (id)),
  best AS (SELECT label, c FROM (SELECT label, c, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, c) AS place FROM m GROUP BY label, c) WHERE place = 1), giant AS (SELECT id, x, y FROM m JOIN best USING (label, c)),
  d AS (SELECT a.id AS stn, b.id AS node, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM pt a JOIN giant b ON a.x BETWEEN b.x - 500 AND b.x + 500)
  SELECT stn, node, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY stn ORDER BY dist, node) AS place FROM d WHERE dist <= 500) WHERE place = 1"""
)
def station_snap(t, spark):
    p = points(t)
    edges = spatial.connecting(p, "id", RADIUS, group="label")
    s = graph.snapped_stations(p.select(F.col("id").alias("stn"), "x", "y"), edges, p.select(F.col("id").alias("node"), "x", "y"), "label", 500.0)
    return s.select("stn", "node", F.round("dist", 4).alias("dist"))


@query("SELECT p_partkey AS line, dense_rank() OVER (ORDER BY coalesce(nullif(trim(p_brand), ''), 'Unknown agency')) AS agency_id FROM part")
def feed_agencies(t, spark):
    lines = t("part").select(F.col("p_partkey").alias("line"), F.col("p_brand").alias("agency"))
    return export.agencies(lines, "https://example.org/", "Europe/Paris")[1].select("line", "agency_id")


@query("SELECT o_orderpriority AS service_id, 1 AS monday, 1 AS tuesday, 1 AS wednesday, 1 AS thursday, 1 AS friday, 1 AS saturday, 1 AS sunday, strftime((SELECT min(o_orderdate) FROM orders), '%Y%m%d') AS start_date, strftime((SELECT max(o_orderdate) FROM orders), '%Y%m%d') AS end_date FROM orders GROUP BY 1")
def all_days_calendar(t, spark):
    o = t("orders")
    span = o.agg(F.min("o_orderdate").alias("from_date"), F.max("o_orderdate").alias("to_date"))
    return export.all_days(o.select(F.col("o_orderpriority").alias("service_id")), span)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '%URGENT%') WHERE place = 1")
def newest_resource(t, spark):
    r = F.struct("o_orderkey", F.concat(F.lit("."), "o_orderstatus").alias("format"), F.col("o_orderpriority").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_modified"), F.lit(None).cast("string").alias("created"))
    listed = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(r)).alias("resources"))
    return tables.newest_resources(listed, "URGENT", "f").select("o_custkey", "resource.o_orderkey")
