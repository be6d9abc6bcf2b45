"""Queries of space and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitloom.operators import chains, graph, links, routing, spatial
from transitloom.plans.catalogue import query
from transitloom.plans.frames import order_nations, points

PT = "WITH pt AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 10000 AS x, embedding[2]::DOUBLE * 10000 AS y, label FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) >= 2)"
RADIUS = 150.0


def right(p):
    return p.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))


@query(PT + f" SELECT a.id, b.id AS rid, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 4) AS dist FROM pt a JOIN pt b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {RADIUS}")
def dwithin_pairs(t, spark):
    p = points(t)
    return spatial.within_distance(p, right(p), RADIUS).where("id < rid").select("id", "rid", F.round("dist", 4).alias("dist"))


HUB = "hub AS (SELECT id AS hub, x AS hx, y AS hy FROM pt WHERE label IN (SELECT min(label) FROM pt))"


@query(PT + f", {HUB}, d AS (SELECT id, hub, sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) AS dist FROM pt, hub) SELECT id, hub, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, hub) AS k FROM d WHERE dist <= 400) WHERE k = 1")
def nearest_hub(t, spark):
    p = points(t)
    least = p.agg(F.min("label").alias("label"))
    hubs = p.join(least, "label", "left_semi").select(F.col("id").alias("hub"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial.nearest(p, hubs, 400.0, ["id"], "hub").select("id", "hub", F.round("dist", 4).alias("dist"))


@query(PT + ", d AS (SELECT a.id, b.id AS rid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM pt a JOIN pt b ON a.label = b.label AND a.id <> b.id) SELECT id, rid, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, rid) AS k FROM d WHERE dist <= 500) WHERE k = 1")
def nearest_on_island(t, spark):
    p = points(t)
    other = p.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("label").alias("_group"))
    near = spatial.nearest_in_group(p, other, "label", 500.0, ["id"], "rid", unequal=("id", "rid"))
    return near.select("id", "rid", F.round("dist", 4).alias("dist"))


@query(PT + " SELECT id, round(x, 4) AS x FROM pt WHERE x BETWEEN -500 AND 500 AND y BETWEEN -1000 AND 1000")
def bbox_filter(t, spark):
    from transitloom.operators.rows import within_box

    return points(t).where(within_box(F.col("x"), F.col("y"), -500, -1000, 500, 1000)).select("id", F.round("x", 4).alias("x"))


RINGS = {1: [(-800.0, -700.0), (900.0, -500.0), (300.0, 950.0)], 2: [(0.0, 0.0), (2000.0, 100.0), (1500.0, 1800.0), (700.0, 600.0), (-200.0, 1500.0)], 3: [(-3000.0, -3000.0), (-100.0, -2900.0), (-150.0, -50.0), (-2500.0, 10.0)]}
EDGES = [(k, *r[i], *r[(i + 1) % len(r)]) for k, r in RINGS.items() for i in range(len(r))]


@query(
    PT
    + ", e AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, a, b, c, d in EDGES)
    + ") v(poly, x0, y0, x1, y1)), c AS (SELECT id, poly FROM pt, e WHERE ((y0 > y) <> (y1 > y)) AND x < (x1 - x0) * (y - y0) / (y1 - y0) + x0) SELECT id, poly FROM c GROUP BY id, poly HAVING count(*) % 2 = 1"
)
def point_in_polygon(t, spark):
    polygons = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in RINGS.items()], "poly int, ring array<struct<x: double, y: double>>")
    return spatial.points_in_polygons(points(t), spatial.polygon_edges(polygons, "poly", "ring"), "id", "poly", 1000.0)


@query(
    PT.replace("WITH", "WITH RECURSIVE")
    + f""", e AS (SELECT a.id AS u, b.id AS v FROM pt a JOIN pt b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {RADIUS}),
  r AS (SELECT id, id AS c FROM pt UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id) SELECT id, min(c) AS cluster FROM r GROUP BY id"""
)
def cluster_components(t, spark):
    return spatial.clusters(points(t), "id", RADIUS)


LINKS = "ln AS (SELECT c_nationkey AS src, s_nationkey AS trg, min(l_extendedprice) AS w, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def nation_links(t):
    """The rows of LINKS."""
    return order_nations(t).groupBy("src", "trg").agg(F.min("l_extendedprice").alias("w"), F.count("*").alias("n"))


def nation_nodes(t):
    return t("nation").select(F.col("n_nationkey").alias("node_id"))


@query(f"WITH RECURSIVE {LINKS}, b AS (SELECT src AS u, trg AS v FROM ln UNION SELECT trg, src FROM ln), r AS (SELECT n_nationkey AS node, n_nationkey AS c FROM nation UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.node) SELECT node, min(c) AS component FROM r GROUP BY node")
def weak_components(t, spark):
    return graph.weak_components(nation_nodes(t), nation_links(t))


@query(f"WITH RECURSIVE {LINKS}, r AS (SELECT n_nationkey AS s, n_nationkey AS node FROM nation UNION SELECT r.s, ln.trg FROM r JOIN ln ON ln.src = r.node) SELECT a.s AS node, min(a.node) AS component FROM r a JOIN r b ON a.s = b.node AND a.node = b.s GROUP BY 1")
def strong_components(t, spark):
    return graph.strong_components(nation_nodes(t), nation_links(t))


@query(f"WITH RECURSIVE {LINKS}, r AS (SELECT (SELECT min(src) FROM ln) AS node UNION SELECT ln.trg FROM r JOIN ln ON ln.src = r.node) SELECT node FROM r")
def strong_reach(t, spark):
    ln = nation_links(t)
    return graph.reachable(ln, ln.agg(F.min("src").alias("node")))


@query(
    f"""WITH RECURSIVE {LINKS}, b AS (SELECT src AS u, trg AS v FROM ln UNION SELECT trg, src FROM ln), r AS (SELECT n_nationkey AS node, n_nationkey AS c FROM nation UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.node), q AS (SELECT node, min(c) AS c FROM r GROUP BY node)
  SELECT (SELECT count(*) FROM nation) AS n_nodes, (SELECT count(*) FROM ln) AS n_links, (SELECT count(DISTINCT c) FROM q) AS n_weak, (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT u FROM b)) AS n_isolated, (SELECT count(*) FROM ln WHERE src = trg) AS n_self,
  round((SELECT count(*) FROM ln WHERE src <> trg) / (25.0 * 24), 6) AS density, round((SELECT count(*) FROM ln) / 25.0, 6) AS mean_in_degree, round((SELECT count(*) FROM ln) / 25.0, 6) AS mean_out_degree"""
)
def graph_stats(t, spark):
    s = graph.statistics(nation_nodes(t), nation_links(t))
    return s.withColumns({c: F.round(c, 6) for c in ("density", "mean_in_degree", "mean_out_degree")})


ARCS = "b AS (SELECT u, v, min(w) AS w FROM (SELECT src AS u, trg AS v, w FROM ln UNION ALL SELECT trg, src, w FROM ln) WHERE u <> v GROUP BY u, v)"


@query(
    f"""WITH RECURSIVE {LINKS}, {ARCS}, r AS (SELECT n_nationkey AS src, n_nationkey AS node, 0.0::DOUBLE AS d, 0 AS k FROM nation UNION ALL SELECT src, node, d, k FROM (SELECT r.src, b.v AS node, min(r.d + b.w) AS d, max(r.k) + 1 AS k FROM r JOIN b ON b.u = r.node WHERE r.k < 10 GROUP BY 1, 2))
  SELECT a.n_nationkey AS src, c.n_nationkey AS trg, round(min(d), 2) AS length FROM nation a JOIN nation c ON a.n_nationkey < c.n_nationkey LEFT JOIN r ON r.src = a.n_nationkey AND r.node = c.n_nationkey GROUP BY 1, 2"""
)
def shortest_paths(t, spark):
    e = nation_links(t).where("src <> trg").select(F.col("src").alias("u"), F.col("trg").alias("v"), "w")
    n = t("nation")
    pairs = n.select(F.col("n_nationkey").alias("src")).join(n.select(F.col("n_nationkey").alias("trg")), F.col("src") < F.col("trg"))
    return routing.shortest_paths(e, pairs).select("src", "trg", F.round("length", 2).alias("length"))


@query(
    f"""WITH RECURSIVE {LINKS}, {ARCS}, r AS (SELECT n_nationkey AS src, n_nationkey AS node, 0.0::DOUBLE AS d, CAST(n_nationkey AS VARCHAR) AS path, 0 AS k FROM nation
  UNION ALL SELECT src, node, d, path, k FROM (SELECT r.src, b.v AS node, min(r.d + b.w) AS d, arg_min(r.path || '>' || b.v, r.d + b.w) AS path, max(r.k) + 1 AS k FROM r JOIN b ON b.u = r.node WHERE r.k < 10 GROUP BY 1, 2))
  SELECT a.n_nationkey AS src, c.n_nationkey AS trg, round(min(d), 2) AS length, arg_min(path, d) AS path FROM nation a JOIN nation c ON a.n_nationkey < c.n_nationkey LEFT JOIN r ON r.src = a.n_nationkey AND r.node = c.n_nationkey GROUP BY 1, 2"""
)
def shortest_routes(t, spark):
    e = nation_links(t).where("src <> trg").select(F.struct("src", "trg").alias("edge"), F.col("src").alias("u"), F.col("trg").alias("v"), "w")
    n = t("nation")
    pairs = n.select(F.col("n_nationkey").alias("src")).join(n.select(F.col("n_nationkey").alias("trg")), F.col("src") < F.col("trg"))
    r = routing.shortest_routes(e, pairs)
    # an edge is crossed from the node where the way has come to
    nodes = F.aggregate("edges", F.array("src"), lambda way, x: F.concat(way, F.array(F.when(x["src"] == F.element_at(way, -1), x["trg"]).otherwise(x["src"]))))
    return r.select("src", "trg", F.round("length", 2).alias("length"), F.when(F.col("length").isNotNull(), F.array_join(nodes, ">")).alias("path"))


@query(
    """WITH e AS (SELECT o_custkey AS c, CAST(-c_nationkey - 1 AS BIGINT) AS n, o_totalprice AS w FROM orders JOIN customer ON o_custkey = c_custkey), x AS (SELECT *, count(*) OVER (PARTITION BY c) AS k FROM e)
  SELECT n AS u, n AS v, round(sum(w), 2) AS w, 2 AS n_edges FROM x WHERE k = 2 GROUP BY c, n UNION ALL SELECT least(c, n), greatest(c, n), round(w, 2), 1 FROM x WHERE k <> 2"""
)
def chain_contraction(t, spark):
    e = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("u"), (-F.col("c_nationkey") - 1).cast("long").alias("v"), F.col("o_totalprice").alias("w"))
    # nations are stations: they stay ends however few their customers are
    return chains.contracted(e, e.select(F.col("v").alias("node")).distinct()).withColumn("w", F.round("w", 2))


@query(f"WITH {LINKS}, moved AS (SELECT * FROM (VALUES (4, 8), (12, 0)) v(node, target)) SELECT coalesce(a.target, src) AS src, coalesce(b.target, trg) AS trg, round(w, 2) AS w FROM ln LEFT JOIN moved a ON src = a.node LEFT JOIN moved b ON trg = b.node WHERE coalesce(a.target, src) <> coalesce(b.target, trg)")
def link_assembly(t, spark):
    moved = spark.createDataFrame([(4, 8), (12, 0)], "node int, target int")
    return links.redirected(nation_links(t), moved).select("src", "trg", F.round("w", 2).alias("w"))


@query(
    f"""WITH {LINKS}, n AS (SELECT n_nationkey AS node_id FROM nation WHERE n_nationkey <> 8) SELECT "check", CAST(violations AS BIGINT) AS violations FROM (SELECT 'src_unknown' AS "check", count_if(src NOT IN (SELECT node_id FROM n)) AS violations FROM ln UNION ALL SELECT 'trg_unknown', count_if(trg NOT IN (SELECT node_id FROM n)) FROM ln
  UNION ALL SELECT 'self_link', count_if(src = trg) FROM ln UNION ALL SELECT 'freq', count_if(n - 3 <= 0) FROM ln UNION ALL SELECT 'node_id_null', 0 UNION ALL SELECT 'node_id_repeated', 0 UNION ALL SELECT 'coordinates', 0 UNION ALL SELECT 'endpoint_null', 0 UNION ALL SELECT 'time', 0 UNION ALL SELECT 'operator_or_freq_null', 0) """
)
def validation_report(t, spark):
    n = t("nation").where("n_nationkey <> 8").select(F.col("n_nationkey").alias("node_id"), F.col("n_nationkey").cast("double").alias("lon"), F.lit(50.0).alias("lat"))
    ln = nation_links(t).select("src", "trg", F.col("w").alias("time"), (F.col("n") - 3).alias("freq"), F.lit("Rail").alias("mode"), F.lit("x").alias("operator"))
    return links.violations(n, ln)


