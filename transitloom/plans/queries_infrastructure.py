"""Queries of infrastructure graphs: from lines to junctions, chains, snapped stations and oriented pairs.

Stand-in: every row of `embeddings` is a way of three points, whose ends lie on a coarse grid so that ways meet.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from transitloom.functions.geo import line_length
from transitloom.operators import chains, graph, routing
from transitloom.plans.catalogue import query
from transitloom.plans.queries_network import stops

GRID, ISLAND, SNAP = 60, (0.0, 0.0, 100_000.0, 100_000.0), 300.0

WAYS = f"""way AS (SELECT vec_id AS way, floor(embedding[1]::DOUBLE * {GRID}) * 250 AS ax, floor(embedding[2]::DOUBLE * {GRID}) * 250 AS ay, embedding[5]::DOUBLE * 10000 AS mx, embedding[6]::DOUBLE * 10000 AS my, floor(embedding[3]::DOUBLE * {GRID}) * 250 AS bx, floor(embedding[4]::DOUBLE * {GRID}) * 250 AS b_y FROM embeddings),
  node AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS node, x, y, CASE WHEN x BETWEEN {ISLAND[0]} AND {ISLAND[2]} AND y BETWEEN {ISLAND[1]} AND {ISLAND[3]} THEN 1 ELSE 0 END AS island FROM (SELECT ax AS x, ay AS y FROM way UNION SELECT bx, b_y FROM way)),
  edge AS (SELECT way, a.node AS u, b.node AS v, a.island AS iu, b.island AS iv, sqrt((ax - mx) ** 2 + (ay - my) ** 2) + sqrt((bx - mx) ** 2 + (b_y - my) ** 2) AS w FROM way JOIN node a ON a.x = ax AND a.y = ay JOIN node b ON b.x = bx AND b.y = b_y)"""
GIANT = """inside AS (SELECT u, v, iu AS island FROM edge WHERE iu = iv), pair AS (SELECT u, v FROM inside UNION SELECT v, u FROM inside),
  reach AS (SELECT u AS node, u AS c FROM pair UNION SELECT pair.v, c FROM reach JOIN pair ON pair.u = reach.node), part AS (SELECT node, min(c) AS root FROM reach GROUP BY node),
  size AS (SELECT island, root, row_number() OVER (PARTITION BY island ORDER BY count(*) DESC, root) AS k FROM part JOIN node USING (node) GROUP BY island, root), giant AS (SELECT node FROM part JOIN size USING (root) WHERE k = 1)"""


def ways(t):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    grid = lambda k: (F.floor(at(k) * GRID) * 250).cast("double")
    return t("embeddings").select(F.col("vec_id").alias("way"), F.array(point(grid(0), grid(1)), point(at(4) * 10000, at(5) * 10000), point(grid(2), grid(3))).alias("line"))


@query(f"WITH RECURSIVE {WAYS}, {GIANT} SELECT node, x, y, island, node IN (SELECT node FROM giant) AS giant FROM node")
def base_graph_nodes(t, spark):
    return chains.base_graph(ways(t), [ISLAND])[0]


@query(f"WITH RECURSIVE {WAYS}, {GIANT} SELECT way, u, v, round(w, 4) AS w FROM edge WHERE u IN (SELECT node FROM giant) AND v IN (SELECT node FROM giant)")
def base_graph_edges(t, spark):
    return chains.main_graph(*chains.base_graph(ways(t), [ISLAND])).select("way", "u", "v", F.round("w", 4).alias("w"))


@query(
    f"""WITH RECURSIVE {WAYS}, {GIANT}, stn AS (SELECT s_suppkey AS stn, embedding[1]::DOUBLE * 10000 AS x, embedding[2]::DOUBLE * 10000 AS y FROM supplier JOIN embeddings ON vec_id = s_suppkey),
  near AS (SELECT stn, node, sqrt((stn.x - node.x) * (stn.x - node.x) + (stn.y - node.y) * (stn.y - node.y)) AS dist FROM stn, node WHERE node IN (SELECT node FROM giant))
  SELECT stn, node, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY stn ORDER BY dist, node) AS k FROM near WHERE dist <= {SNAP}) WHERE k = 1"""
)
def base_graph_stations(t, spark):
    nodes, _ = chains.base_graph(ways(t), [ISLAND])
    return graph.snapped_to(stops(t).withColumnRenamed("stop_id", "stn"), nodes, SNAP).select("stn", "node", F.round("dist", 4).alias("dist"))


CHAINS = """tip AS (SELECT way, u AS node FROM edge UNION ALL SELECT way, v FROM edge), two AS (SELECT node, min(way) AS a, max(way) AS b FROM tip GROUP BY node HAVING count(*) = 2 AND min(way) <> max(way)),
  next AS (SELECT a AS u, b AS v FROM two UNION SELECT b, a FROM two), run AS (SELECT way, way AS c FROM edge UNION SELECT next.v, c FROM run JOIN next ON next.u = run.way), chain AS (SELECT way, min(c) AS chain FROM run GROUP BY way),
  cut AS (SELECT min(node) AS node FROM chain JOIN tip USING (way) GROUP BY chain HAVING bool_and(node IN (SELECT node FROM two))), inner_ AS (SELECT node FROM two WHERE node NOT IN (SELECT node FROM cut)),
  arc AS (SELECT way, u AS a, v AS b, w FROM edge UNION ALL SELECT way, v, u, w FROM edge WHERE u <> v),
  walk AS (SELECT way, a AS start, b, [way] AS ways, w FROM arc WHERE a NOT IN (SELECT node FROM inner_) UNION ALL SELECT arc.way, start, arc.b, list_append(ways, arc.way), walk.w + arc.w FROM walk JOIN inner_ ON node = walk.b JOIN arc ON arc.a = node AND arc.way <> walk.way),
  whole AS (SELECT start AS u, b AS v, len(ways) AS n_edges, w, array_to_string(ways, '>') AS s, array_to_string(list_reverse(ways), '>') AS back FROM walk WHERE b NOT IN (SELECT node FROM inner_))"""


@query(f"WITH RECURSIVE {WAYS}, {CHAINS} SELECT u, v, n_edges, round(w, 3) AS w, round(w, 3) AS line_length, s AS ways FROM whole WHERE u < v OR (u = v AND s <= back)")
def chain_order(t, spark):
    c = chains.contracted(chains.base_graph(ways(t))[1], edge="way", line="line")
    ways_ = F.array_join("edges", ">")
    # a cycle can be walked both ways
    named = F.when(F.col("u") == F.col("v"), F.least(ways_, F.array_join(F.reverse("edges"), ">"))).otherwise(ways_)
    return c.select("u", "v", "n_edges", F.round("w", 3).alias("w"), F.round(line_length(F.col("line")), 3).alias("line_length"), named.alias("ways"))


@query(
    f"""WITH RECURSIVE {WAYS}, pr AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM edge WHERE u <> v),
  loop AS (SELECT []::BIGINT[] AS taken, (SELECT list(struct_pack(u := u, v := v)) FROM pr) AS left_ UNION ALL SELECT list_append(taken, x), list_filter(left_, lambda p: p.u <> x AND p.v <> x)
    FROM (SELECT taken, left_, (SELECT arg_max(n, (k, -n)) FROM (SELECT n, count(*) AS k FROM (SELECT unnest(list_transform(left_, lambda p: p.u) || list_transform(left_, lambda p: p.v)) AS n) GROUP BY n)) AS x FROM loop WHERE len(left_) > 0)),
  fin AS (SELECT taken FROM loop WHERE len(left_) = 0), spot AS (SELECT unnest(taken) AS node, generate_subscripts(taken, 1) AS i FROM fin)
  SELECT u, v, CASE WHEN coalesce(a.i, 1000000) < coalesce(b.i, 1000000) THEN u ELSE v END AS src, CASE WHEN coalesce(a.i, 1000000) < coalesce(b.i, 1000000) THEN v ELSE u END AS trg FROM pr LEFT JOIN spot a ON a.node = u LEFT JOIN spot b ON b.node = v"""
)
def pair_orientation(t, spark):
    e = chains.base_graph(ways(t))[1]
    return routing.oriented_pairs(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


@query(
    f"""WITH RECURSIVE {WAYS}, {GIANT}, arc AS (SELECT u, v, min(w) AS w FROM (SELECT u, v, w FROM edge UNION ALL SELECT v, u, w FROM edge) WHERE u <> v AND u IN (SELECT node FROM giant) AND v IN (SELECT node FROM giant) GROUP BY ALL),
  home AS (SELECT min(node) AS src FROM giant JOIN node USING (node) GROUP BY island),
  d AS (SELECT src, src AS node, 0.0::DOUBLE AS d, 0 AS k FROM home UNION ALL SELECT src, node, d, k FROM (SELECT d.src, arc.v AS node, min(d.d + arc.w) AS d, max(d.k) + 1 AS k FROM d JOIN arc ON arc.u = d.node WHERE d.k < 60 GROUP BY 1, 2))
  SELECT home.src, g.node AS trg, round(min(d), 2) AS length, min(d) IS NOT NULL AS linked FROM home JOIN giant g ON true LEFT JOIN d ON d.src = home.src AND d.node = g.node GROUP BY ALL"""
)
def infrastructure_routes(t, spark):
    nodes, edges = chains.base_graph(ways(t), [ISLAND])
    main = chains.main_graph(nodes, edges)
    giant = nodes.where("giant")
    home = giant.groupBy("island").agg(F.min("node").alias("src")).select("src")  # one an island
    r = routing.shortest_routes(main.withColumnRenamed("way", "edge"), home.crossJoin(giant.select(F.col("node").alias("trg"))))
    # the ways' own lengths must add up to the shortest
    steps = r.select("src", "trg", "length", F.explode_outer("edges").alias("way")).join(main.select("way", "w"), "way", "left")
    sums = steps.groupBy("src", "trg").agg(F.max("length").alias("length"), F.sum(F.coalesce("w", F.lit(0.0))).alias("total"))
    return sums.select("src", "trg", F.round(F.when(F.col("length").isNotNull(), F.col("total")), 2).alias("length"), F.col("length").isNotNull().alias("linked"))
