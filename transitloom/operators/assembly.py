"""Cities, access to hubs, and the assembly of the final graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.functions.geo import planar
from transitloom.operators import aggregates, links, rows, spatial
from transitloom.params import DEFAULTS, Params


def cities(grid: DataFrame, polygons: DataFrame, params: Params = DEFAULTS, band: float = 10_000.0) -> DataFrame:
    """Cities (icc, name, ring) whose cells (icc, popu, x, y) hold enough people, with population and weighted centre,
    numbered by descending population; names are unique within a country only."""
    named = polygons.withColumn("_key", F.struct("icc", "name"))
    cells = grid.withColumn("_cell", F.struct("x", "y"))
    inside = spatial.points_in_polygons(cells, spatial.polygon_edges(named, "_key", "ring"), "_cell", "_key", band)
    weighted = inside.join(cells.select("_cell", "popu", "x", "y"), "_cell")
    w = weighted.groupBy("_key").agg(F.sum("popu").alias("popu"), (F.sum(F.col("x") * F.col("popu")) / F.sum("popu")).alias("x"), (F.sum(F.col("y") * F.col("popu")) / F.sum("popu")).alias("y"))
    kept = w.where(F.col("popu") >= params.min_city_population).select("_key.icc", "_key.name", "popu", "x", "y").withColumn("_order", -F.col("popu"))
    numbered = rows.surrogate_key(kept, "id", ["_order", "icc", "name"]).drop("_order").withColumn("id", F.col("id") + 1)
    return numbered.withColumn("node_id", F.format_string("FUA_%03d", "id"))


def access(matrix: DataFrame, cells: DataFrame, hubs: DataFrame) -> DataFrame:
    """kind, src, trg, dist (km), time (minutes), fua: access and egress between a city and its hubs as means over its
    cells by population, and direct ways between its hubs.

    The matrix (src_id, trg_id, time in s, dist in m) connects cells (cell, fua, popu) and hubs (hub, fua) both ways;
    unknown times and distances are left out.
    """
    m = matrix.where(rows.finite(F.col("time"), F.col("dist"))).withColumns({"time": F.col("time") / 60, "dist": F.col("dist") / 1000})
    c = cells.select(F.col("cell").alias("_cell"), F.col("fua").alias("_cf"), "popu")
    h = hubs.select(F.col("hub").alias("_hub"), F.col("fua").alias("_hf"))
    mean = lambda x: aggregates.weighted_mean(F.col(x), F.col("popu")).alias(x)
    into = m.join(c, m["src_id"] == c["_cell"]).join(h, m["trg_id"] == h["_hub"]).where("_cf = _hf").groupBy("_cf", "_hub").agg(mean("dist"), mean("time"))
    out = m.join(c, m["trg_id"] == c["_cell"]).join(h, m["src_id"] == h["_hub"]).where("_cf = _hf").groupBy("_cf", "_hub").agg(mean("dist"), mean("time"))
    city = F.col("_cf").cast("string")
    a = into.select(F.lit("Access").alias("kind"), city.alias("src"), F.col("_hub").alias("trg"), "dist", "time", F.col("_cf").alias("fua"))
    b = out.select(F.lit("Egress").alias("kind"), F.col("_hub").alias("src"), city.alias("trg"), "dist", "time", F.col("_cf").alias("fua"))
    g = h.toDF("_hub2", "_hf2")
    between = m.join(h, m["src_id"] == h["_hub"]).join(g, m["trg_id"] == g["_hub2"]).where("_hf = _hf2 and _hub <> _hub2")
    return a.unionByName(b).unionByName(between.select(F.lit("Interhub").alias("kind"), F.col("_hub").alias("src"), F.col("_hub2").alias("trg"), "dist", "time", F.col("_hf").alias("fua")))


def station_kinds(links_: DataFrame) -> DataFrame:
    """(node, kind): Bus, Rail or Multimodal by the modes (rail flags) of a station's links."""
    ends = links_.select(F.explode(F.array("src", "trg")).alias("node"), "rail")
    return ends.groupBy("node").agg(F.when(aggregates.mode_label(F.col("rail")) == "Both", "Multimodal").otherwise(aggregates.mode_label(F.col("rail"))).alias("kind"))


def merged_stations(stations: DataFrame, airports: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(node, target): stations so near to an airport that they are one hub; of several airports the last id wins."""
    a = airports.select(F.col("node_id").alias("target"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial.greatest_within(stations.select(F.col("node_id").alias("node"), "x", "y"), a, params.airport_station_m, "node", "target")


def nodes(cities_: DataFrame, airports: DataFrame, stations: DataFrame, merged: DataFrame) -> DataFrame:
    """node_id, kind, name, lon, lat of all cities, airports and the stations that stay."""
    columns = ["node_id", "kind", "name", "lon", "lat"]
    left = stations.join(merged.select(F.col("node").alias("node_id")), "node_id", "left_anti")
    first = F.trim(F.split_part("name", F.lit(" | "), F.lit(1)))
    parts = [cities_.withColumn("kind", F.lit("City")), airports.withColumn("kind", F.lit("Airport")), left.withColumn("name", first)]
    return parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns))


def graph_links(parts: Sequence[DataFrame], merged: DataFrame, node_table: DataFrame) -> DataFrame:
    """All links with redirected ends, without self-links and links of unknown nodes; parallel links stay."""
    every = links.redirected(rows.union_all(*parts), merged)
    known = node_table.select("node_id")
    return every.join(known.withColumnRenamed("node_id", "src"), "src", "left_semi").join(known.withColumnRenamed("node_id", "trg"), "trg", "left_semi").select(*every.columns)


def manual_connector(edges: DataFrame, a: tuple[float, float], b: tuple[float, float], reach: float) -> DataFrame:
    """Two directed rows (u, v, w) between the end nodes (node, x, y of both ends in `edges`) nearest to two points.

    `edges` has u, ux, uy, v, vx, vy; only nodes within a box of `reach` about a point are looked at.
    """
    ends = edges.select(F.col("u").alias("node"), F.col("ux").alias("x"), F.col("uy").alias("y")).union(edges.select("v", "vx", "vy"))

    def closest(p, name):
        box = ends.where(rows.within_box(F.col("x"), F.col("y"), p[0] - reach, p[1] - reach, p[0] + reach, p[1] + reach))
        return box.agg(F.min(F.struct(planar(F.col("x"), F.col("y"), F.lit(p[0]), F.lit(p[1])).alias("d"), "node", "x", "y")).alias(name))

    pair = closest(a, "p").crossJoin(closest(b, "q")).where("p is not null and q is not null")  # one row each
    w = planar(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y"))
    one = pair.select(F.col("p.node").alias("u"), F.col("q.node").alias("v"), w.alias("w"))
    return one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
