"""Queries of polygons: each row of `embeddings` gives a triangle, a box, a cell and a point by its first dimensions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from transitloom.operators import polygons
from transitloom.plans.catalogue import query
from transitloom.plans.frames import points
from transitloom.plans.queries_graph import PT
from transitloom.plans.staging import shared_folder
from transitloom.sources import geojson

CELL = 500.0


def dimension(k):
    return F.get("embedding", F.lit(k)).cast("double")


def point(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


@query("WITH t AS (SELECT vec_id AS id, list_transform(embedding[1:6], lambda v: v::DOUBLE * 10000) AS e FROM embeddings WHERE len(embedding) >= 6) SELECT id, round(abs((e[3] - e[1]) * (e[6] - e[2]) - (e[5] - e[1]) * (e[4] - e[2])) / 2, 2) AS area FROM t")
def triangle_pieces(t, spark):
    at = [dimension(k) * 10000 for k in range(6)]
    p = t("embeddings").select(F.col("vec_id").alias("id"), F.array(point(*at[0:2]), point(*at[2:4]), point(*at[4:6])).alias("ring"))
    return polygons.pieces(p, "ring", 1000.0).groupBy("id").agg(F.round(F.sum(F.abs(polygons.signed_area(F.col("ring")))), 2).alias("area"))


@query(
    """WITH b AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 10000 AS x, embedding[2]::DOUBLE * 10000 AS y, 200 + abs(embedding[3]::DOUBLE) * 5000 AS w, 200 + abs(embedding[4]::DOUBLE) * 5000 AS h FROM embeddings)
  SELECT p.id AS a, q.id AS b, round((least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * (least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)), 2) AS area FROM b p JOIN b q ON p.id < q.id AND p.x < q.x + q.w AND q.x < p.x + p.w AND p.y < q.y + q.h AND q.y < p.y + p.h"""
)
def box_overlay(t, spark):
    x, y, w, h = dimension(0) * 10000, dimension(1) * 10000, 200 + F.abs(dimension(2)) * 5000, 200 + F.abs(dimension(3)) * 5000
    b = t("embeddings").select(F.col("vec_id").alias("a"), F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)).alias("ring"))
    return polygons.overlay_areas(b, b.withColumnRenamed("a", "b"), "a", "b", 1000.0, F.col("a") < F.col("b")).select("a", "b", F.round("area", 2).alias("area"))


@query(
    f"""WITH RECURSIVE c AS (SELECT DISTINCT label, CAST(floor(embedding[1]::DOUBLE * 20) AS INT) AS i, CAST(floor(embedding[2]::DOUBLE * 20) AS INT) AS j FROM embeddings WHERE label IS NOT NULL),
  beside AS (SELECT a.label, a.i, a.j, b.i AS k, b.j AS l FROM c a JOIN c b ON a.label = b.label AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
  reach AS (SELECT label, i, j, i * 1000 + j AS root FROM c UNION SELECT r.label, k, l, root FROM reach r JOIN beside b ON b.label = r.label AND b.i = r.i AND b.j = r.j),
  part AS (SELECT label, count(DISTINCT root) AS parts FROM (SELECT label, i, j, min(root) AS root FROM reach GROUP BY ALL) GROUP BY label),
  size AS (SELECT label, count(*) AS cells FROM c GROUP BY label), pair AS (SELECT label, count(*) // 2 AS pairs FROM beside GROUP BY label),
  block AS (SELECT a.label, count(*) AS blocks FROM c a JOIN c b ON b.label = a.label AND b.i = a.i + 1 AND b.j = a.j JOIN c d ON d.label = a.label AND d.i = a.i AND d.j = a.j + 1 JOIN c e ON e.label = a.label AND e.i = a.i + 1 AND e.j = a.j + 1 GROUP BY a.label)
  SELECT label, 2 * parts - (cells - coalesce(pairs, 0) + coalesce(blocks, 0)) AS n_rings, 4 * cells - 2 * coalesce(pairs, 0) AS n_corners, (cells * {CELL} * {CELL})::DOUBLE AS area FROM size JOIN part USING (label) LEFT JOIN pair USING (label) LEFT JOIN block USING (label)"""
)
def dissolved_cells(t, spark):
    x, y = F.floor(dimension(0) * 20) * CELL, F.floor(dimension(1) * 20) * CELL
    cells = t("embeddings").where("label is not null").select("label", F.array(point(x, y), point(x + CELL, y), point(x + CELL, y + CELL), point(x, y + CELL)).alias("ring"))
    return polygons.dissolved(cells, "label", "ring").groupBy("label").agg(F.count("*").alias("n_rings"), F.sum(F.size("ring")).alias("n_corners"), F.sum("area").alias("area"))


@query(
    PT
    + """, p AS (SELECT DISTINCT label, x, y FROM pt WHERE label IS NOT NULL), side AS (SELECT a.label, a.x, a.y FROM p a JOIN p b ON a.label = b.label AND (a.x, a.y) <> (b.x, b.y) JOIN p c ON a.label = c.label GROUP BY a.label, a.x, a.y, b.x, b.y
    HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR (c.x, c.y) = (a.x, a.y) OR (c.x, c.y) = (b.x, b.y)))
  SELECT DISTINCT label, round(x, 4) AS x, round(y, 4) AS y FROM side"""
)
def label_hulls(t, spark):
    h = polygons.hulls(points(t), "label").select("label", F.explode("ring").alias("p"))
    return h.select("label", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query(
    """WITH b AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE * 10000 AS x, embedding[2]::DOUBLE * 10000 AS y, 200 + abs(embedding[3]::DOUBLE) * 5000 AS w FROM embeddings)
  SELECT id, label, round(x, 3) AS x0, round(y + w, 3) AS y1, round(w * w * 0.75, 2) AS area FROM b WHERE label >= 3 AND x > -500"""
)
def vector_layer(t, spark):
    x, y, w = dimension(0) * 10000, dimension(1) * 10000, 200 + F.abs(dimension(2)) * 5000
    square = lambda a, b, side: F.array(point(a, b), point(a + side, b), point(a + side, b + side), point(a, b + side))
    boxes = t("embeddings").select(F.col("vec_id").alias("id"), "label", F.array(square(x, y, w), F.reverse(square(x + w / 4, y + w / 4, w / 2))).alias("rings"))
    path = f"{shared_folder(spark)}/layer-{uuid.uuid4().hex}"
    geojson.write_features(boxes, path, ["id", "label"])
    back = geojson.read_features(spark, path if ":" in path else f"file://{path}", "id long, label int", lines=True).where("label >= 3 and x0 > -500")
    area = F.aggregate(F.transform("rings", polygons.signed_area), F.lit(0.0), lambda s, a: s + a)
    return back.select("id", "label", F.round("x0", 3).alias("x0"), F.round("y1", 3).alias("y1"), F.round(area, 2).alias("area"))
