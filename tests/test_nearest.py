"""The nearest search and the edges that connect points, in crowded places, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from transitloom.operators import spatial
from transitloom.plans.components import components


def crowd(seed, n):
    rng = random.Random(seed)
    rows = [(k, rng.gauss(0, 2), rng.gauss(0, 2), k % 3) for k in range(n)]
    rows += [(1000 + k, 5.0, 5.0, k % 2) for k in range(60)]  # copies of one place
    return rows + [(2000 + k, 40.0 + 9 * k, 0.0, 1) for k in range(4)] + [(3000, None, 1.0, 1), (3001, 1.0, float("nan"), 1), (3002, 0.0, 0.0, None)]


def distance(p, q):
    return math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)


def usable(rows):
    return [r for r in rows if r[1] is not None and not math.isnan(r[2])]


@pytest.mark.parametrize("grouped", [False, True])
def test_nearest(spark, monkeypatch, grouped):
    monkeypatch.setattr(spatial, "CROWD", 4)
    rows = crowd(1, 150)
    left = spark.createDataFrame(rows, "id int, x double, y double, g int")
    right = left.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), *([F.col("g").alias("_group")] if grouped else []))
    if grouped:
        got = spatial.nearest_in_group(left, right, "g", 10.0, ["id"], "rid", unequal=("id", "rid"))
        fits = lambda p, q: p[0] != q[0] and p[3] is not None and p[3] == q[3]
    else:
        got = spatial.nearest(left, right.where("rid >= 100"), 10.0, ["id"], "rid")
        fits = lambda p, q: q[0] >= 100
    want = {}
    for p in usable(rows):
        near = min(((distance(p, q), q[0]) for q in usable(rows) if fits(p, q) and distance(p, q) <= 10.0), default=None)
        if near:
            want[p[0]] = near
    assert {r["id"]: (r["dist"], r["rid"]) for r in got.collect()} == want


def test_nearest_meets_few(spark):
    """Copies of one place count once, so no row meets them all."""
    rows = spark.range(20_000).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    right = rows.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    n, least = spatial.nearest(rows, right, 10.0, ["id"], "rid").agg(F.count("*"), F.max("rid")).first()
    assert (n, least) == (20_000, 0)


@pytest.mark.parametrize("grouped", [False, True])
def test_connecting(spark, grouped):
    rows = crowd(2, 150) + [(4000 + k, 100.0 + k % 2 * 1.2, k * 0.01, 0) for k in range(40)]
    points = spark.createDataFrame(rows, "id int, x double, y double, g int")
    edges = spatial.connecting(points, "id", 1.0, group="g" if grouped else None)
    got = {r["node"]: r["root"] for r in components(edges.select("u", "v")).collect()}
    root = {r[0]: r[0] for r in usable(rows)}
    pairs = [(p[0], q[0]) for p in usable(rows) for q in usable(rows) if p[0] < q[0] and distance(p, q) <= 1.0 and (not grouped or p[3] is not None and p[3] == q[3])]
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: root[k] for pair in pairs for k in pair}
    # far fewer edges than the pairs of a crowd
    assert edges.count() < len(rows) + len(pairs) // 4


@pytest.mark.parametrize("radius", [0.3, 1.0, 10.0])
def test_greatest_within(spark, monkeypatch, radius):
    monkeypatch.setattr(spatial, "BLOCK", 16)
    rows = crowd(3, 700)
    left = spark.createDataFrame(rows, "id int, x double, y double, g int").select((F.col("id") % 900).alias("node"), "x", "y")
    right = spark.createDataFrame([(f"T{r[0] * 7 % 1009}" if r[0] % 50 else None, r[1], r[2]) for r in rows[::2]], "target string, rx double, ry double")
    want = {}
    places = [(t["target"], t["rx"], t["ry"]) for t in right.collect()]
    for p in usable(rows):
        near = [q[0] for q in usable(places) if distance(p, q) <= radius]
        if near:
            want.setdefault(p[0] % 900, []).extend(t for t in near if t is not None)
    got = {r["node"]: r["target"] for r in spatial.greatest_within(left, right, radius, "node", "target").collect()}
    assert got == {k: max(v, default=None) for k, v in want.items()} and len(got) > 600


def test_a_crowd_of_stations_meets_few_airports(spark, monkeypatch):
    """All of one place's pairs: none is made."""
    from transitloom.operators import assembly

    seen, real = [], spatial.staged
    monkeypatch.setattr(spatial, "staged", lambda df, name="table": seen.append((name, t := real(df, name))) or t)
    many = spark.range(2000).select(F.col("id").cast("string").alias("node_id"), (F.col("id") % 100).cast("double").alias("x"), F.floor(F.col("id") / 100).cast("double").alias("y"))
    moved = assembly.merged_stations(many, many)
    assert {r["target"] for r in moved.collect()} == {"999"} and moved.count() == 2000
    assert [t.count() for name, t in seen if name == "found"] == [2000]
    assert "ArrayFilter" not in moved._jdf.queryExecution().toString() and sum(name == "lists" for name, _ in seen) == 1
