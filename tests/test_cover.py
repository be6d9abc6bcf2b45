"""The cell cover of polygons against the parity of all edges."""

import math
import random

import pytest

from transitloom.operators import spatial


def inside(edges, x, y):
    return sum((y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 for x0, y0, x1, y1 in edges) % 2 == 1


def ring_edges(ring):
    return [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]


@pytest.mark.parametrize("size", [1.0, 3.7, 50.0])
def test_cover_equals_parity(spark, size):
    rng = random.Random(7)
    star = [(20 + r * math.cos(a), 15 + r * math.sin(a)) for k in range(40) for a, r in [(k * math.pi / 20, rng.uniform(4, 18))]]
    square = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0)]  # its sides lie on lines of the grid
    hole = [(10.0, 10.0), (10.0, 20.0), (20.0, 20.0), (20.0, 10.0)]
    comb = [(float(x), 0.0 if x % 2 else 8.0) for x in range(-20, 20)] + [(19.0, -6.0), (-20.0, -6.0)]
    far = [(-1000.5, -1000.5), (1000.0, -999.0), (998.0, 1001.0), (-1003.0, 997.0)]
    shapes = {1: ring_edges(star), 2: ring_edges(square) + ring_edges(hole), 3: ring_edges(comb), 4: ring_edges(far) if size > 2 else ring_edges(star)}
    points = [(i, rng.uniform(-25, 45), rng.uniform(-10, 40)) for i in range(400)] + [(1000 + 50 * i + j, float(i), float(j)) for i in range(-4, 34, 2) for j in range(-4, 34, 3)]
    points += [(5000, 1e9, 0.0), (5001, None, 1.0), (5002, float("nan"), 1.0), (5003, 1.0, float("inf"))]
    want = sorted((i, k) for i, x, y in points for k, e in shapes.items() if x is not None and math.isfinite(x) and math.isfinite(y) and inside(e, x, y))
    edges = spark.createDataFrame([(k, *map(float, e)) for k, es in shapes.items() for e in es], "poly int, x0 double, y0 double, x1 double, y1 double").repartition(3)
    got = spatial.points_in_polygons(spark.createDataFrame(points, "id int, x double, y double"), edges, "id", "poly", size)
    assert sorted(map(tuple, got.collect())) == want


def test_cells_inside_carry_no_edges(spark):
    edges = spark.createDataFrame([(1, *e) for e in ring_edges([(0.5, 0.5), (99.5, 0.5), (99.5, 99.5), (0.5, 99.5)])], "poly int, x0 double, y0 double, x1 double, y1 double")
    cells = spatial.polygon_cover(edges, "poly", 1.0).collect()
    assert len(cells) == 100 * 100 and sum(c["edges"] is None for c in cells) == 98 * 98 and max(len(c["edges"] or ()) for c in cells) == 2
    assert all(c["inside"] for c in cells if c["edges"] is None)
    assert spatial.polygon_cover(edges.limit(0), "poly", 1.0).count() == 0
