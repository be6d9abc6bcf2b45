"""Vector layers: round trips, ranges of bytes, filters that reach the reader."""

import json

from pyspark.sql import functions as F

from transitloom.operators import spatial
from transitloom.sources import geojson

SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
HOLE = [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]


def layer(tmp_path):
    polygon = lambda props, *rings: {"type": "Feature", "properties": props, "geometry": {"type": "Polygon", "coordinates": rings}}
    far = [[x + 100, y] for x, y in SQUARE]
    features = [
        polygon({"name": "A", "popu": 5, "more": [1]}, SQUARE, HOLE),
        {"type": "Feature", "properties": {"name": "B", "popu": "many"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [far]]}},
        {"type": "Feature", "properties": None, "geometry": None},
        {"type": "Feature", "properties": {"name": 7, "popu": 2.5}, "geometry": {"type": "Point", "coordinates": [3, 4, 5]}},
        {"type": "Feature", "properties": {"name": "C", "popu": 9}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 5]]}},
    ]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "all.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "part.txt").write_text("\n".join(json.dumps(f) for f in features) + "\n\n")
    return tmp_path


def test_features(spark, tmp_path):
    at = layer(tmp_path)
    df = geojson.read_features(spark, f"file://{at}/c", "name string, popu long")
    got = {r["name"]: r for r in df.collect()}
    assert {k: (r["popu"], r["kind"], r["x0"], r["y1"], r["rings"] and len(r["rings"])) for k, r in got.items()} == {"A": (5, "Polygon", 0, 10, 2), "B": (None, "MultiPolygon", 0, 10, 2), None: (None, None, None, None, None), "7": (None, "Point", 3, 4, 1), "C": (9, "LineString", 1, 5, 1)}
    assert geojson.read_features(spark, f"file://{at}/c", "popu long", geometry=False).columns == ["popu", "kind", "x0", "y0", "x1", "y1"]
    for size in (1, 7, 60, 1 << 20):  # each line is read once, wherever ranges are cut
        lines = geojson.read_features(spark, f"file://{at}/lines", "name string, popu long", lines=True, split_bytes=size)
        assert sorted(map(str, lines.collect())) == sorted(map(str, df.collect()))


def test_filters_reach_the_reader(spark, tmp_path, capsys):
    df = geojson.read_features(spark, f"file://{layer(tmp_path)}/c", "name string, popu long")
    some = df.where("popu > 4 and x0 <= 0.5 and name in ('A', 'C') and size(rings) = 2")
    some.explain("formatted")
    plan = capsys.readouterr().out
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert all(x in pushed for x in ("GreaterThan(popu,4)", "LessThanOrEqual(x0,0.5)", "In(name, [A,C])")) and "size" not in pushed
    assert [r["name"] for r in some.collect()] == ["A"]
    assert [r["name"] for r in df.where("name like 'B%' and popu is null").collect()] == ["B"]
    assert df.where("kind is null").count() == 1 and df.where("popu <=> 9").count() == 1


def test_points_in_features_with_holes(spark, tmp_path):
    df = geojson.read_features(spark, f"file://{layer(tmp_path)}/c", "name string").where("kind in ('Polygon', 'MultiPolygon')")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, 105.0, 5.0), (4, 50.0, 5.0)], "id int, x double, y double")
    got = spatial.points_in_polygons(points, geojson.feature_edges(df, "name"), "id", "name", 3.0)
    assert sorted(map(tuple, got.collect())) == [(1, "B"), (2, "A"), (2, "B"), (3, "B")]


def test_written_features_come_back(spark, tmp_path):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in SQUARE[:-1]])
    df = spark.range(500).select("id", F.concat(F.lit("n"), "id").alias("name"), F.array(ring).alias("rings")).repartition(3)
    geojson.write_features(df, f"{tmp_path}/out", ["id", "name"])
    back = geojson.read_features(spark, f"file://{tmp_path}/out", "id long, name string", lines=True, split_bytes=4000)
    assert back.count() == 500 and {tuple(r) for r in back.select("id", "name").collect()} == {(i, f"n{i}") for i in range(500)}
    assert len(back.first()["rings"][0]) == 5
