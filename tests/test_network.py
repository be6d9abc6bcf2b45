"""The composite operators on a small world of three cities."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from transitloom.operators import air, assembly, graph, links, network, shapes, spatial

D = [date(2024, 1, 1), date(2024, 1, 2)]


@pytest.fixture(scope="module")
def world(spark):
    square = lambda x: [{"x": x - 900.0, "y": -900.0}, {"x": x + 900.0, "y": -900.0}, {"x": x + 900.0, "y": 900.0}, {"x": x - 900.0, "y": 900.0}]
    polygons = spark.createDataFrame([(k, square(x)) for k, x in ((1, 0.0), (2, 50_000.0), (3, 100_000.0))], "fua int, ring array<struct<x: double, y: double>>")
    stops = spark.createDataFrame([("f", "a1", "A", 0.0, 0.0), ("f", "a2", "A", 300.0, 0.0), ("f", "b1", "B", 50_000.0, 0.0), ("f", "c1", "C", 100_000.0, 0.0), ("f", "r1", "Rural", 25_000.0, 0.0)], "fid string, stop_id string, name string, x double, y double")
    seq = spark.createDataFrame([("f", 0, ["a1", "r1", "b1", "c1"]), ("f", 1, ["a1", "a2"]), ("f", 2, ["c1", "b1", "a2"]), ("f", 3, ["b1", "c1"])], "fid string, stop_seq int, stops array<string>")
    times = spark.createDataFrame([("f", 0, [0, 600, 1200, 2400], [60, 0, 120, 0]), ("f", 1, [0, 300], [0, 0]), ("f", 2, [0, 900, 1800], [0, 60, 0])], "fid string, time_seq int, rel array<int>, wait array<int>")
    edges = spatial.polygon_edges(polygons, "fua", "ring")
    urban = network.urban_stops(stops, edges)
    ic = network.intercity_sequences(seq, urban)
    stations, members = network.stations(ic, urban, edges)
    sseq = network.station_sequences(seq, network.catchment(stops, stations, members))
    journeys = spark.createDataFrame([(0, 0, 0, 36000, 1, "X", True, 0), (1, 2, 2, 39600, 1, "X", True, 0), (2, 0, 0, 1800, 1, "Y", False, 0)], "jrn int, stop_seq int, time_seq int, start int, tz_gap int, agency string, rail boolean, dateset int")
    timetable = network.interstation_timetable(journeys, sseq, times)
    lines, of = network.lines(timetable, journeys, stations)
    return {"urban": urban, "ic": ic, "stations": stations, "sseq": sseq, "timetable": timetable, "lines": lines, "journeys": journeys.join(of, "jrn"), "stops": stops, "seq": seq, "times": times}


def test_stations(world):
    assert world["urban"].count() == 4 and {r["stop_seq"] for r in world["ic"].collect()} == {0, 2, 3}
    got = {r["fua"]: (r["name"], r["x"]) for r in world["stations"].collect()}
    assert got == {1: ("A", 150.0), 2: ("B", 50_000.0), 3: ("C", 100_000.0)}


def test_sequences_and_timetable(world):
    stn = {r["fua"]: r["stn"] for r in world["stations"].collect()}
    got = {r["stop_seq"]: (r["positions"], r["stns"]) for r in world["sseq"].collect()}
    assert got == {0: ([0, 2, 3], [stn[1], stn[2], stn[3]]), 2: ([0, 1, 2], [stn[3], stn[2], stn[1]]), 3: ([0, 1], [stn[2], stn[3]])}
    rows = [(r["stn"], r["arr"], r["dep"]) for r in world["timetable"].where("jrn = 0").orderBy("arr").collect()]
    assert rows == [(stn[1], 540, 541), (stn[2], 560, 562), (stn[3], 580, 580)]
    assert world["timetable"].where("jrn = 2").agg(F.min("arr")).first()[0] == -30  # before midnight of GMT


def test_lines_and_segments(world):
    lines = world["lines"].collect()
    assert len(lines) == 3 and all(r["intercity"] for r in lines)
    s = {(r["src"], r["trg"]): (r["mode"], r["lines"]) for r in network.segments(world["lines"], world["stations"]).collect()}
    assert len(s) == 4 and {m for m, _ in s.values()} == {"Both", "Rail"}


def test_coverage_and_redundancy(spark, world):
    cities = spark.createDataFrame([(1, "DE"), (2, "FR"), (3, "FR")], "fua int, icc string")
    got = {(r["agency"], r["rail"]): (r["n_items"], r["n_new"], r["country"]) for r in network.agency_coverage(world["lines"], world["stations"], cities).collect()}
    assert got == {("X", True): (2, 2, "DE,FR"), ("Y", False): (2, 2, "DE,FR")}
    served = network.served_relations(world["lines"], world["stations"])
    assert {r["n"] for r in served.collect()} == {6}
    assert graph.redundant_stations(network.od_support(world["lines"], world["stations"]), served).count() == 0


def test_reduced_tables(spark, world):
    stn = {r["fua"]: r["stn"] for r in world["stations"].collect()}
    kept = network.truncated_lines(world["lines"].where("agency = 'X'"), spark.createDataFrame([(stn[1],), (stn[3],)], "stn long"))
    days = spark.createDataFrame([(0, D), (1, D)], "dateset int, dates array<date>")
    whole = network.segments(world["lines"], world["stations"])
    j, t, d, s = network.reduced(kept, world["journeys"], world["timetable"], days, whole)
    assert sorted(r["jrn"] for r in j.collect()) == [0, 1] and d.count() == 1
    assert sorted((r["jrn"], r["stn"]) for r in t.collect()) == sorted((k, stn[f]) for k in (0, 1) for f in (1, 3))
    assert s.count() == 0  # the shortened lines have no segment of before
    assert network.reduced(world["lines"], world["journeys"], world["timetable"], days, whole)[3].count() == whole.count()


def test_european_routes(spark):
    r = spark.createDataFrame([(1, "Europe/Paris"), (2, "Asia/Tokyo"), (3, None), (4, "Europe")], "route_id int, tz string")
    assert sorted(x["route_id"] for x in network.european_routes(r).collect()) == [1, 4]


def test_pt_links(spark, world):
    ops = spark.createDataFrame([("X", True, "Ex"), ("Y", False, "Why")], "agency string, rail boolean, operator string")
    lines = network.harmonised(world["lines"], ops, world["stations"])
    lengths = network.segments(world["lines"], world["stations"]).select("src", "trg", F.explode(F.array(F.lit(True), F.lit(False))).alias("rail"), F.lit(50.0).alias("len_km"))
    days = spark.createDataFrame([(0, D)], "dateset int, dates array<date>")
    stn = {r["fua"]: r["stn"] for r in world["stations"].collect()}
    got = {(r["src"], r["trg"], r["operator"]): r for r in network.pt_links(world["timetable"], world["journeys"], lines, days, lengths).collect()}
    row = got[(stn[1], stn[3], "Ex")]
    assert (row["nservices"], row["avg_time"], row["dist"], row["n_lines"]) == (2, 39.0, 100.0, 1) and row["avg_freq"] == pytest.approx(2 / 1461)
    assert len(got) == 9


def test_local_links(spark, world):
    hubs = spark.createDataFrame([(1, 0.0, 0.0, [1]), (2, 300.0, 0.0, [1, 2]), (3, 50_000.0, 0.0, [2])], "hub int, x double, y double, fuas array<int>")
    trips = spark.createDataFrame([(1, 1, 1, 36000, 0, 0), (2, 1, 1, 36000, 0, 0)], "trip int, stop_seq int, time_seq int, start int, dateset int, tz_gap int")
    days = spark.createDataFrame([(0, D)], "dateset int, dates array<date>")
    got = network.local_links(world["stops"], hubs, trips, world["seq"], world["times"], days).collect()
    assert [(r["src"], r["trg"], r["nservices"], r["avg_time"]) for r in got] == [(1, 2, 2, 5.0)]  # equal trips count once a date


def test_air(spark):
    listed = spark.createDataFrame([("CDG", "LFPG", 2.55, 49.01, "Europe/Paris"), ("ATH", "LGAV", 23.94, 37.94, "Europe/Athens"), ("XXX", "X", 0.0, 0.0, "Nowhere")], "iata string, icao string, lon double, lat double, zone string")
    schedule = spark.createDataFrame([("CDG", "ATH", "AF", 570, 825, "12", date(2024, 1, 1), date(2024, 1, 8)), ("CDG", "CDG", "AF", 1, 2, "1", D[0], D[0]), ("CDG", "ATH", "ZZ", 1380, 60, "7", D[0], date(2024, 1, 7))], "src string, trg string, carrier string, dep int, arr int, op_days string, start_date date, end_date date")
    offsets = spark.createDataFrame([("Europe/Paris", 60), ("Europe/Athens", 120), ("Nowhere", None)], "zone string, offset int")
    from transitloom.functions.geo import project

    x, y = project(F.col("lon"), F.col("lat"))
    cities = spark.createDataFrame([(1, 2.35, 48.85), (2, 23.73, 37.98)], "fua int, lon double, lat double").select("fua", x.alias("x"), y.alias("y"))
    a = air.airports(listed, schedule, offsets, cities)
    assert {(r["node_id"], tuple(r["fuas"])) for r in a.collect()} == {("AIR_CDG", (1,)), ("AIR_ATH", (2,))}
    carriers = spark.createDataFrame([("AF", "Air France")], "carrier string, name string")
    t = air.timetable(schedule, a, carriers)
    got = {r["operator"]: (r["nservices"], r["avg_time"], r["dist"]) for r in air.links(t, a).collect()}
    assert got["Air France"][:2] == (3, 195.0) and 2080 < got["Air France"][2] < 2110  # Mondays and Tuesdays
    assert got["ZZ"][1] == -1380.0
    assert air.timetable(schedule, a, carriers, strict=True).count() == 1
    assert air.links(air.timetable(schedule, a, carriers, wrap_overnight=True), a).where("operator = 'ZZ'").first()["avg_time"] == 60.0
    assert air.dated(t).where("operator = 'Air France'").count() == 3


def test_access_and_assembly(spark):
    m = spark.createDataFrame([("c1", "h1", 600.0, 10_000.0), ("c2", "h1", 1200.0, 20_000.0), ("c3", "h1", None, None), ("h1", "c1", 660.0, 11_000.0), ("h1", "h2", 300.0, 5_000.0), ("h1", "h1", 0.0, 0.0)], "src_id string, trg_id string, time double, dist double")
    cells = spark.createDataFrame([("c1", 1, 100), ("c2", 1, 300), ("c3", 1, 50)], "cell string, fua int, popu int")
    hubs = spark.createDataFrame([("h1", 1), ("h2", 1)], "hub string, fua int")
    got = {(r["kind"], r["src"], r["trg"]): (r["time"], r["dist"]) for r in assembly.access(m, cells, hubs).collect()}
    assert got == {("Access", "1", "h1"): (17.5, 17.5), ("Egress", "h1", "1"): (11.0, 11.0), ("Interhub", "h1", "h2"): (5.0, 5.0)}
    st = spark.createDataFrame([("STN_1", "A | a", 0.0, 0.0, 1.0, 1.0), ("STN_2", "B", 900.0, 0.0, 1.0, 1.0)], "node_id string, name string, x double, y double, lon double, lat double")
    ap = spark.createDataFrame([("AIR_X", "X", 300.0, 0.0, 1.0, 1.0)], "node_id string, name string, x double, y double, lon double, lat double")
    ci = spark.createDataFrame([("FUA_001", "C", 1.0, 1.0)], "node_id string, name string, lon double, lat double")
    moved = assembly.merged_stations(st, ap)
    nodes = assembly.nodes(ci, ap, st.withColumn("kind", F.lit("Bus")), moved)
    assert {(r["node_id"], r["kind"]) for r in nodes.collect()} == {("FUA_001", "City"), ("AIR_X", "Airport"), ("STN_2", "Bus")}
    ln = spark.createDataFrame([("STN_1", "STN_2"), ("STN_1", "AIR_X"), ("STN_2", "none")], "src string, trg string")
    assert [tuple(r) for r in assembly.graph_links([ln], moved, nodes).collect()] == [("AIR_X", "STN_2")]


def test_cities(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}]
    far = [{"x": p["x"] + 100, "y": p["y"]} for p in ring]
    polygons = spark.createDataFrame([("DE", "A", ring), ("FR", "A", far)], "icc string, name string, ring array<struct<x: double, y: double>>")
    grid = spark.createDataFrame([("DE", 150_000, 2.0, 2.0), ("DE", 50_000, 6.0, 6.0), ("FR", 100, 105.0, 5.0)], "icc string, popu long, x double, y double")
    assert [(r["node_id"], r["icc"], r["popu"], r["x"]) for r in assembly.cities(grid, polygons).collect()] == [("FUA_001", "DE", 200_000, 3.0)]


def test_manual_connector(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 2, 10.0, 0.0), (3, 100.0, 0.0, 4, 120.0, 0.0)], "u int, ux double, uy double, v int, vx double, vy double")
    assert sorted(tuple(r) for r in assembly.manual_connector(e, (11.0, 1.0), (99.0, 0.0), 5.0).collect()) == [(2, 3, 90.0), (3, 2, 90.0)]


def test_shapes(spark):
    # published test values of the inverse problem: about 54,972.271 m, and one degree of latitude at the equator
    assert shapes.geodesic([0.0], [0.0], [0.0], [1.0])[0] == pytest.approx(110574.389, abs=0.01)
    assert shapes.geodesic([0.0], [0.0], [1.0], [0.0])[0] == pytest.approx(111319.491, abs=0.01)
    assert shapes.geodesic([5.0], [5.0], [5.0], [5.0])[0] == 0
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 1.0, 1.0)], "shape int, i int, lon double, lat double")
    d = [r["dist"] for r in shapes.cumulative_m(p, "shape", "i").orderBy("i").collect()]
    assert d[0] == 0 and d[1] == pytest.approx(110574.389, abs=0.01) and d[2] > 2 * d[1] - 1000
    assert shapes.joined_parts([[(1, 0), (2, 0)], [(1, 0), (0, 0)]], (0, 0)) == [(0, 0), (1, 0), (2, 0)]
    assert shapes.simplified([(0, 0), (1, 0.01), (2, 0), (3, 5)], 0.1) == [(0, 0), (2, 0), (3, 5)]
    assert sorted(set(shapes.clipped_ring([(-1, -1), (3, -1), (3, 3), (-1, 3)], 0, 0, 1, 1))) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    one = spark.sql("select 1 shape, 0 k, array(named_struct('x', 1D, 'y', 0D), named_struct('x', 0D, 'y', 0D)) part, 0D x0, 0D y0")
    assert [p["x"] for p in shapes.assembled(one, "shape", "k", "part", "x0", "y0").first()["line"]] == [0.0, 1.0]


def test_geodesic_columns_equal_the_arrays(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(-180, 180), rng.uniform(-85, 85), rng.uniform(-180, 180), rng.uniform(-85, 85)) for _ in range(300)]
    rows += [(5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 1.0, 0.0), (0.0, 90.0, 20.0, 90.0), (0.0, 0.0, 180.0, 0.0), (10.0, 20.0, -170.0, -20.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r["m"] for r in df.select("*", shapes.geodesic_m(*[F.col(c) for c in "abcd"]).alias("m")).collect()]
    want = shapes.geodesic(*zip(*rows, strict=True))
    assert all(abs(g - w) < 1e-3 for g, w in zip(got, want, strict=True))
    assert spark.range(1).select(shapes.geodesic_m(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)).alias("m")).first()["m"] is None


def test_matrix_blocks(spark):
    a = spark.createDataFrame([(k,) for k in [5, 3, 9, 1, 7, None, 3]], "k int")
    b = spark.createDataFrame([(10,), (20,), (30,)], "k int")
    blocks = links.matrix_blocks(a, b, "k", 2)
    assert sorted((r["bi"], r["bj"], r["src"], r["trg"]) for r in blocks.collect()) == [(i, j, s, t) for i, s in enumerate([[1, 3], [5, 7], [9]]) for j, t in enumerate([[10, 20], [30]])]
    m = spark.createDataFrame([(1, 10, 1.0), (1, 20, 2.0), (3, 10, float("nan")), (9, 30, 5.0)], "src int, trg int, time double")
    full = links.filled_blocks(blocks, m, ["time"])
    assert {(r["src"], r["trg"]): str(r["time"]) for r in links.unfolded(full, ["time"]).collect()} == {(s, t): str({(1, 10): 1.0, (1, 20): 2.0, (3, 10): float("nan"), (9, 30): 5.0}.get((s, t))) for s in (1, 3, 5, 7, 9) for t in (10, 20, 30)}
    assert {(r["bi"], r["bj"]): r["n"] for r in links.unusable_cells(full, "time").collect()} == {(0, 0): 2, (0, 1): 2, (1, 0): 4, (1, 1): 2, (2, 0): 2}
    with pytest.raises(Exception, match="do not fit"):
        links.unfolded(full.withColumn("time", F.slice("time", 1, 1)), ["time"]).collect()
    assert links.matrix_blocks(a, b.limit(0), "k", 2).count() == 0
