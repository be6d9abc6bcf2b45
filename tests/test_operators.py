"""Operators on small fixtures with answers by hand."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from transitloom.functions import geo, text, times
from transitloom.operators import aggregates, calendar, graph, links, rows, sequences, spatial
from transitloom.plans.components import components


def values(df):
    return sorted(tuple(r) for r in df.collect())


WEEK = [1, 1, 1, 1, 1, 0, 0]


def compiled(spark, exceptions, mode="set"):
    cal = spark.createDataFrame([("s", *WEEK, 20240101, 20240114)], "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date int, end_date int")
    extra = spark.createDataFrame(exceptions, "service_id string, date int, exception_type int")
    return {r["date"] for r in calendar.compile_services(cal, extra, date(2020, 1, 1), date(2030, 1, 1), mode).collect()}


def test_calendar_adds_and_removes(spark):
    got = compiled(spark, [("s", 20240106, 1), ("s", 20240102, 2)])
    assert len(got) == 10 and date(2024, 1, 6) in got and date(2024, 1, 2) not in got


def test_calendar_modes_differ_on_odd_exceptions(spark):
    odd = [("s", 20240107, 2), ("s", 20240103, 1)]
    assert len(compiled(spark, odd)) == 10
    other = compiled(spark, odd, "symdiff")
    assert date(2024, 1, 7) in other and date(2024, 1, 3) not in other


def test_empty_range_has_no_dates(spark):
    df = spark.sql("select date'2024-01-02' s, date'2024-01-01' e")
    assert df.select(F.size(calendar.active_dates(F.col("s"), F.col("e"), F.array(*[F.lit(1)] * 7)))).first()[0] == 0


def test_times(spark):
    df = spark.createDataFrame([("23:50:00",), ("24:10:00",), ("25:10:05",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(times.clock_seconds(F.col("t"))).collect()] == [85800, 87000, 90605, None, None]
    one = spark.range(1)
    assert one.select(times.hhmm_minutes(F.lit(1145)) - times.hhmm_minutes(F.lit(930))).first()[0] == 135
    assert one.select(times.minutes_clock(F.lit(-20) + 1440)).first()[0] == "23:40:00"
    assert times.zone_offset_minutes("Europe/Athens", date(2025, 1, 15)) == 120
    assert times.zone_offset_minutes("Nowhere/At", date(2025, 1, 15)) is None


def test_downstream_pairs(spark):
    e = spark.createDataFrame([(1, i, s, 10 * i) for i, s in enumerate("ABCA")], "trip int, i int, stn string, t int")
    assert sequences.timetable_pairs(e, "trip", ["i"], "stn", "t", "t").count() == 6
    assert sequences.timetable_pairs(e, "trip", ["i"], "stn", "t", "t", drop_self=True).count() == 5
    a = spark.range(1).select(F.array(*map(F.lit, "ABCA")).alias("a"))
    assert a.select(F.size(sequences.downstream(F.col("a"))), F.size(sequences.consecutive(F.col("a")))).first() == (6, 3)


def test_missing_leg_breaks_distances(spark):
    legs = spark.createDataFrame([(1, 0, 0.0), (1, 1, 10.0), (1, 2, None), (1, 3, 5.0)], "line int, pos int, d double")
    c = {r["pos"]: (r["cum"], r["missing"]) for r in sequences.cumulative_pairs(legs, "line", "pos", "d").collect()}
    assert c[1][0] - c[0][0] == 10 and c[3][0] - c[2][0] == 5 and c[2][1] != c[1][1]


def test_clusters(spark):
    p = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate((0, 300, 650, 2000))] + [(9, None, 0.0)], "id int, x double, y double")
    assert values(spatial.clusters(p, "id", 400.0)) == [(0, 0), (1, 0), (2, 0), (3, 3), (9, 9)]


def test_weighted_mean(spark):
    df = spark.createDataFrame([(100, 10.0), (300, 20.0), (50, None)], "popu int, time double")
    assert df.agg(aggregates.weighted_mean(F.col("time"), F.col("popu"))).first()[0] == 17.5


def test_bridges(spark):
    m = spark.createDataFrame([("o", "A", 600.0, 10_000.0), ("B", "d", 1200.0, 20_000.0)], "src string, trg string, time double, dist double")
    b = links.in_metres_and_seconds(spark.createDataFrame([("A", "B", 178.0, 164.0)], "a string, b string, dist double, time double"), "dist", "time")
    way = links.compose_via(m, b, ["time", "dist"]).where("src = 'o' and trg = 'd'").first()
    assert (way["dist"] / 1000, way["time"] / 60) == (208.0, 194.0)


def test_two_bridges_need_two_rounds(spark):
    m = spark.createDataFrame([("o", "A", 1.0), ("B", "C", 1.0), ("D", "d", 1.0)], "src string, trg string, time double")
    b = spark.createDataFrame([("A", "B", 5.0), ("C", "D", 5.0)], "a string, b string, time double")
    assert links.compose_via(m, b, ["time"]).where("src = 'o' and trg = 'd'").count() == 0
    assert links.compose_via(m, b, ["time"], rounds=2).where("src = 'o' and trg = 'd'").first()["time"] == 13.0


def test_coverage(spark):
    df = spark.createDataFrame([("r", p, i) for p, xs in {"X": (1, 2, 3), "Y": (2, 3), "Z": (3, 4)}.items() for i in xs], "mode string, provider string, item int")
    assert {r["provider"]: r["n_new"] for r in aggregates.coverage(df, "mode", "provider", "item").collect()} == {"X": 3, "Y": 0, "Z": 1}


def test_weighted_statistics_equal_exploded(spark):
    df = spark.createDataFrame([(1, 2, 3, 1), (1, 2, 7, 4), (1, 2, 5, 2)], "src int, trg int, t int, w int")
    a = aggregates.weighted_link_statistics(df, ["src", "trg"], "t", "w", 1461).first()
    b = aggregates.link_statistics(df.withColumn("k", F.explode(F.sequence(F.lit(1), "w"))), ["src", "trg"], F.col("t"), 1461).first()
    for c in ("nservices", "avg_time", "median_time", "std_time", "avg_freq"):
        assert a[c] == pytest.approx(b[c])


def test_many_to_one_rejects_repeated_keys(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        rows.many_to_one(a, b, ["k"])


def test_surrogate_keys_are_dense_and_ordered(spark):
    df = rows.surrogate_key(spark.range(100).select((F.lit(99) - F.col("id")).alias("v")).repartition(7), "id", ["v"])
    assert values(df.select("id", "v")) == [(i, i) for i in range(100)]


def test_projection(spark):
    x, y = geo.project(F.lit(5.0), F.lit(50.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (round(row["x"], 2), round(row["y"], 2)) == (3962799.45, 2999718.85)
    lon, lat = geo.unproject(F.lit(row["x"]), F.lit(row["y"]))
    back = spark.range(1).select(lon, lat).first()
    assert back[0] == pytest.approx(5.0, abs=1e-7) and back[1] == pytest.approx(50.0, abs=1e-7)


def test_lines(spark):
    df = spark.sql("select array(named_struct('x', 0D, 'y', 0D), named_struct('x', 3D, 'y', 4D), named_struct('x', 3D, 'y', 4D), named_struct('x', 3D, 'y', 10D)) p, array(struct(1D x, 1D y)) q")
    row = df.select(geo.line_length(F.col("p")), F.size(geo.rounded_line(F.col("p"))), geo.line_valid(F.col("p")), geo.line_valid(F.col("q")), geo.line_length(F.col("q"))).first()
    assert tuple(row) == (11.0, 3, True, False, 0.0)


def test_text(spark):
    one = spark.createDataFrame([("Gare du Nord | Paris Nord", "a.zip")], "a string, b string")
    got = one.select(text.split_take(F.col("a"), " | "), text.without_suffix(F.col("b"), ".zip"), text.padded_id("STN_", F.lit(123456), 4), text.top_names(F.array(*map(F.lit, "babc")))).first()
    assert tuple(got) == ("Gare du Nord", "a", "STN_123456", "b | a | c")


@pytest.mark.parametrize("part_edges", [500_000, 25, 6])
def test_components(spark, part_edges):
    import random

    rng = random.Random(part_edges)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*pairs, (None, 3), (5, None)], "u long, v long").repartition(5)
    assert dict(values(components(df, part_edges=part_edges))) == {x: find(x) for x in top}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_redundant_stations(spark):
    # 1 and 2 both serve a-b with 3; 1 goes first, and then 2 must stay
    s = spark.createDataFrame([(1, 3, "ab"), (3, 1, "ab"), (2, 3, "ab"), (3, 2, "ab")], "stn long, partner long, od string")
    served = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (7, 0)], "stn long, n long")
    assert values(graph.redundant_stations(s, served)) == [(1,), (7,)]  # 7 supports nothing


@pytest.mark.parametrize("seed", range(4))
def test_redundant_stations_equal_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    pairs = {(*sorted(rng.sample(range(14), 2)), f"r{rng.randint(0, 6)}") for _ in range(40)}
    served = {s: rng.randint(0, 5) for s in range(16)}
    alive, gone = set(pairs), []
    for s in sorted(served, key=lambda s: (served[s], s)):
        rest = {p for p in alive if s not in p[:2]}
        if {p[2] for p in rest} == {p[2] for p in alive}:
            alive = rest
            gone.append((s,))
    rows = [(a, b, od) for a, b, od in pairs] + [(b, a, od) for a, b, od in pairs]
    got = graph.redundant_stations(spark.createDataFrame(rows, "stn long, partner long, od string"), spark.createDataFrame(list(served.items()), "stn long, n long"))
    assert values(got) == sorted(gone)


def test_runs_and_flattened_lists(spark):
    df = spark.createDataFrame([(2, ["x"]), (1, ["a", "b"]), (3, []), (4, None), (5, ["q", "r", "s"])], "k int, v array<string>").repartition(3)
    heads, items = sequences.flattened(df, "k", "v")
    assert {r["k"]: (r["start"], r["n"]) for r in heads.collect()} == {1: (0, 2), 2: (2, 1), 3: (None, 0), 4: (None, 0), 5: (3, 3)}
    assert [r["value"] for r in items.orderBy("place").collect()] == ["a", "b", "x", "q", "r", "s"]
    assert values(sequences.run_starts(spark.createDataFrame([(3,), (1,), (3,), (2,), (1,)], "k int").repartition(4), ["k"])) == [(1, 0, 2), (2, 2, 1), (3, 3, 2)]


def test_violations(spark):
    n = spark.createDataFrame([("a", 1.0, 2.0), ("b", 200.0, 2.0)], "node_id string, lon double, lat double")
    ln = spark.createDataFrame([("a", "b", 5.0, 1.0, "Bus", "x"), ("a", "c", -1.0, None, "Bus", None), ("a", "a", 1.0, None, "Car", None)], "src string, trg string, time double, freq double, mode string, operator string")
    got = {r["check"]: r["violations"] for r in links.violations(n, ln).collect()}
    assert got == {"node_id_null": 0, "node_id_repeated": 0, "coordinates": 1, "endpoint_null": 0, "src_unknown": 0, "trg_unknown": 1, "time": 1, "operator_or_freq_null": 1, "freq": 0, "self_link": 1}


def test_snapped_stations(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 8, 9), (2, 5, 6)], "island int, u int, v int")
    nodes = spark.createDataFrame([(k, float(10 * k), 0.0) for k in (1, 2, 3, 5, 6, 8, 9)], "node int, x double, y double")
    stations = spark.createDataFrame([(1, 25.0, 0.0), (2, 81.0, 0.0), (3, 52.0, 3.0), (4, 500.0, 0.0), (5, None, 0.0)], "stn int, x double, y double")
    found = {tuple(r) for r in graph.snapped_stations(stations, edges, nodes, "island", 21.0).select("stn", "node").collect()}
    # 8 is nearest to the second station, but not of its island's largest component
    assert found == {(1, 2), (2, 6), (3, 5)}
