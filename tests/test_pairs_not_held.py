"""Pairs of lines and of journeys are counted before medians are taken: no task sorts or holds them."""

import random
import statistics

from transitloom.operators import aggregates, network


def plan(df, node):
    return df._jdf.queryExecution().optimizedPlan().toString().count(node)


def test_operator_pairs_are_the_plain_loop(spark):
    rng = random.Random(5)
    table = [(k, k % 2 == 0, rng.choice(["A1", "A2", ".Local"]), k % 3 == 0, [rng.choice("abcdef") for _ in range(rng.randrange(0, 9))]) for k in range(120)]
    km = {(s, t, rail): rng.choice([1.5, 2.0, 7.25]) for s in "abcdef" for t in "abcdef" for rail in (True, False) if rng.random() < 0.7}
    want = {}
    for _, rail, operator, intercity, stns in table:
        if operator == ".Local":
            continue
        legs, seen = [0.0, *[km.get((s, t, rail)) for s, t in zip(stns, stns[1:])]], set()
        for i, src in enumerate(stns):
            for j in range(i + 1, len(stns)):
                if stns[j] != src and (src, stns[j]) not in seen:
                    seen.add((src, stns[j]))
                    between = legs[i + 1 : j + 1]
                    want.setdefault((src, stns[j], rail, operator), []).append((None if None in between else sum(between), intercity))
    lengths = spark.createDataFrame([(*k, v) for k, v in km.items()], "src string, trg string, rail boolean, len_km double")
    pairs = network.operator_pairs(spark.createDataFrame(table, "line long, rail boolean, operator string, intercity boolean, stns array<string>"), lengths)
    got = {(r["src"], r["trg"], r["rail"], r["operator"]): (r["dist"], r["n_lines"], r["intercity"]) for r in pairs.collect()}
    known = {k: [d for d, _ in v if d is not None] for k, v in want.items()}
    assert got == {k: (statistics.median(known[k]) if known[k] else None, len(v), any(c for _, c in v)) for k, v in want.items()} and len(got) > 90
    assert plan(pairs, "Join ") == 1  # with the lengths only
    assert dict(pairs.dtypes)["n_lines"] == "bigint"


def test_equal_times_are_added_up_first(spark):
    rows = [("a", k % 4, k % 3) for k in range(200)] + [("b", 5, 1), ("c", None, 2), ("d", 5, None)]
    got = aggregates.weighted_link_statistics(spark.createDataFrame(rows, "k string, time int, days long"), ["k"], "time", "days", 10)
    one = {r["k"]: r for r in got.collect()}
    each = [t for k, t, d in rows if k == "a" for _ in range(d)]
    a = one["a"]
    assert (a["nservices"], a["avg_time"], a["median_time"], a["avg_freq"]) == (len(each), statistics.mean(each), statistics.median(each), len(each) / 10)
    assert abs(a["std_time"] - statistics.stdev(each)) < 1e-12
    assert set(one) == {"a", "b", "c"} and one["b"]["std_time"] is None and (one["c"]["nservices"], one["c"]["avg_time"]) == (2, None)
    assert plan(got, "Aggregate ") == 2


def test_pairs_of_journeys_stay_with_their_trips(spark, monkeypatch):
    frame = lambda schema, *rows: spark.createDataFrame(rows, schema)
    times = frame("jrn long, stn string, arr int, dep int", (1, "a", 0, 0), (1, "b", 5, 5), (2, "a", 0, 0), (2, "b", 9, 9))
    lines = frame("line long, rail boolean, operator string, intercity boolean, stns array<string>", (0, True, "A", True, ["a", "b"]), (1, True, ".Local", False, ["a", "b"]))
    seen, real = [], aggregates.weighted_link_statistics
    monkeypatch.setattr(aggregates, "weighted_link_statistics", lambda pairs, *a: seen.append(pairs) or real(pairs, *a))
    got = network.pt_links(times, frame("jrn long, line long, dateset int", (1, 0, 0), (2, 1, 0)), lines, frame("dateset int, dates array<string>", (0, ["x", "y"])), frame("src string, trg string, rail boolean, len_km double", ("a", "b", True, 3.0)))
    assert [(r["src"], r["trg"], r["nservices"], r["avg_time"], r["dist"]) for r in got.collect()] == [("a", "b", 2, 5.0, 3.0)]
    top = next(x for x in seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x)
    assert "trip" in top and "line" not in top
