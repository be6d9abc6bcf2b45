"""Routing, orientation, chains and base graphs against brute force."""

import heapq
import random
from collections import defaultdict

import pytest

from transitloom.operators import chains, graph, routing


def values(df):
    return sorted(tuple(r) for r in df.collect())


def plain_ways(edges, source):
    """Labels (length, number of edges, node before, edge) of all nodes from one source."""
    arcs = defaultdict(dict)
    for e, u, v, w in edges:
        for a, b in ((u, v), (v, u)):
            if a != b:
                arcs[a][b] = min((w, e), arcs[a].get(b, (w, e)))
    best, heap = {}, [(0.0, 0, -1, "", source)]
    while heap:
        d, h, p, e, x = heapq.heappop(heap)
        if x in best:
            continue
        best[x] = (d, h, p, e)
        for y, (w, f) in arcs[x].items():
            heapq.heappush(heap, (d + w, h + 1, x, f, y))
    return best


def way(best, x):
    out = []
    while best[x][3]:
        out.append(best[x][3])
        x = best[x][2]
    return out[::-1]


@pytest.mark.parametrize("seed,stride", [(1, 16), (2, 2)])
def test_routes_equal_a_heap_search(spark, seed, stride):
    rng = random.Random(seed)
    edges = [(f"e{i}", rng.randrange(40), rng.randrange(40), float(rng.choice([0, 1, 1, 2, 3, 5]))) for i in range(60)] + [(f"f{i}", i, i + 1, 1.0) for i in range(100, 140)]
    pairs = [(rng.randrange(42), rng.randrange(42)) for _ in range(60)] + [(100, 140), (137, 101), (100, 3), (5, 5)]
    e = spark.createDataFrame(edges, "edge string, u int, v int, w double").repartition(3)
    p = spark.createDataFrame(pairs, "src int, trg int")
    want = {}
    for s, t in set(pairs):
        best = plain_ways(edges, s)
        want[s, t] = (best[t][0], way(best, t)) if t in best else (None, None)
    got = {(r["src"], r["trg"]): (r["length"], r["edges"]) for r in routing.shortest_routes(e, p, stride).collect()}
    assert got == want
    assert {(r["src"], r["trg"]): r["length"] for r in routing.shortest_paths(e.drop("edge"), p, stride).collect()} == {k: v[0] for k, v in want.items()}


def test_routes_by_hand(spark):
    e = spark.createDataFrame([("ab", 1, 2, 1.0), ("bc", 2, 3, 1.5), ("ac", 3, 1, 4.0), ("cd", 3, 4, 1.0), ("fg", 6, 7, 1.0), ("xx", 9, 9, 1.0), ("n", 1, 9, None)], "edge string, u int, v int, w double")
    p = spark.createDataFrame([(4, 1), (1, 7), (2, 4), (2, 2), (9, 9), (4, 1)], "src int, trg int")
    got = {(r["src"], r["trg"]): (r["length"], r["edges"]) for r in routing.shortest_routes(e, p).collect()}
    assert got == {(4, 1): (3.5, ["cd", "bc", "ab"]), (1, 7): (None, None), (2, 4): (2.5, ["bc", "cd"]), (2, 2): (0.0, []), (9, 9): (0.0, [])}
    ways = {(r["u"], r["v"]): r["edges"] for r in routing.oriented_routes(e, spark.createDataFrame([(4, 1), (4, 2), (4, 3), (7, 6)], "u int, v int")).collect()}
    assert ways == {(1, 4): ["ab", "bc", "cd"], (2, 4): ["bc", "cd"], (3, 4): ["cd"], (6, 7): ["fg"]}
    assert routing.shortest_paths(e.limit(0), p).where("length is null").count() == 3
    with pytest.raises(ValueError, match="negative"):
        routing.shortest_paths(spark.createDataFrame([(1, 2, -1.0)], "u int, v int, w double"), p)


@pytest.mark.parametrize("seed", range(2))
def test_orientation_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    pairs = {(a, b) for a, b in ((rng.randrange(18), rng.randrange(18)) for _ in range(60)) if a < b} | {(50, 51)}
    left, want = set(pairs), {}
    while left:
        count = defaultdict(int)
        for p in left:
            for x in p:
                count[x] += 1
        best = min(count, key=lambda x: (-count[x], x))
        for p in [p for p in left if best in p]:
            want[p] = best
            left.discard(p)
    got = routing.oriented_pairs(spark.createDataFrame([*pairs, *list(pairs)[:5], (7, 7)], "u int, v int"))
    assert {(r["u"], r["v"]): r["src"] for r in got.collect()} == want
    assert all({r["u"], r["v"]} == {r["src"], r["trg"]} for r in got.collect())
    assert routing.oriented_pairs(spark.createDataFrame([], "u int, v int")).count() == 0


def test_contraction(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 3.0), (4, 5, 1.0), (4, 6, 1.0), (10, 11, 1.0), (11, 12, 1.0), (12, 10, 1.0)], "u long, v long, w double")
    assert values(chains.contracted(e)) == [(1, 4, 6.0, 3), (4, 5, 1.0, 1), (4, 6, 1.0, 1), (10, 10, 3.0, 3)]


def test_chains_keep_the_order_of_edges_and_join_lines(spark):
    rng, rows = random.Random(2), []
    # a long chain, a loop at a junction, a cycle without an end, two parallel edges, a self-link, a short chain
    runs = [list(range(200)), [0, 300, 301, 302, 0], [400, 401, 402, 403, 404, 400], [500, 501], [500, 501], [199, 600, 601], [199, 602], [700, 700], [0, 800]]
    for k, nodes in enumerate(runs):
        for i, (a, b) in enumerate(zip(nodes, nodes[1:], strict=False)):
            a, b = (b, a) if rng.random() < 0.5 else (a, b)
            rows.append((f"{k}.{i:03}", a, b, 1.0, [(float(a), 0.0), (a + b + 0.5, float(k)), (float(b), 0.0)]))
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, "name string, u int, v int, w double, shape array<struct<x: double, y: double>>").repartition(4)
    got = {(r["u"], r["v"], tuple(r["edges"])): r["line"] for r in chains.contracted(e, edge="name", line="shape").collect()}
    long = tuple(f"0.{i:03}" for i in range(199))
    assert (0, 199, long) in got and (199, 601, ("5.000", "5.001")) in got and (700, 700, ("7.000",)) in got
    assert any(k[:2] == (0, 0) and k[2] in (("1.000", "1.001", "1.002", "1.003"), ("1.003", "1.002", "1.001", "1.000")) for k in got)
    # parallel edges are a cycle of two
    assert any(k[:2] == (500, 500) and set(k[2]) == {"3.000", "4.000"} for k in got)
    ring = next(k for k in got if k[0] == 400)
    assert ring[:2] == (400, 400) and ring[2] in (tuple(f"2.00{i}" for i in range(5)), tuple(f"2.00{i}" for i in range(4, -1, -1)))
    line = [p["x"] for p in got[0, 199, long]]
    assert len(line) == 399 and line[0::2] == [float(i) for i in range(200)] and line[1::2] == [2 * i + 1.5 for i in range(199)]
    for (u, v, _), line in got.items():
        assert line[0]["x"] == u and line[-1]["x"] == v


def test_list_ranks(spark):
    links = [(i, i + 1) for i in range(100)] + [(100, None), (200, None), (300, 301), (301, None)]
    got = {r["node"]: (r["last"], r["steps"]) for r in chains.list_ranks(spark.createDataFrame(links, "node int, next int")).collect()}
    assert got == {**{i: (100, 100 - i) for i in range(101)}, 200: (200, 0), 300: (301, 1), 301: (301, 0)}


def test_base_graph(spark):
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    ways = [(1, line((0, 0), (1, 5), (2, 0))), (2, line((2, 0), (4, 0))), (3, line((9, 9), (9, 8))), (4, line((100, 0), (101, 0))), (5, line((2, 0), (100, 0))), (6, line((0, 0))), (7, None), (None, line((0, 0), (1, 1))), (8, line((4, 0), (5, 5), (4, 0)))]
    nodes, edges = chains.base_graph(spark.createDataFrame(ways, "way int, line array<struct<x: double, y: double>>"), [(90.0, -1.0, 120.0, 1.0)])
    at = {(r["x"], r["y"]): (r["island"], r["giant"]) for r in nodes.collect()}
    assert at == {(0, 0): (0, True), (2, 0): (0, True), (4, 0): (0, True), (9, 8): (0, False), (9, 9): (0, False), (100, 0): (1, True), (101, 0): (1, True)}
    assert edges.count() == 6 and edges.where("way = 8").first()["u"] == edges.where("way = 8").first()["v"]
    assert edges.where("way = 2").first()["w"] == 2.0
    assert {r["way"] for r in chains.main_graph(nodes, edges).collect()} == {1, 2, 4, 5, 8}
    stations = spark.createDataFrame([(1, 4.5, 0.0), (2, 9.0, 9.0), (3, 99.0, 1.0)], "stn int, x double, y double")
    xy = {r["node"]: (r["x"], r["y"]) for r in nodes.collect()}
    assert {r["stn"]: xy[r["node"]] for r in graph.snapped_to(stations, nodes, 7.0).collect()} == {1: (4.0, 0.0), 3: (100.0, 0.0)}
