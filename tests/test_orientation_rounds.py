"""Pairs are oriented in few rounds, with the result of the sequential rule."""

import random
from collections import Counter

import pytest

from transitloom.operators import routing


@pytest.mark.parametrize("front", [5, 512])
def test_dense_pairs(spark, monkeypatch, front):
    monkeypatch.setattr(routing, "FRONT", front)
    rng, calls, real = random.Random(3), [], routing.staged
    monkeypatch.setattr(routing, "staged", lambda df, name="table": calls.append(name) or real(df, name))
    pairs = {(a, b) for a in range(14) for b in range(a)} | {tuple(sorted(rng.sample(range(30), 2), reverse=True)) for _ in range(40)}
    got = {(r["u"], r["v"]): r["src"] for r in routing.oriented_pairs(spark.createDataFrame(sorted(pairs), "u int, v int")).collect()}
    left, want = set(pairs), {}
    while left:
        n = Counter(x for p in left for x in p)
        x = min(n, key=lambda k: (-n[k], k))
        want |= {p: x for p in left if x in p}
        left = {p for p in left if x not in p}
    assert got == want
    if front == 512:
        assert len(calls) < 10
