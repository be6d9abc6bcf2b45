"""Queries against plain Python over all rows of the tables."""

from collections import Counter, defaultdict

from transitloom.plans import catalogue


def test_greedy_station_prune_is_the_plain_loop(spark, sf_dir):
    at = defaultdict(set)
    for stn, partner, od in catalogue.QUERIES["od_support"](spark, sf_dir).select("stn", "partner", "od").collect():
        at[stn].add((partner, od))
    left = {r["stn"]: r["n"] for r in catalogue.QUERIES["served_relations"](spark, sf_dir).collect()}
    support, gone = Counter(od for stn in left for partner, od in at[stn] if stn < partner), set()
    for stn in sorted(left, key=lambda x: (left[x], x)):
        own = Counter(od for partner, od in at[stn] if partner not in gone)
        if all(support[od] > n for od, n in own.items()):
            gone.add(stn)
            support.subtract(own)
    got = {r["stn"] for r in catalogue.QUERIES["greedy_station_prune"](spark, sf_dir).collect()}
    assert got == gone and gone
