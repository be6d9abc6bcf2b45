"""Graph operators: statistics, reachability, components and redundant nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.operators import spatial
from transitloom.operators.rows import surrogate_key
from transitloom.plans.components import components
from transitloom.plans.staging import discard, staged

#: Rank of stations that stay, behind all others.
_KEPT = (1 << 63) - 1


def weak_components(nodes: DataFrame, links: DataFrame, key: str = "node_id") -> DataFrame:
    """(node, component) of all nodes, isolated ones as components of their own."""
    roots = components(links.select(F.col("src").alias("u"), F.col("trg").alias("v")))
    n = nodes.select(F.col(key).alias("node"))
    return n.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def reachable(links: DataFrame, start: DataFrame, rounds: int = 1000) -> DataFrame:
    """Nodes that directed links lead to from those of `start` (node), which are included."""
    known = staged(start.select("node").distinct(), "reached")
    frontier = known
    for _ in range(rounds):
        found = frontier.join(links.select(F.col("src").alias("node"), "trg"), "node").select(F.col("trg").alias("node")).distinct().join(known, "node", "left_anti")
        frontier = staged(found, "frontier")
        if frontier.isEmpty():
            return known
        known = staged(known.unionByName(frontier), "reached")
    raise RuntimeError("reachability did not settle")


def strong_components(nodes: DataFrame, links: DataFrame, key: str = "node_id") -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node.

    Rounds of colouring: the smallest node that reaches each remaining node is its colour; the nodes that can go back
    to their colour within it form a component.
    """
    left = staged(nodes.select(F.col(key).alias("node")).distinct(), "left")
    e = links.select("src", "trg").where("src <> trg").distinct()
    out = None
    while not left.isEmpty():
        inner = staged(e.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "trg"), "trg", "left_semi").select("src", "trg"), "inner")
        colour = staged(left.withColumn("c", F.col("node")), "colour")
        while True:
            reach = inner.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("trg").alias("node")).agg(F.min("c").alias("m"))
            new = staged(colour.join(reach, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce(F.col("m"), F.col("c")) < F.col("c")).alias("moved")), "colour")
            moved = not new.where("moved").isEmpty()
            colour = new.drop("moved")
            if not moved:
                break
        back = staged(colour.where("node = c"), "back")
        same = inner.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("trg"), F.col("c").alias("ct")), "trg").where("cs = ct")
        same = staged(same.select("src", "trg", F.col("cs").alias("c")), "same")
        while True:
            more = same.join(back.select(F.col("node").alias("trg")), "trg").select(F.col("src").alias("node"), "c").distinct().join(back, ["node", "c"], "left_anti")
            more = staged(more, "more")
            if more.isEmpty():
                break
            back = staged(back.unionByName(more), "back")
        found = back.select("node", F.col("c").alias("component"))
        out = found if out is None else out.unionByName(found)
        left = staged(left.join(back.select("node"), "node", "left_anti"), "left")
    return out if out is not None else nodes.select(F.col(key).alias("node"), F.col(key).alias("component"))


def statistics(nodes: DataFrame, links: DataFrame, key: str = "node_id") -> DataFrame:
    """One row: n_nodes, n_links, n_weak, n_isolated, n_self, density of distinct links, mean in- and out-degree."""
    n = nodes.select(F.count("*").alias("n_nodes"))
    ends = links.select(F.explode(F.array("src", "trg")).alias("node")).distinct()
    isolated = nodes.select(F.col(key).alias("node")).join(ends, "node", "left_anti").agg(F.count("*").alias("n_isolated"))
    weak = weak_components(nodes, links, key).agg(F.countDistinct("component").alias("n_weak"))
    simple = links.where("src <> trg").select("src", "trg").distinct().agg(F.count("*").alias("n_simple"))
    every = links.agg(F.count("*").alias("n_links"), F.count_if(F.col("src") == F.col("trg")).alias("n_self"))
    row = n.crossJoin(every).crossJoin(weak).crossJoin(isolated).crossJoin(simple)  # one row each
    nn = F.col("n_nodes")
    return row.select("n_nodes", "n_links", "n_weak", "n_isolated", "n_self", (F.col("n_simple") / (nn * (nn - 1))).alias("density"), (F.col("n_links") / nn).alias("mean_in_degree"), (F.col("n_links") / nn).alias("mean_out_degree"))


def giant_components(edges: DataFrame, island: str) -> DataFrame:
    """(island, node): nodes of the largest component of each island; ties go to the smallest component."""
    from pyspark.sql import Window

    ends = edges.select(island, F.explode(F.array("u", "v")).alias("node")).distinct()
    labelled = ends.join(components(edges.select("u", "v")), "node")
    size = labelled.groupBy(island, "root").agg(F.count("*").alias("n"))
    w = Window.partitionBy(island).orderBy(F.desc("n"), "root")
    best = size.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(island, "root")
    return labelled.join(best, [island, "root"]).select(island, "node")


def snapped_to(stations: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """(stn, node, dist): the nearest node within `radius` of each station (stn, x, y), among the `giant` ones of nodes
    (node, x, y, giant); ties go to the smallest node."""
    giant = nodes.where("giant").select("node", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial.nearest(stations.select("stn", "x", "y"), giant, radius, ["stn"], "node").select("stn", "node", "dist")


def snapped_stations(stations: DataFrame, edges: DataFrame, nodes: DataFrame, island: str, radius: float) -> DataFrame:
    """As `snapped_to`, among the largest components of the islands of `edges` (u, v, `island`); nodes are (node, x, y)."""
    giant = giant_components(edges, island).select("node").distinct().withColumn("giant", F.lit(True))
    return snapped_to(stations, nodes.select("node", "x", "y").join(giant, "node"), radius)


def redundant_stations(support: DataFrame, served: DataFrame) -> DataFrame:
    """(stn): stations that can go without any relation losing its last pair of stations, found greedily.

    `support` (stn, partner, od) holds, both ways, the pairs of stations that serve a relation; `served` (stn, n) all
    stations with the number of relations of the lines through them.  Stations are visited by (n, stn); one goes if each
    relation keeps a pair without it, so stations that support none go.

    Rounds decide all stations whose fate no longer depends on those before them.  Let r be a relation of a station.  A
    station stays if all of r's remaining pairs are its own, as pairs only become fewer.  It goes if each of its relations
    has a pair of two stations that are visited later or stay for certain: such a pair is there when its turn comes.  The
    first undecided station always meets one of the two.
    """
    ranks = surrogate_key(served.select("stn", "n").distinct(), "rank", ["n", "stn"])
    rank = lambda side, name: ranks.select(F.col("stn").alias(side), F.col("rank").cast("long").alias(name))
    pairs = support.where("stn <> partner").select("stn", "partner", "od").distinct().join(rank("stn", "r"), "stn").join(rank("partner", "q"), "partner")
    pairs = staged(pairs.select("stn", "partner", "od", "r", "q"), "support")
    kept_stations = None
    while True:
        one = pairs.where("r < q or (r = q and stn < partner)")  # two that stay have equal ranks
        whole = one.groupBy("od").agg(F.count("*").alias("n"), F.max("r").alias("safe"))
        own = pairs.where(F.col("r") < _KEPT).groupBy("stn", "r", "od").agg(F.count("*").alias("own")).join(whole, "od")
        fate = own.groupBy("stn").agg(F.max(F.col("own") == F.col("n")).alias("stays"), F.min(F.col("safe") > F.col("r")).alias("goes")).where("stays or goes")
        fate = staged(fate, "fate")
        if fate.isEmpty():
            # nobody needs whoever is undecided now: all its pairs have gone with their other stations
            stations = served.select("stn").distinct()
            return stations if kept_stations is None else stations.join(kept_stations, "stn", "left_anti")
        stay = fate.where("stays").select("stn")
        kept_stations = stay if kept_stations is None else kept_stations.unionByName(stay)
        side = lambda name: fate.select(F.col("stn").alias(name), F.col("stays").alias(f"_{name}"))  # noqa: B023, E731
        left = pairs.join(side("stn"), "stn", "left").join(side("partner"), "partner", "left").where("coalesce(_stn, true) and coalesce(_partner, true)")
        kept = lambda flag, r: F.when(F.col(flag), F.lit(_KEPT)).otherwise(F.col(r)).alias(r)
        before, pairs = pairs, staged(left.select("stn", "partner", "od", kept("_stn", "r"), kept("_partner", "q")), "support")
        discard(before)
