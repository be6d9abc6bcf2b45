"""Shortest ways and the greedy orientation of pairs, by rounds of joins: no graph passes through the driver or one task.

Distances are relaxed in strides: only labels below the current bound are expanded, and the bound rises by a multiple of the
mean weight once none is left.  A source rests as soon as all its wanted targets lie below the bound.  A label is (length,
number of edges, node before, edge), and the least one stays, so ways are the same however the graph is dealt; ties in length
go to fewer edges, then to the smaller node before.  Weights may be zero, not negative.

Ways are put together by pointer jumping: tables of the node 1, 2, 4, ... edges before each one are made by joining each with
itself, and every place of a way finds its node by those of its number's binary digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.plans.staging import discard, staged

#: Mean weights by which the bound rises.
STRIDE = 16
_LABEL = ["d", "h", "p", "e"]


def _arcs(edges: DataFrame) -> DataFrame:
    """(u, v, w, e): the lightest arc of each ordered pair of nodes."""
    e = edges.select("u", "v", F.col("w").cast("double").alias("w"), *([F.col("edge").alias("e")] if "edge" in edges.columns else [F.lit(0).alias("e")])).where("u <> v and w is not null")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "e"))
    return staged(both.groupBy("u", "v").agg(F.min(F.struct("w", "e")).alias("x")).select("u", "v", "x.w", "x.e"), "arcs")


def _labels(arcs: DataFrame, wanted: DataFrame, stride: float) -> DataFrame:
    """(src, node, d, h, p, e): final labels of all wanted targets, and of the nodes on their ways."""
    kinds = {c: arcs.schema[c].dataType for c in ("u", "e")}
    mean, least = arcs.agg(F.avg("w"), F.min("w")).first()
    if least is not None and least < 0:
        raise ValueError("weights must not be negative")
    step = stride * (mean or 1.0)
    own = wanted.select("src").distinct()
    best = staged(own.select("src", F.col("src").alias("node"), F.lit(0.0).alias("d"), F.lit(0).alias("h"), F.lit(None).cast(kinds["u"]).alias("p"), F.lit(None).cast(kinds["e"]).alias("e"), F.lit(True).alias("open")), "labels")
    bound = step
    while True:
        below = F.col("open") & (F.col("d") < bound)
        ready, first = best.agg(F.count_if(below), F.min(F.when(F.col("open"), F.col("d")))).first()
        if not ready:
            if first is None:
                return best.drop("open")
            late = wanted.join(best.select("src", F.col("node").alias("trg"), "d"), ["src", "trg"], "left").where(F.col("d").isNull() | (F.col("d") >= bound)).select("src", F.lit(True).alias("late")).distinct()
            before, best = best, staged(best.join(late, "src", "left").withColumn("open", F.col("open") & F.coalesce("late", F.lit(False))).drop("late"), "labels")
            discard(before)
            bound = first + step
            continue
        label = F.struct(*_LABEL).alias("label")
        held = best.select("src", "node", label, F.lit(True).alias("old"), (F.col("open") & ~below).alias("open"))
        found = best.where(below).select("src", F.col("node").alias("u"), "d", "h").join(arcs, "u")
        found = found.select("src", F.col("v").alias("node"), F.struct((F.col("d") + F.col("w")).alias("d"), (F.col("h") + 1).alias("h"), F.col("u").alias("p"), "e").alias("label"), F.lit(False).alias("old"), F.lit(False).alias("open"))
        both = held.unionByName(found).groupBy("src", "node").agg(F.min("label").alias("label"), F.min(F.when(F.col("old"), F.struct("label.d", "label.h"))).alias("was"), F.max("open").alias("open"))
        shorter = F.col("was").isNull() | (F.struct("label.d", "label.h") < F.col("was"))
        before, best = best, staged(both.select("src", "node", "label.*", (F.col("open") | shorter).alias("open")), "labels")
        discard(before)


def shortest_paths(edges: DataFrame, pairs: DataFrame, stride: float = STRIDE) -> DataFrame:
    """(src, trg, length): undirected shortest lengths of the wanted pairs over `edges` (u, v, w); null where there is no
    way."""
    wanted = staged(pairs.select("src", "trg").distinct(), "wanted")
    best = _labels(_arcs(edges.drop("edge")), wanted, stride)
    return wanted.join(best.select("src", F.col("node").alias("trg"), F.col("d").alias("length")), ["src", "trg"], "left")


def shortest_routes(edges: DataFrame, pairs: DataFrame, stride: float = STRIDE) -> DataFrame:
    """(src, trg, length, edges): undirected shortest ways of the wanted pairs, with the `edge` values of `edges`
    (edge, u, v, w) in order from src; nulls where there is no way, an empty array from a node to itself."""
    wanted = staged(pairs.select("src", "trg").distinct(), "wanted")
    best = _labels(_arcs(edges), wanted, stride)
    ends = wanted.join(best.select("src", F.col("node").alias("trg"), F.col("d").alias("length"), "h"), ["src", "trg"], "left")
    ends = staged(ends, "ends")
    most = ends.agg(F.max("h")).first()[0] or 0
    # a place k edges before the target
    places = ends.where("h > 0").select("src", "trg", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("k"), F.col("trg").alias("node"))
    jump, bit = best.where("p is not null").select("src", "node", "p"), 1
    while bit < most:
        moved = places.join(jump, (places["src"] == jump["src"]) & (places["node"] == jump["node"]) & (F.col("k").bitwiseAND(bit) != 0), "left")
        places = staged(moved.select(places["src"], "trg", "k", F.coalesce("p", places["node"]).alias("node")), "places")
        bit *= 2
        if bit < most:
            jump = staged(jump.join(jump.select("src", F.col("node").alias("p"), F.col("p").alias("q")), ["src", "p"]).select("src", "node", F.col("q").alias("p")), "jumps")
    steps = places.join(best.select("src", "node", "e"), ["src", "node"])
    ways = steps.groupBy("src", "trg").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("i"), "e"))), lambda x: x["e"]).alias("edges"))
    none = F.array().cast(ways.schema["edges"].dataType)
    return ends.join(ways, ["src", "trg"], "left").select("src", "trg", "length", F.when(F.col("length").isNotNull(), F.coalesce("edges", none)).alias("edges"))


#: Nodes whose pairs among each other the driver looks at in a round.
FRONT = 512


def _front(ends: DataFrame, left: DataFrame) -> list:
    """The nodes that the sequential rule serves next, in order, as far as the first `FRONT` nodes tell.

    `ends` has node and n, less the number of its pairs.  Nodes behind the front only lose pairs, so the first of the front
    is the first of all as long as it comes before the one that was first behind the front.
    """
    top = [(r["n"], r["node"]) for r in ends.orderBy("n", "node").limit(FRONT + 1).collect()]
    behind = top[FRONT] if len(top) > FRONT else None
    n = {node: k for k, node in top[:FRONT]}
    some = left.sparkSession.createDataFrame([(node,) for node in n], ends.select("node").schema)
    some = F.broadcast(some)  # FRONT rows
    beside: dict = {node: [] for node in n}
    for r in left.join(some.withColumnRenamed("node", "u"), "u", "left_semi").join(some.withColumnRenamed("node", "v"), "v", "left_semi").collect():
        beside[r["u"]].append(r["v"])
        beside[r["v"]].append(r["u"])
    served = []
    while n:
        k, node = min((k, node) for node, k in n.items())
        if k >= 0 or (behind is not None and (k, node) > behind):
            break
        served.append(node)
        del n[node]
        for other in beside[node]:
            if other in n:
                n[other] += 1
    return served


def oriented_pairs(pairs: DataFrame) -> DataFrame:
    """(u, v, src, trg): undirected pairs with one end as the source, so that few nodes are sources.

    The node with most pairs that have no source yet takes them all, the smallest of equals first, until none is left.  A
    round serves the nodes that come first of all, one after the other, as found among a front of bounded size; then those
    that come before all their neighbours: a node's number of pairs only falls, so such a node takes its pairs before any
    neighbour can.  Both have the result of the sequential rule.
    """
    left, done = staged(pairs.select("u", "v").where("u <> v").distinct(), "pairs"), None
    count = lambda df: df.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg((-F.count("*")).alias("n"))

    def turned(left: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs taken by the nodes of `first` (node, i), the smaller i first, and the others."""
        a, b = first.select(F.col("node").alias("u"), F.col("i").alias("iu")), first.select(F.col("node").alias("v"), F.col("i").alias("iv"))
        t = staged(left.join(a, "u", "left").join(b, "v", "left"), "turned")
        own = F.col("iv").isNull() | (F.col("iu") < F.col("iv"))
        source = F.coalesce(own & F.col("iu").isNotNull(), F.lit(False))
        taken = t.where("iu is not null or iv is not null").select("u", "v", F.when(source, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(source, F.col("v")).otherwise(F.col("u")).alias("trg"))
        return taken, t.where("iu is null and iv is null").select("u", "v")

    while not left.isEmpty():
        ends = staged(count(left), "ends")
        served = _front(ends, left)
        order = left.sparkSession.createDataFrame(list(zip(served, range(len(served)), strict=True)), f"node {ends.schema['node'].dataType.simpleString()}, i int")
        taken, left = turned(left, F.broadcast(order))
        done = taken if done is None else done.unionByName(taken)
        ends = count(left)
        rank = lambda side: ends.select(F.col("node").alias(side), F.struct("n", "node").alias(f"k{side}"))  # noqa: B023, E731
        ranked = staged(left.join(rank("u"), "u").join(rank("v"), "v"), "ranked")
        sides = ranked.select("ku", "kv").unionByName(ranked.select(F.col("kv").alias("ku"), F.col("ku").alias("kv")))
        first = sides.groupBy("ku").agg(F.min("kv").alias("kv")).where("ku < kv").select(F.col("ku.node").alias("node"), F.lit(0).alias("i"))
        taken, left = turned(ranked.select("u", "v"), first)
        done = done.unionByName(taken)
        discard(ranked)
    return done if done is not None else left.select("u", "v", F.col("u").alias("src"), F.col("v").alias("trg"))


def oriented_routes(edges: DataFrame, pairs: DataFrame, stride: float = STRIDE) -> DataFrame:
    """(u, v, length, edges) of undirected pairs, searched from few sources; edges run from the smaller end of each."""
    turned = oriented_pairs(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    r = shortest_routes(edges, turned.select("src", "trg"), stride)
    return r.select(F.least("src", "trg").alias("u"), F.greatest("src", "trg").alias("v"), "length", F.when(F.col("src") < F.col("trg"), F.col("edges")).otherwise(F.reverse("edges")).alias("edges"))
