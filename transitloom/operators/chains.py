"""Infrastructure graphs: from lines to junctions and edges, and chains of edges as single ones, in order.

The order of a chain's edges comes from list ranking: every edge is an arc in each direction, every arc knows the one that
follows it through a node of degree two, and pointer doubling gives all arcs their distance to the end in as many joins as the
longest chain's length has binary digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitloom.functions.geo import line_length
from transitloom.operators.rows import surrogate_key
from transitloom.plans.components import components
from transitloom.plans.staging import discard, staged


def joined_lines(lines: Column) -> Column:
    """An array of lines, each an array of points, as one line; points that repeat the one before are dropped."""
    flat = F.flatten(lines)
    return F.filter(F.transform(flat, lambda p, i: F.struct(p.alias("p"), ((i == 0) | (p != F.get(flat, i - 1))).alias("new"))), lambda x: x["new"])["p"]


def base_graph(ways: DataFrame, islands: Sequence[tuple[float, float, float, float]] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y, island, giant) and edges (way, u, v, w, line) of `ways` (way, line), lines of struct<x, y>.

    Nodes are the distinct first and last points; `island` is the number of the last box (x0, y0, x1, y1) that holds the
    node, counted from 1, else 0; `giant` nodes are those of their island's largest component, which only edges within
    the island join; ties go to the one with the smallest node.  `w` is the line's length.  Ways of fewer than two points
    are left out; of several with one number the last in order of their lines stays.
    """
    from transitloom.operators.graph import giant_components

    w = ways.where("way is not null and size(line) > 1").groupBy("way").agg(F.max("line").alias("line"))
    w = staged(w.select("way", "line", F.element_at("line", 1).alias("a"), F.element_at("line", -1).alias("b")), "ways")
    island = F.lit(0)
    for k, (x0, y0, x1, y1) in enumerate(islands):
        island = F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), k + 1).otherwise(island)
    points = w.select(F.explode(F.array("a", "b")).alias("p")).select("p.x", "p.y").distinct()
    nodes = staged(surrogate_key(points, "node", ["x", "y"]).withColumn("island", island), "nodes")
    end = lambda side, name: nodes.select(F.struct("x", "y").alias(side), F.col("node").alias(name), F.col("island").alias(f"i{name}"))
    edges = staged(w.join(end("a", "u"), "a").join(end("b", "v"), "b").select("way", "u", "v", line_length(F.col("line")).alias("w"), "line", "iu", "iv"), "edges")
    discard(w)
    giant = giant_components(edges.where("iu = iv").select("u", "v", F.col("iu").alias("island")), "island").select("node", F.lit(True).alias("giant"))
    return nodes.join(giant, "node", "left").withColumn("giant", F.coalesce("giant", F.lit(False))), edges.drop("iu", "iv")


def main_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose ends are both `giant`."""
    g = nodes.where("giant").select("node")
    return edges.join(g.withColumnRenamed("node", "u"), "u", "left_semi").join(g.withColumnRenamed("node", "v"), "v", "left_semi").select(*edges.columns)


def list_ranks(links: DataFrame) -> DataFrame:
    """(node, last, steps) of lists given as (node, next), next null at the end: the last node and the links to it.

    Nodes on a cycle have no end; they must not occur.
    """
    at = staged(links.select("node", F.coalesce("next", "node").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps")), "list")
    while True:
        far = at.select(F.col("node").alias("last"), F.col("last").alias("_last"), F.col("steps").alias("_steps"))
        new = staged(at.join(far, "last", "left").select("node", F.coalesce("_last", "last").alias("last"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), (F.col("_steps") > 0).alias("moved")), "list")
        discard(at)
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            return at


def contracted(edges: DataFrame, keep: DataFrame | None = None, edge: str | None = None, line: str | None = None) -> DataFrame:
    """(u, v, w, n_edges) and, where the columns are named, `edges` and `line`: chains through nodes of degree two as single
    edges, with their edges' values and their lines in order from u to v.

    A chain's ends are the nodes of other degrees or of `keep` (node); u is the smaller.  Cycles without any end keep their
    smallest node as both ends.  A line runs from u to v of its edge.
    """
    extra = [c for c in (edge, line) if c]
    e = staged(edges.select("u", "v", "w", *extra, F.monotonically_increasing_id().alias("_id")), "edges")
    incident = e.select("_id", F.explode(F.array("u", "v")).alias("node"))
    degree = incident.groupBy("node").agg(F.count("*").alias("d"), F.min("_id").alias("first"), F.max("_id").alias("last"))
    inner = degree.where("d = 2 and first <> last")
    if keep is not None:
        inner = inner.join(keep, "node", "left_anti")
    inner = staged(inner.select("node", "first", "last"), "inner")
    roots = components(inner.select(F.col("first").alias("u"), F.col("last").alias("v")))
    chain = staged(e.select("_id", "u", "v").join(roots, F.col("_id") == F.col("node"), "left").select("_id", "u", "v", F.coalesce("root", "_id").alias("chain")), "chains")
    tips = chain.select("chain", F.explode(F.array("u", "v")).alias("node")).join(inner.select("node"), "node", "left_anti").select("chain").distinct()
    breaks = chain.join(tips, "chain", "left_anti").groupBy("chain").agg(F.min(F.least("u", "v")).alias("node"))
    inner = inner.join(breaks.select("node"), "node", "left_anti")
    # an arc is (edge, tail)
    tail, head = chain.select("_id", "chain", F.col("u").alias("a"), F.col("v").alias("b")), chain.where("u <> v").select("_id", "chain", F.col("v").alias("a"), F.col("u").alias("b"))
    arcs = tail.unionByName(head)
    follows = arcs.join(inner.select(F.col("node").alias("b"), "first", "last"), "b", "left")
    other = F.when(F.col("_id") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    name = lambda edge_, tail_: F.struct(edge_.alias("id"), tail_.alias("a"))
    follows = staged(follows.select("chain", "b", name(F.col("_id"), F.col("a")).alias("node"), F.when(F.col("first").isNotNull(), name(other, F.col("b"))).alias("next")), "arcs")
    ranked = follows.select("chain", "b", "node").join(list_ranks(follows), "node")
    heads = follows.where("next is null").select(F.col("node").alias("last"), F.col("b").alias("end"))
    ranked = staged(ranked.join(heads, "last").select("chain", "node", "b", "steps", F.struct("end", "last").alias("way")), "ranked")
    # of a chain's two directions the one that ends at the larger node
    ranked = ranked.join(ranked.groupBy("chain").agg(F.max("way").alias("way")), ["chain", "way"]).select("chain", "node.id", "node.a", "b", "steps", F.col("way.end").alias("end"))
    full = ranked.join(e.select(F.col("_id").alias("id"), F.col("u").alias("_u"), "w", *extra), "id")
    part = [F.col(edge).alias("edge")] if edge else []
    if line:
        part.append(F.when(F.col("a") == F.col("_u"), F.col(line)).otherwise(F.reverse(line)).alias("line"))
    g = full.groupBy("chain").agg(F.max(F.struct("steps", "a"))["a"].alias("u"), F.first("end").alias("v"), F.sum("w").alias("w"), F.count("*").alias("n_edges"), F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("i"), *part))).alias("parts"))
    out = [F.col("parts.edge").alias("edges")] if edge else []
    if line:
        out.append(joined_lines(F.col("parts.line")).alias("line"))
    return g.select("u", "v", "w", "n_edges", *out)
