"""Connected components of an edge DataFrame.

Edges are dealt to as many partitions as their number needs.  Each partition replaces its edges by stars of its own
components (union-find), which keeps connectivity; then a large and a small star step, in the manner of alternating
stars, moves the stars' centres together across partitions.  Rounds repeat until nothing changes; edges that fit one
partition are finished by the first.  Memory is bounded by the edges of a partition, and nothing is collected but a
few numbers a round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.plans.staging import discard, staged

#: Edges that one task holds at a time.
PART_EDGES = 500_000


def _stars(edges: DataFrame, part_edges: int) -> DataFrame:
    """Edges (u, v), u > v, replaced by (node, smallest node) of each component of the edges that a task holds."""
    kind = edges.schema["u"].dataType

    def forest(held: dict):
        def top(x):
            while held[x] != x:
                held[x] = held[held[x]]
                x = held[x]
            return x

        return [(x, r) for x in held if (r := top(x)) != x]

    def run(batches):
        parent: dict = {}

        def top(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def flush():
            rows = forest(parent)
            for i in range(0, len(rows), 50_000):
                u, v = zip(*rows[i : i + 50_000], strict=True)
                yield pa.record_batch([pa.array(u, kinds), pa.array(v, kinds)], names=["u", "v"])

        kinds, seen = None, 0
        for batch in batches:
            kinds = batch.schema.field("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    if b < a:
                        a, b = b, a
                    parent[b] = a
            seen += batch.num_rows
            if seen >= 2 * part_edges:
                yield from flush()
                parent.clear()
                seen = 0
        if parent:
            yield from flush()

    return edges.mapInArrow(run, f"u {kind.simpleString()}, v {kind.simpleString()}")


def _fingerprint(edges: DataFrame):
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(h % 1_000_003), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())


def components(edges: DataFrame, rounds: int = 60, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, root) of every node in `edges` (u, v, of one orderable type): root is the smallest of its component.

    Null ends and self-links are dropped, so nodes that have no other edge do not appear; repeated edges are harmless.
    """
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v")
    e, was = staged(oriented, "edges"), None
    for _ in range(rounds):
        parts = max(1, -(-e.count() // part_edges))
        before = e
        e = staged(_stars(e.coalesce(parts), part_edges), "stars")
        discard(before)
        if parts == 1 and was is None:
            break
        stars = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        discard(stars)
        now = _fingerprint(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
