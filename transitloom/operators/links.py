"""Composition of matrices and assembly of links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitloom.operators.rows import surrogate_key


def compose_via(matrix: DataFrame, bridges: DataFrame, costs: Sequence[str], rounds: int = 1) -> DataFrame:
    """The cheapest way of each (src, trg) directly or over bridges (a, b), by the first of `costs`.

    Each round allows one bridge more.  All costs add along a way, so they must have the units of the matrix.
    """
    first = costs[0]

    def best(df: DataFrame) -> DataFrame:
        return df.groupBy("src", "trg").agg(F.min(F.struct(*[F.col(c) for c in costs])).alias("m")).select("src", "trg", "m.*")

    base = best(matrix.select("src", "trg", *costs).where(F.col(first).isNotNull()))
    ways = base
    legs = bridges.select("a", "b", *[F.col(c).alias(f"_bridge_{c}") for c in costs])
    right = base.select(F.col("src").alias("b"), F.col("trg").alias("_trg"), *[F.col(c).alias(f"_right_{c}") for c in costs])
    for _ in range(rounds):
        over = ways.join(legs, ways["trg"] == legs["a"]).drop("trg").join(right, "b")
        sums = over.select("src", F.col("_trg").alias("trg"), *[(F.col(c) + F.col(f"_bridge_{c}") + F.col(f"_right_{c}")).alias(c) for c in costs])
        ways = best(base.unionByName(sums))
    return ways


def in_metres_and_seconds(bridges: DataFrame, km: str, minutes: str) -> DataFrame:
    """Bridge constants in the units of a routing matrix."""
    return bridges.withColumn(km, F.col(km) * 1000.0).withColumn(minutes, F.col(minutes) * 60.0)


def redirected(links: DataFrame, moved: DataFrame) -> DataFrame:
    """Links whose ends are replaced by `moved` (node, target); links that then lead to their source are dropped."""
    for end in ("src", "trg"):
        m = moved.select(F.col("node").alias("_node"), F.col("target").alias("_target"))
        links = links.join(m, links[end] == m["_node"], "left").withColumn(end, F.coalesce("_target", end)).drop("_node", "_target")
    return links.where("src <> trg")


def violations(nodes: DataFrame, links: DataFrame, key: str = "node_id") -> DataFrame:
    """(check, violations): rows that break each rule of a finished graph."""
    known = nodes.select(F.col(key).alias("_known")).distinct()
    repeated = nodes.groupBy(key).count().where("count > 1")
    count = lambda df, name: df.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
    parts = [
        count(nodes.where(F.col(key).isNull()), "node_id_null"),
        count(repeated, "node_id_repeated"),
        count(nodes.where("lon is null or lat is null or not (lon between -180 and 180) or not (lat between -90 and 90)"), "coordinates"),
        count(links.where("src is null or trg is null"), "endpoint_null"),
        count(links.join(known, links["src"] == known["_known"], "left_anti"), "src_unknown"),
        count(links.join(known, links["trg"] == known["_known"], "left_anti"), "trg_unknown"),
        count(links.where("time is null or isnan(time) or time <= 0 or time = double('infinity')"), "time"),
        count(links.where("mode <> 'Car' and (operator is null or freq is null)"), "operator_or_freq_null"),
        count(links.where("freq <= 0"), "freq"),
        count(links.where("src = trg"), "self_link"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matrix_blocks(sources: DataFrame, targets: DataFrame, key: str, size: int) -> DataFrame:
    """(bi, bj, src, trg): the cross product of the distinct keys of two frames in blocks of up to `size` times `size`, each
    with its keys as two sorted arrays; the cells of a block lie row by row."""

    def numbered(df: DataFrame, block: str, name: str) -> DataFrame:
        ids = surrogate_key(df.select(key).where(F.col(key).isNotNull()).distinct(), "_n", [key])
        return ids.groupBy(F.floor(F.col("_n") / size).alias(block)).agg(F.array_sort(F.collect_list(key)).alias(name))

    rows_, columns = numbered(sources, "bi", "src"), numbered(targets, "bj", "trg")
    last = columns.agg(F.coalesce(F.max("bj"), F.lit(-1)).alias("_last"))
    spread = rows_.withColumn("_last", last.scalar()).where("_last >= 0").withColumn("bj", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last")
    return spread.join(columns, "bj").select("bi", "bj", "src", "trg")


def filled_blocks(blocks: DataFrame, matrix: DataFrame, values: Sequence[str]) -> DataFrame:
    """`blocks` with a nested array (rows of cells) for each of `values`, looked up in `matrix` (src, trg, values); cells
    that the matrix lacks are null."""
    cells = blocks.select("bi", "bj", F.posexplode("src").alias("_i", "src"), "trg").select("bi", "bj", "_i", "src", F.posexplode("trg").alias("_j", "trg"))
    found = cells.join(matrix.select("src", "trg", *values), ["src", "trg"], "left")
    line = found.groupBy("bi", "bj", "_i").agg(F.array_sort(F.collect_list(F.struct("_j", *values))).alias("_row"))
    nested = line.groupBy("bi", "bj").agg(F.array_sort(F.collect_list(F.struct("_i", "_row"))).alias("_rows"))
    return blocks.join(nested.select("bi", "bj", *[F.transform("_rows", lambda r: F.transform(r["_row"], lambda c: c[v])).alias(v) for v in values]), ["bi", "bj"])  # noqa: B023


def unfolded(blocks: DataFrame, values: Sequence[str]) -> DataFrame:
    """(src, trg, values): the cells of blocks (src, trg, and a nested array for each of `values`) by their places, row by
    row.  A block whose nested arrays haven't the shape of its keys is an error."""
    shape = F.lit(True)
    for v in values:
        shape = shape & (F.size(v) == F.size("src")) & F.forall(v, lambda r: F.size(r) == F.size("trg"))
    checked = blocks.withColumn("_ok", F.when(shape, True).otherwise(F.raise_error(F.lit("a block's cells do not fit its keys")).cast("boolean"))).where("_ok")
    flat = checked.select("src", "trg", *[F.flatten(v).alias(v) for v in values])
    cells = flat.select("src", "trg", F.posexplode(F.arrays_zip(*values)).alias("_k", "_c"))
    wide = F.size("trg")
    return cells.select(F.get("src", F.floor(F.col("_k") / wide).cast("int")).alias("src"), F.get("trg", F.col("_k") % wide).alias("trg"), *[F.col(f"_c.{v}").alias(v) for v in values])


def unusable_cells(blocks: DataFrame, value: str) -> DataFrame:
    """(bi, bj, n): blocks with cells that are null, NaN or infinite, and their number."""
    bad = F.filter(F.flatten(F.col(value)), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return blocks.select("bi", "bj", F.size(bad).alias("n")).where("n > 0")
