"""Spatial joins on projected points by grid cells: the join key is a cell, so plans are equi-joins.

Cells have the size of the radius; the right side is entered in its own cell and the eight around it, so that any two
points within the radius meet once.  Cells of dense areas are as large as the radius needs; skewed cells are left to
adaptive execution, which splits them.

Polygons are covered by cells.  A cell that no edge touches is wholly inside or outside; one on the boundary carries the edges
that touch it and whether its lower left corner is inside.  So a point meets one row for each polygon near it and is decided
within that row, whatever the size of the polygon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitloom.functions.geo import planar
from transitloom.operators.rows import finite, union_all
from transitloom.plans.staging import staged


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def within_distance(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry", distance: str = "dist") -> DataFrame:
    """All pairs of rows not further apart than `radius`, with their distance; column names must not clash.

    Points with a null, NaN or infinite coordinate match nothing.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.where(finite(F.col(lx), F.col(ly))).withColumn("_cx", _cell(F.col(lx), radius)).withColumn("_cy", _cell(F.col(ly), radius))
    b = right.where(finite(F.col(rx), F.col(ry))).withColumn("_o", around).withColumn("_cx", _cell(F.col(rx), radius) + F.col("_o.i")).withColumn("_cy", _cell(F.col(ry), radius) + F.col("_o.j")).drop("_o")
    joined = a.join(b, ["_cx", "_cy"]).withColumn(distance, planar(F.col(lx), F.col(ly), F.col(rx), F.col(ry)))
    return joined.where(F.col(distance) <= radius).drop("_cx", "_cy")


#: Lists for `greatest_within` are cut into blocks of so many points at most.
BLOCK = 1024


def greatest_within(left: DataFrame, right: DataFrame, radius: float, key: str, value: str, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """(key, value): for each `key` of `left` the greatest `value` of `right` within `radius`; keys with none are left out.

    Each cell lists the points of itself and the eight around it by descending value, so the first one near enough is the
    answer, and a row of a crowd meets few points instead of all.  Lists are searched level by level, each level eight times
    as long as the one before, by the rows that have found nothing yet.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    # rows at one place count once
    spots = right.where(finite(F.col(rx), F.col(ry))).groupBy(F.col(rx).cast("double").alias("rx"), F.col(ry).cast("double").alias("ry")).agg(F.max(value).alias("_v")).withColumn("_o", around)
    spots = spots.select("rx", "ry", "_v", (_cell(F.col("rx"), radius) + F.col("_o.i")).alias("_cx"), (_cell(F.col("ry"), radius) + F.col("_o.j")).alias("_cy"))
    ranked = spots.withColumn("_n", F.row_number().over(Window.partitionBy("_cx", "_cy").orderBy(F.desc_nulls_last("_v"), "rx", "ry")))
    level = (F.floor(F.log(F.col("_n") + 7.0) / F.log(F.lit(8.0))) - 1).cast("int")  # the first 56 points, then 448, and so on
    members = F.array_sort(F.collect_list(F.struct("_n", "_v", "rx", "ry"))).alias("_members")
    lists = staged(ranked.groupBy("_cx", "_cy", level.alias("_level"), F.floor(F.col("_n") / BLOCK).alias("_block")).agg(members), "lists")
    open_ = left.where(finite(F.col(lx), F.col(ly))).select(F.monotonically_increasing_id().alias("_id"), F.col(key), F.col(lx).alias("_x"), F.col(ly).alias("_y"), _cell(F.col(lx), radius).alias("_cx"), _cell(F.col(ly), radius).alias("_cy"))
    open_ = staged(open_, "searching")
    hit = F.get(F.filter("_members", lambda m: planar(F.col("_x"), F.col("_y"), m["rx"], m["ry"]) <= radius), F.lit(0))
    found = []
    for k in range((lists.agg(F.max("_level")).first()[0] or 0) + 1):
        met = open_.join(lists.where(F.col("_level") == k), ["_cx", "_cy"]).withColumn("_hit", hit).where("_hit is not null")
        found.append(staged(met.groupBy("_id", key).agg(F.min("_hit").alias("_hit")), "found"))
        left_over = open_.join(found[-1].select("_id"), "_id", "left_anti")
        open_ = staged(left_over.join(lists.where(F.col("_level") == k + 1).select("_cx", "_cy").distinct(), ["_cx", "_cy"], "left_semi"), "searching")
        if open_.isEmpty():
            break
    return union_all(*found).groupBy(key).agg(F.max("_hit._v").alias(value))


#: The search for the nearest begins in cells of so many points at most, in steps of STEP times the side, DEPTH steps deep.
CROWD, STEP, DEPTH = 64, 4.0, 8


def _first_step(spots: DataFrame, radius: float, within: Sequence[str]) -> int:
    """The coarsest step whose cells hold `CROWD` of the points (rx, ry) or fewer; `DEPTH` if none does."""
    side = F.lit(float(radius)) / F.pow(F.lit(STEP), F.col("_step"))
    cells = spots.select(*within, "rx", "ry", F.explode(F.sequence(F.lit(0), F.lit(DEPTH - 1))).alias("_step"))
    n = cells.groupBy("_step", F.floor(F.col("rx") / side).alias("_cx"), F.floor(F.col("ry") / side).alias("_cy"), *within).agg(F.count("*").alias("n"))
    return min((r["_step"] for r in n.groupBy("_step").agg(F.max("n").alias("n")).where(F.col("n") <= CROWD).collect()), default=0 if spots.isEmpty() else DEPTH)


def _nearest(left: DataFrame, right: DataFrame, radius: float, keys: Sequence[str], tie: str, lx: str, ly: str, rx: str, ry: str, distance: str, group: str | None = None, unequal: tuple[str, str] | None = None) -> DataFrame:
    """The work of `nearest` and `nearest_in_group`.

    Rows of the right side at one place count once: only the first of them by `tie` can be the nearest, or the second where
    the first is the row's own.  Rows search in small cells first; those that find nothing there search in larger ones, up
    to `radius`.  So a row meets few others, however dense they lie.
    """
    within = [] if group is None else ["_group"]
    other = right.where(finite(F.col(rx), F.col(ry)))
    other = other if group is None else other.where("_group is not null")
    # F.struct compares by its fields in order, so the tie decides
    row = F.struct(F.col(tie).alias("t"), *([F.col(unequal[1]).alias("o")] if unequal else []), F.struct(*right.columns).alias("r"))
    place = [F.col(rx).cast("double").alias("rx"), F.col(ry).cast("double").alias("ry"), *within]
    spots = other.select(*place, row.alias("_row")).groupBy("rx", "ry", *within).agg(F.min("_row").alias("_row"))
    if unequal:
        own = other.select(*place, row.alias("_second")).join(spots, ["rx", "ry", *within])
        spots = own.groupBy("rx", "ry", *within).agg(F.first("_row").alias("_row"), F.min(F.when(F.col("_second.o") != F.col("_row.o"), F.col("_second"))).alias("_second"))
    spots = staged(spots, "spots")
    named = left.where(finite(F.col(lx), F.col(ly)))
    named = named if group is None else named.where(F.col(group).isNotNull())
    rows = staged(named.withColumn("_id", F.monotonically_increasing_id()), "searching")
    open_ = rows.select("_id", F.col(lx).cast("double").alias("_x"), F.col(ly).cast("double").alias("_y"), *([F.col(group).alias("_group")] if group else []), *([F.col(unequal[0]).alias("_own")] if unequal else []))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    found = None
    for step in range(_first_step(spots, radius, within), -1, -1):
        side = float(radius) / STEP**step
        a = open_.withColumn("_o", around).withColumn("_cx", _cell(F.col("_x"), side) + F.col("_o.i")).withColumn("_cy", _cell(F.col("_y"), side) + F.col("_o.j")).drop("_o")
        b = spots.withColumn("_cx", _cell(F.col("rx"), side)).withColumn("_cy", _cell(F.col("ry"), side))
        met = a.join(b, ["_cx", "_cy", *within]).withColumn("_d", planar(F.col("_x"), F.col("_y"), F.col("rx"), F.col("ry"))).where(F.col("_d") <= side)
        if unequal:
            met = met.withColumn("_row", F.when(F.col("_row.o") != F.col("_own"), F.col("_row")).otherwise(F.col("_second"))).where(F.col("_row").isNotNull() & (F.col("_row.o") != F.col("_own")))
        best = met.groupBy("_id").agg(F.min(F.struct("_d", F.col("_row.t").alias("t"), F.col("_row.r").alias("r"))).alias("_best"))
        best = staged(best, "nearest") if step else best
        found = best if found is None else found.unionByName(best)
        if step:
            open_ = staged(open_.join(best.select("_id"), "_id", "left_anti"), "searching")
            if open_.isEmpty():
                break
    out = rows.join(found, "_id").select(*left.columns, *[F.col("_best.r")[c].alias(c) for c in right.columns], F.col("_best._d").alias(distance))
    # left rows of equal keys
    w = Window.partitionBy(*keys).orderBy(distance, tie)
    return out.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def nearest(left: DataFrame, right: DataFrame, radius: float, keys: Sequence[str], tie: str, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry", distance: str = "dist") -> DataFrame:
    """The nearest row of `right` within `radius` for each row of `left` (its `keys`); ties go to the smallest `tie`."""
    return _nearest(left, right, radius, keys, tie, lx, ly, rx, ry, distance)


def polygon_edges(polygons: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, x0, y0, x1, y1) of the edges of rings given as arrays of struct<x, y>; open rings are closed."""
    closed = F.concat(F.col(ring), F.slice(F.col(ring), 1, 1))
    e = polygons.select(key, F.posexplode(F.transform(F.slice(closed, F.lit(1), F.size(ring)), lambda p, i: F.struct(p.alias("a"), F.get(closed, i + 1).alias("b")))).alias("n", "e"))
    return e.select(key, F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1")).where("x0 <> x1 or y0 <> y1")


#: Where the grid of a cover begins, in parts of a cell's side: no fraction, so that round coordinates miss its corners.
ORIGIN = (0.3819660112501051, 0.7236067977499789)


def _place(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """The cell of a cover that a point lies in."""
    return _cell(x - ORIGIN[0] * size, size), _cell(y - ORIGIN[1] * size, size)


def _corner(size: float) -> tuple[Column, Column]:
    return (F.col("_cx") + ORIGIN[0]) * float(size), (F.col("_cy") + ORIGIN[1]) * float(size)


def _at_height(y: Column) -> Column:
    """Where an edge is at the height `y`."""
    return (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")


def polygon_cover(edges: DataFrame, key: str, size: float) -> DataFrame:
    """(key, _cx, _cy, inside, edges): cells of side `size` that polygons touch.

    `inside` says whether the cell's lower left corner is inside; `edges` are those that touch the cell, as an array of
    struct<x0, y0, x1, y1>, null for cells that lie inside as a whole.  The corner counts as a point to the right of itself
    by a hair, and above by a much smaller one.
    """
    s = F.lit(float(size))
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    across = lambda x: _place(x, x, size)[0]
    up = lambda y: _place(y, y, size)[1]
    rows = edges.where(finite(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).withColumn("_cy", F.explode(F.sequence(up(low), up(high))))
    bottom = _corner(size)[1]
    flat = F.col("y0") == F.col("y1")
    ends = [F.when(flat, F.col("x0")).otherwise(_at_height(F.greatest(low, bottom))), F.when(flat, F.col("x1")).otherwise(_at_height(F.least(high, bottom + s)))]
    slack = s * 1e-9 + F.greatest(F.abs("x0"), F.abs("x1")) * 1e-12
    touched = rows.withColumn("_cx", F.explode(F.sequence(across(F.least(*ends) - slack), across(F.greatest(*ends) + slack))))
    border = touched.groupBy(key, "_cx", "_cy").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("edges"))
    # of each row of cells, from the right: crossings of its lower line, corners of border cells, and places right of those
    crossing = rows.where((F.col("y0") > bottom) != (F.col("y1") > bottom)).select(key, "_cy", _at_height(bottom).alias("_at"), F.lit(2).alias("_kind"), F.lit(None).cast("long").alias("_cx"), F.lit(None).cast(border.schema["edges"].dataType).alias("edges"))
    event = lambda shift, kind, e: border.select(key, "_cy", (_corner(size)[0] + shift * s).alias("_at"), F.lit(kind).alias("_kind"), "_cx", e.alias("edges"))
    events = crossing.unionByName(event(0, 0, F.col("edges"))).unionByName(event(1, 1, F.lit(None).cast(border.schema["edges"].dataType)))
    right = Window.partitionBy(key, "_cy").orderBy(F.desc("_at"), "_kind")
    counted = events.withColumn("inside", F.sum((F.col("_kind") == 2).cast("int")).over(right) % 2 == 1)
    following = F.min(F.when(F.col("_kind") == 0, F.col("_cx"))).over(Window.partitionBy(key, "_cy").orderBy(F.col("_cx").asc_nulls_first()).rangeBetween(1, Window.unboundedFollowing))
    counted = counted.where("_kind < 2").withColumn("_next", following)
    own = counted.where("_kind = 0").select(key, "_cx", "_cy", "inside", "edges")
    # a gap between border cells lies inside or outside as a whole
    gap = counted.where("_kind = 1 and inside and _next > _cx + 1").select(key, F.explode(F.sequence(F.col("_cx") + 1, F.col("_next") - 1)).alias("_cx"), "_cy", "inside", "edges")
    return own.unionByName(gap)


def points_in_polygons(points: DataFrame, edges: DataFrame, point: str, key: str, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """(point, key): polygons that each row of `points` lies in, by the parity of the edges that a ray to the right crosses.

    Within its cell a point is reached from the corner upwards and then to the right; each edge crossed on the way turns
    inside into outside.  Points with a null, NaN or infinite coordinate lie nowhere.
    """
    px, py = F.col("_px"), F.col("_py")
    p = points.where(finite(F.col(x), F.col(y))).select(F.col(point), F.col(x).alias("_px"), F.col(y).alias("_py"), *[c.alias(name) for c, name in zip(_place(F.col(x), F.col(y), size), ("_cx", "_cy"), strict=True)])
    cx, cy = _corner(size)

    def crossed(e: Column) -> Column:
        slope = (e["y1"] - e["y0"]) / F.nullif(e["x1"] - e["x0"], F.lit(0.0))
        up = e["y0"] + (cx - e["x0"]) * slope
        across = (e["x1"] - e["x0"]) * (py - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)) + e["x0"]
        vertical = ((e["x0"] > cx) != (e["x1"] > cx)) & ((up > cy) | ((up == cy) & (slope > 0))) & ((up < py) | ((up == py) & (slope <= 0)))
        return F.coalesce(vertical, F.lit(False)) != F.coalesce(((e["y0"] > py) != (e["y1"] > py)) & (across > cx) & (across <= px), F.lit(False))

    odd = F.coalesce(F.size(F.filter("edges", crossed)) % 2 == 1, F.lit(False))
    return p.join(polygon_cover(edges, key, size), ["_cx", "_cy"]).where(F.col("inside") != odd).select(point, key)


def connecting(points: DataFrame, key: str, radius: float, x: str = "x", y: str = "y", group: str | None = None) -> DataFrame:
    """(u, v) and `group`: edges that join the same points as all pairs within `radius` do, directly or in a chain; with
    `group`, pairs of one group only.

    Cells are so small that all their points are within the radius: they hang on their smallest key, the cell's name.  Two
    cells meet if a pair of their points does.  The outermost points towards each other are tried first; all points near the
    other cell's box are compared only between cells that are not joined yet, so crowded places cost no more than others.
    """
    from transitloom.plans.components import components

    side, within = radius / 2, [] if group is None else [group]
    at = [*within, "_cx", "_cy"]
    px, py = F.col("_x"), F.col("_y")
    usable = points.where(finite(F.col(x), F.col(y)) & F.col(key).isNotNull())
    usable = usable if group is None else usable.where(F.col(group).isNotNull())
    p = staged(usable.select(F.col(key).alias("_k"), *within, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), _cell(F.col(x), side).alias("_cx"), _cell(F.col(y), side).alias("_cy")), "points")
    half = [(i, j) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)]
    spot = F.struct(px.alias("x"), py.alias("y"))
    tip = lambda i, j: F.max_by(spot, i * px + j * py)
    ends = [*[tip(i, j) for i, j in half], *[tip(-i, -j) for i, j in half]]
    box = F.struct(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")).alias("box")
    cells = staged(p.groupBy(*at).agg(F.min("_k").alias("name"), box, F.array(*ends[: len(half)]).alias("to"), F.array(*ends[len(half) :]).alias("back")).withColumn("cell", F.monotonically_increasing_id()), "cells")
    to = cells.select(*within, F.col("cell").alias("uc"), F.col("name").alias("u"), F.col("box").alias("ubox"), "_cx", "_cy", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j")) for n, (i, j) in enumerate(half)])).alias("o"), "to")
    to = to.select(*within, "uc", "u", "ubox", F.col("_cx").alias("ux"), F.col("_cy").alias("uy"), (F.col("_cx") + F.col("o.i")).alias("_cx"), (F.col("_cy") + F.col("o.j")).alias("_cy"), F.col("o.n").alias("n"), F.get("to", F.col("o.n")).alias("a"))
    beside = to.join(cells.select(*at, F.col("cell").alias("vc"), F.col("name").alias("v"), F.col("box").alias("vbox"), "back"), at).withColumn("b", F.get("back", F.col("n")))
    beside = staged(beside.withColumn("near", planar(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) <= radius).drop("n", "to", "back"), "beside")
    roots = staged(components(beside.where("near").select(F.col("uc").alias("u"), F.col("vc").alias("v"))), "roots")
    root = lambda a, name: roots.select(F.col("node").alias(a), F.col("root").alias(name))
    apart = beside.where("not near").join(root("uc", "_ra"), "uc", "left").join(root("vc", "_rb"), "vc", "left")
    apart = apart.where("_ra is null or _rb is null or _ra <> _rb").select(*within, "u", "v", "ux", "uy", "ubox", "_cx", "_cy", "vbox")
    off = lambda c, b: F.greatest(F.col(f"{b}.{c}0") - F.col(f"_{c}"), F.col(f"_{c}") - F.col(f"{b}.{c}1"), F.lit(0.0))
    close = lambda b: off("x", b) * off("x", b) + off("y", b) * off("y", b) <= radius * radius * (1 + 1e-9)
    one = apart.join(p.withColumnRenamed("_cx", "ux").withColumnRenamed("_cy", "uy").drop("_k"), [*within, "ux", "uy"]).where(close("vbox")).select(*at, "ux", "uy", "u", "v", "ubox", px.alias("ax"), py.alias("ay"))
    two = one.join(p.drop("_k"), at).where(close("ubox")).where(planar(F.col("ax"), F.col("ay"), px, py) <= radius)
    edge = [*within, "u", "v"]
    stars = p.join(cells.select(*at, F.col("name").alias("u")), at).where("u <> _k").select(*within, "u", F.col("_k").alias("v"))
    return stars.unionByName(beside.where("near and u <> v").select(*edge)).unionByName(two.where("u <> v").select(*edge).distinct())


def clusters(points: DataFrame, key: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """(key, cluster): density clusters with a minimum size of one, that is components of points within `radius`;
    a cluster's name is its smallest key."""
    from transitloom.plans.components import components

    roots = components(connecting(points, key, radius, x, y))
    return points.select(key).join(roots, points[key] == roots["node"], "left").select(key, F.coalesce("root", key).alias("cluster"))


def nearest_in_group(left: DataFrame, right: DataFrame, group: str, radius: float, keys: Sequence[str], tie: str, unequal: tuple[str, str] | None = None) -> DataFrame:
    """As `nearest`, among rows with the same `group` only (`_group` on the right side); with `unequal`, a column of
    each side, rows that agree in those do not meet."""
    return _nearest(left, right, radius, keys, tie, "x", "y", "rx", "ry", "dist", group, unequal).drop("_group")


def weighted_centroid(points: DataFrame, keys: Sequence[str], weight: str, x: str = "x", y: str = "y") -> DataFrame:
    w = F.col(weight)
    return points.groupBy(*keys).agg((F.sum(F.col(x) * w) / F.sum(w)).alias("cx"), (F.sum(F.col(y) * w) / F.sum(w)).alias("cy"))
