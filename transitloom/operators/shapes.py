"""Line shapes: geodesic lengths, assembly of parts, simplification and clipping, batch-wise in Arrow."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructType

#: The WGS84 ellipsoid.
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
LINE = ArrayType(StructType().add("x", DoubleType()).add("y", DoubleType()))


def geodesic(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Metres along the ellipsoid by Vincenty's inverse formula; nearly antipodal points fall back to a sphere."""
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(v, dtype=float)) for v in (lon1, lat1, lon2, lat2))
    turn = lon2 - lon1
    u1, u2 = np.arctan((1 - FLAT) * np.tan(lat1)), np.arctan((1 - FLAT) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = turn.copy()
    with np.errstate(all="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.sqrt((c2 * sl) ** 2 + (c1 * s2 - s1 * c2 * cl) ** 2)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, c1 * c2 * sl / np.where(ss == 0, 1, ss))
            ca2 = 1 - sa**2
            cm = np.where(ca2 == 0, 0, cs - 2 * s1 * s2 / np.where(ca2 == 0, 1, ca2))
            c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            new = turn + (1 - c) * FLAT * sa * (sigma + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if np.all(done | np.isnan(new)):
                break
        u = ca2 * (A**2 - B**2) / B**2
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        delta = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        out = B * big * (sigma - delta)
        sphere = 2 * 6371008.8 * np.arcsin(np.sqrt(np.clip(np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(turn / 2) ** 2, 0, 1)))
    return np.where(done, out, sphere)


def _let(value: Column, f) -> Column:
    """f(value), with `value` evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 60) -> Column:
    """Metres along the ellipsoid, as a column: the fixed point of `geodesic` is sought by up to `rounds` steps of an
    aggregate, which rests once it has been found.  Null if a coordinate is null."""
    reduced = lambda lat: F.atan((1 - FLAT) * F.tan(F.radians(lat)))
    turn = F.radians(lon2 - lon1)
    start = _let(F.struct(reduced(lat1).alias("u"), reduced(lat2).alias("v")), lambda p: F.struct(turn.alias("lam"), F.lit(False).alias("done"), turn.alias("turn"), *[f(p[x]).alias(n) for n, f, x in (("s1", F.sin, "u"), ("c1", F.cos, "u"), ("s2", F.sin, "v"), ("c2", F.cos, "v"))]))

    def angles(k: Column, then) -> Column:
        """The values that both the step and the length need."""

        def of(t: Column) -> Column:
            ss = F.sqrt(F.pow(k["c2"] * t["sl"], 2) + F.pow(k["c1"] * k["s2"] - k["s1"] * k["c2"] * t["cl"], 2))
            return F.struct(ss.alias("ss"), (k["s1"] * k["s2"] + k["c1"] * k["c2"] * t["cl"]).alias("cs"), t["sl"].alias("sl"))

        def more(t: Column) -> Column:
            sa = F.when(t["ss"] == 0, 0.0).otherwise(k["c1"] * k["c2"] * t["sl"] / F.nullif(t["ss"], F.lit(0.0)))
            return F.struct(t["ss"].alias("ss"), t["cs"].alias("cs"), F.atan2(t["ss"], t["cs"]).alias("sigma"), sa.alias("sa"), (1 - sa * sa).alias("ca2"))

        def last(t: Column) -> Column:
            cm = F.when(t["ca2"] == 0, 0.0).otherwise(t["cs"] - 2 * k["s1"] * k["s2"] / F.nullif(t["ca2"], F.lit(0.0)))
            return F.struct(*[t[x].alias(x) for x in ("ss", "cs", "sigma", "sa", "ca2")], cm.alias("cm"))

        sines = F.struct(F.sin(k["lam"]).alias("sl"), F.cos(k["lam"]).alias("cl"))
        return _let(_let(_let(_let(sines, of), more), last), then)

    def step(k: Column, _: Column) -> Column:
        def moved(t: Column) -> Column:
            c = FLAT / 16 * t["ca2"] * (4 + FLAT * (4 - 3 * t["ca2"]))
            return k["turn"] + (1 - c) * FLAT * t["sa"] * (t["sigma"] + c * t["ss"] * (t["cm"] + c * t["cs"] * (2 * t["cm"] * t["cm"] - 1)))

        new = _let(angles(k, moved), lambda x: F.struct(x.alias("lam"), (F.abs(x - k["lam"]) < 1e-12).alias("done"), *[k[n].alias(n) for n in ("turn", "s1", "c1", "s2", "c2")]))
        return F.when(k["done"], k).otherwise(new)

    def length(k: Column) -> Column:
        def metres(t: Column) -> Column:
            u = t["ca2"] * ((A**2 - B**2) / B**2)
            big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            cm2 = t["cm"] * t["cm"]
            delta = small * t["ss"] * (t["cm"] + small / 4 * (t["cs"] * (2 * cm2 - 1) - small / 6 * t["cm"] * (4 * t["ss"] * t["ss"] - 3) * (4 * cm2 - 3)))
            return B * big * (t["sigma"] - delta)

        return F.when(k["done"], angles(k, metres))

    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(turn / 2), 2)
    sphere = F.when(half.isNotNull(), 2 * 6371008.8 * F.asin(F.sqrt(F.least(F.lit(1.0), half))))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, length), sphere)


def cumulative_m(points: DataFrame, shape: str, order: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """`points` with dist, the metres along the ellipsoid from the first point of the shape."""
    from pyspark.sql import Window

    w = Window.partitionBy(shape).orderBy(order)
    p = points.withColumn("_x", F.lag(lon).over(w)).withColumn("_y", F.lag(lat).over(w))
    p = p.withColumn("_leg", F.when(F.col("_x").isNull(), 0.0).otherwise(geodesic_m(F.coalesce("_x", lon), F.coalesce("_y", lat), F.col(lon), F.col(lat))))
    return p.withColumn("dist", F.sum("_leg").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_x", "_y", "_leg")


def joined_parts(parts: list, start: tuple[float, float]) -> list[tuple[float, float]]:
    """One line of all parts: each next part is the one whose nearer end follows, turned where needed."""
    left, line, at = [list(map(tuple, p)) for p in parts if len(p)], [], start
    while left:
        gap = lambda q: math.hypot(q[0] - at[0], q[1] - at[1])  # noqa: B023, E731
        k, turn = min(((k, t) for k in range(len(left)) for t in (False, True)), key=lambda x: (gap(left[x[0]][-1 if x[1] else 0]), x))
        p = left.pop(k)
        p = p[::-1] if turn else p
        line += p[1:] if line and line[-1] == p[0] else p
        at = line[-1]
    return line


def assembled(df: DataFrame, shape: str, order: str, part: str, x0: str, y0: str) -> DataFrame:
    """(shape, line): the parts of each shape as one line from its start.  A shape's parts are met in one task."""
    kind = dict(df.dtypes)[shape]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        parts = [[(p["x"], p["y"]) for p in part_] for part_ in pdf[part] if part_ is not None]
        line = joined_parts(parts, (pdf[x0].iloc[0], pdf[y0].iloc[0]))
        return pd.DataFrame({shape: [pdf[shape].iloc[0]], "line": [[{"x": x, "y": y} for x, y in line]]})

    return df.groupBy(shape).applyInPandas(run, f"{shape} {kind}, line array<struct<x: double, y: double>>")


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker, without recursion."""
    if len(points) < 3:
        return points
    p = np.array(points, dtype=float)
    keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        size = math.hypot(*d)
        far = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / size if size else np.hypot(q[:, 0], q[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[i] for i in sorted(keep)]


def simplify(tolerance: float):
    """A column function: lines simplified to a tolerance."""

    @pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: None if line is None else [{"x": x, "y": y} for x, y in simplified([(q["x"], q["y"]) for q in line], tolerance)])

    return run


def clipped_ring(ring: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    """Sutherland-Hodgman: a ring clipped to a box."""
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for i, q in enumerate(ring):
            p = ring[i - 1]
            inside_p, inside_q = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if inside_p != inside_q:
                f = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
            if inside_q:
                out.append(q)
        ring = out
    return ring


def leg_lengths_km(line: Column) -> Column:
    from transitloom.functions.geo import line_length

    return line_length(line) / 1000
