"""Vector layers of GeoJSON features, read through Spark's Python data source interface.

Only the named properties become columns, next to the geometry's kind, bounding box and rings; comparisons with constants on
properties and on the box are pushed into the reader, which drops a feature before its geometry is built.  Files with one
feature a line are read in byte ranges by many tasks; a feature collection is one task a file.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

#: Bytes of a file with one feature a line that a task reads.
SPLIT_BYTES = 32 << 20
BATCH = 2000
BOX = ["x0", "y0", "x1", "y1"]
GEOMETRY = "kind string, x0 double, y0 double, x1 double, y1 double, rings array<array<struct<x: double, y: double>>>"
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None


def _rings(geometry: dict | None) -> tuple[str | None, list | None]:
    """The kind of a geometry and its rings or lines, each a list of positions."""
    if not geometry:
        return None, None
    kind, at = geometry.get("type"), geometry.get("coordinates")
    if kind == "GeometryCollection":
        return kind, [r for g in geometry.get("geometries", []) for r in _rings(g)[1] or []]
    depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}.get(kind)
    if depth is None or at is None:
        return kind, None
    return kind, [[at]] if depth == 0 else [at] if depth == 1 else at if depth == 2 else [r for polygon in at for r in polygon]


def _value(value, kind):
    """A property as its column's type; null where it doesn't fit."""
    if value is None or isinstance(kind, StringType):
        return value if value is None or isinstance(value, str) else json.dumps(value)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if isinstance(kind, (DoubleType, FloatType)):
        return float(value)
    bits = 63 if isinstance(kind, LongType) else 31
    return int(value) if value == int(value) and -(1 << bits) <= value < 1 << bits else None


class FeatureReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.lines = options.get("lines", "false").lower() == "true"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            known = isinstance(f, (*_COMPARED, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] != "rings"
            if known:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            starts = range(0, f.size, self.split) if self.lines else [0]
            out += [Part(f.path, a, min(a + self.split, f.size) if self.lines else None) for a in starts]
        return out

    def _features(self, part: Part) -> Iterator[dict]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(part.path) as raw:
            if part.end is None:
                whole = json.loads(raw.read())
                yield from whole.get("features", []) if whole.get("type") == "FeatureCollection" else [whole]
                return
            # a line belongs to the range that it begins in
            raw.seek(max(0, part.start - 1))
            at, rest = max(0, part.start - 1), b""
            skip = part.start > 0
            while True:
                block = raw.read(1 << 20)
                pieces = (rest + block).split(b"\n")
                rest = pieces.pop() if block else b""
                for line in pieces:
                    begin, at = at, at + len(line) + 1
                    if skip:
                        skip = False
                        continue
                    if begin >= part.end:
                        return
                    if line.strip():
                        yield json.loads(line)
                if not block:
                    return

    def _passes(self, row: dict) -> bool:
        for f in self.filters:
            v = row[f.attribute[0]]
            if isinstance(f, (IsNull, IsNotNull)):
                ok = (v is None) == isinstance(f, IsNull)
            elif isinstance(f, EqualNullSafe):
                ok = v == f.value
            elif v is None:
                ok = False
            elif isinstance(f, In):
                ok = v in f.value
            elif isinstance(f, StringStartsWith):
                ok = v.startswith(f.value)
            else:
                ok = _COMPARED[type(f)](v, f.value)
            if not ok:
                return False
        return True

    def read(self, partition: Part):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, rows = to_arrow_schema(self.schema), []
        for feature in self._features(partition):
            own = feature.get("properties") or {}
            kind, rings = _rings(feature.get("geometry"))
            row = {}
            for field in self.schema.fields:
                if field.name not in (*BOX, "kind", "rings"):
                    row[field.name] = _value(own.get(field.name), field.dataType)
            places = [p for r in rings or [] for p in r]
            for name, pick, k in (("x0", min, 0), ("y0", min, 1), ("x1", max, 0), ("y1", max, 1)):
                row[name] = float(pick(p[k] for p in places)) if places else None
            row["kind"] = kind
            if not self._passes(row):
                continue
            if "rings" in self.schema.fieldNames():
                row["rings"] = None if rings is None else [[{"x": float(p[0]), "y": float(p[1])} for p in r] for r in rings]
            rows.append(row)
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)


class Features(DataSource):
    """Options: path, `properties` (columns as DDL), `lines` (one feature a line), `geometry` (false: without rings)."""

    @classmethod
    def name(cls) -> str:
        return "geofeatures"

    def schema(self) -> str:
        geometry = GEOMETRY if self.options.get("geometry", "true").lower() == "true" else GEOMETRY[: GEOMETRY.index(", rings")]
        return ", ".join(x for x in (self.options.get("properties", ""), geometry) if x)

    def reader(self, schema: StructType) -> FeatureReader:
        return FeatureReader(schema, dict(self.options))


def read_features(spark: SparkSession, path: str, properties: str = "", lines: bool = False, geometry: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The properties (as DDL), kind, x0, y0, x1, y1 and rings of the features at `path`, a file or a folder.

    Rings of all parts lie in one array, holes included, so that their edges' parity tells the inside.  Properties that are
    missing or don't fit are null, as are box and rings of features without a geometry.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Features)
    options = {"properties": properties, "lines": str(lines).lower(), "geometry": str(geometry).lower(), "splitBytes": str(split_bytes)}
    return spark.read.format("geofeatures").options(**options).load(path)


def feature_edges(features: DataFrame, key: str) -> DataFrame:
    """(key, x0, y0, x1, y1) of all rings of each feature, for `spatial.points_in_polygons`."""
    from transitloom.operators.spatial import polygon_edges

    return polygon_edges(features.select(key, F.explode("rings").alias("_ring")), key, "_ring")


def feature(properties: Sequence[str], rings: Column) -> Column:
    """A polygon of `rings` (arrays of struct<x, y>) with its properties as one line of GeoJSON; open rings are closed."""
    closed = F.transform(rings, lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))
    places = F.transform(closed, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), places.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def write_features(df: DataFrame, path: str, properties: Sequence[str], rings: str = "rings") -> None:
    """One feature a line, written by all tasks."""
    df.select(feature(properties, F.col(rings)).alias("value")).write.mode("overwrite").text(path)
