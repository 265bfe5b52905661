"""GeoPackage layers as a Spark data source: `spark.read.format("gpkg")`.

Options: `path`, `layer`, and `rows` per partition. The layer is read in row-id ranges, one
partition each, and equality and comparison filters on columns declared as whole numbers, doubles or
text go into the query of each range; other declared types (NUMERIC, DATE, ...) compare by rules of
their own there, so their filters stay with Spark.

SQLite opens local files only. A file in another store is handed to every executor by Spark first
(`addFile`), so any path that Spark can read works.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from plotweave.functions.geoarrays import from_wkb
from plotweave.functions.project import reproject

_ENVELOPE_DOUBLES = (0, 4, 6, 6, 8)
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


SHIPPED = "sparkfiles:"


def _open(path: str) -> sqlite3.Connection:
    if path.startswith(SHIPPED):
        path = SparkFiles.get(path.removeprefix(SHIPPED))
    local = path[5:] if path.startswith("file:") else path
    return sqlite3.connect(f"file:{local}?mode=ro&immutable=1", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def wkb_of_blob(blob: bytes | None) -> bytes | None:
    """Strip the header from a GeoPackage geometry; an empty geometry gives None."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    flags = blob[3]
    if flags & 0x10:
        return None
    return bytes(blob[8 + 8 * _ENVELOPE_DOUBLES[(flags >> 1) & 7] :])


def blob_of_wkb(wkb: bytes, srid: int) -> bytes:
    return b"GP" + struct.pack("<BBi", 0, 1, srid) + wkb


@dataclass
class _Range(InputPartition):
    low: int
    high: int


class _LayerReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, pushed: set[str]):
        self.pushed = pushed
        self.schema, self.path, self.layer = schema, options["path"], options["layer"]
        self.rows = int(options.get("rows", 50_000))
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]):
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name not in kinds or name not in self.pushed:
                yield f
            elif type(f) in _COMPARE:
                self.where.append((f"{_quoted(name)} {_COMPARE[type(f)]} ?", [f.value]))
            elif isinstance(f, In):
                self.where.append((f"{_quoted(name)} in ({','.join('?' * len(f.value))})", list(f.value)))
            elif isinstance(f, IsNull):
                self.where.append((f"{_quoted(name)} is null", []))
            elif isinstance(f, IsNotNull):
                self.where.append((f"{_quoted(name)} is not null", []))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        with _open(self.path) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.layer)}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        return [_Range(a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]
        shapes = [i for i, f in enumerate(self.schema.fields) if isinstance(f.dataType, BinaryType)]
        kinds = [{LongType: int, DoubleType: float, StringType: str}.get(type(f.dataType)) for f in self.schema.fields]
        conditions = "".join(f" and {c}" for c, _ in self.where)
        values = [v for _, vs in self.where for v in vs]
        query = f"select {','.join(map(_quoted, names))} from {_quoted(self.layer)} where rowid >= ? and rowid < ?{conditions}"
        db = _open(self.path)
        try:
            for row in db.execute(query, [partition.low, partition.high, *values]):
                out = [k(v) if k is not None and v is not None else v for k, v in zip(kinds, row)]
                for i in shapes:
                    out[i] = wkb_of_blob(row[i]) if row[i] is not None and row[i][:2] == b"GP" else row[i]
                yield tuple(out)
        finally:
            db.close()


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"pragma table_info({_quoted(self.options['layer'])})").fetchall()
            shape = {r[0] for r in db.execute("select column_name from gpkg_geometry_columns where table_name = ?", [self.options["layer"]])}
        if not columns:
            raise ValueError(f"no layer {self.options['layer']} in {self.options['path']}")

        def kind(name: str, declared: str):
            declared = declared.upper()
            if name in shape or "BLOB" in declared:
                return BinaryType()
            if "INT" in declared:
                return LongType()
            if any(k in declared for k in ("REAL", "DOUBLE", "FLOAT")):
                return DoubleType()
            return StringType()

        return StructType([StructField(c[1], kind(c[1], c[2])) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        with _open(options["path"]) as db:
            columns = db.execute(f"pragma table_info({_quoted(options['layer'])})").fetchall()
        exact = ("INT", "REAL", "DOUBLE", "FLOAT", "TEXT", "CHAR")
        return _LayerReader(schema, options, {c[1] for c in columns if any(k in c[2].upper() for k in exact)})


def read_layer(spark: SparkSession, path: str, layer: str, srid: int | None = None, geometry: str | None = None, rows: int = 50_000) -> DataFrame:
    """One layer. With `srid`, the geometry column becomes grid `polygons`."""
    scheme, _, rest = path.partition("://")
    if rest and scheme != "file":
        spark.sparkContext.addFile(path)
        path = SHIPPED + path.rsplit("/", 1)[-1]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoPackageSource)
    df = spark.read.format("gpkg").option("path", path).option("layer", layer).option("rows", rows).load()
    if srid is None:
        return df
    shapes = [f.name for f in df.schema.fields if isinstance(f.dataType, BinaryType)]
    name = geometry or shapes[0]
    return df.withColumn("polygons", reproject(from_wkb(F.col(name)), srid)).drop(name)
