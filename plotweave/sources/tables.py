"""Tabular sources and sinks: Parquet, delimited text, zipped text, per-area layout, manifests."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plotweave.functions.clean import pad_code, require
from plotweave.functions.geoarrays import from_wkb, to_wkb
from plotweave.functions.project import reproject
from plotweave.sources.records import SplitText

AREA = "dep"

# --- reading -------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet table; a declared schema prunes at once."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_geo_table(spark: SparkSession, path: str, srid: int, geometry: str = "geometry") -> DataFrame:
    """Parquet with a WKB column; adds grid `polygons` in its place. The source system is given
    by the caller."""
    df = require(spark.read.parquet(path), geometry)
    return df.withColumn("polygons", reproject(from_wkb(F.col(geometry)), srid)).drop(geometry)


def _typed(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ";", partitions: int | None = None
) -> DataFrame:
    """Delimited text with a header; columns are found by name in each file, whatever their order.

    Files that share a header are read together, and only the columns of `schema` are parsed; a name
    that a file lacks is an error. Quoted cells may hold line breaks, and a large plain file is read in
    many splits all the same; a quote inside a cell must be doubled, the cell quoted. Without a schema the
    types are inferred, which reads the text twice and each file in one split. A gzip file is one split, so it is spread out on request.
    """
    options = {"sep": sep, "quote": '"', "escape": '"'}
    if schema is None:
        df = spark.read.options(**options).option("header", "true").option("multiLine", "true").option("inferSchema", "true").csv(path)
        return df.repartition(partitions) if partitions else df
    wanted = _typed(schema)
    df = spark.createDataFrame([], wanted)
    text = SplitText(spark, path, sep)
    for head, files in text.headers().items():
        names = next(csv.reader([head.lstrip("\ufeff").rstrip("\r")], delimiter=sep))
        missing = [n for n in wanted.names if n not in names]
        if missing:
            raise ValueError(f"{files[0]} lacks columns {missing}; found {list(names)}")
        types = {f.name: f.dataType.simpleString() for f in wanted}
        # by place, as a header may repeat names that are not asked for
        cells = ", ".join(f"_{k} {types.get(n, 'string')}" for k, n in enumerate(names))
        parsed = text.records(head).select(F.from_csv(F.regexp_replace("record", "\r+$", ""), cells, options).alias("r"))
        df = df.union(parsed.select(*[F.col(f"r._{names.index(n)}").alias(n) for n in wanted.names]))
    return df.repartition(partitions) if partitions else df


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Community table written by `write_labels`, ids as text."""
    df = spark.read.option("header", "true").csv(path)
    return df.select(F.col("id_bat").cast("string").alias("id_bat"), F.col("community").cast("int").alias("community"))


def _unzipped(names: list[str], sep: str, chunk: int):
    """Cells of the named columns of zipped text, a chunk of records at a time."""

    def records(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive, archive.open(archive.namelist()[0]) as entry:
                    rows = csv.reader(io.TextIOWrapper(entry, encoding="utf-8-sig", newline=""), delimiter=sep)
                    header = next(rows, None)
                    if header is None:
                        continue
                    missing = [n for n in names if n not in header]
                    if missing:
                        raise ValueError(f"{path} lacks columns {missing}; found {header}")
                    places = [header.index(n) for n in names]
                    while part := list(itertools.islice(rows, chunk)):
                        cells = [[r[p] or None if p < len(r) else None for r in part if r] for p in places]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names)

    return records


def read_zipped(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";", partitions: int | None = None) -> DataFrame:
    """Delimited text inside zip files, first entry of each; columns are found by name in each file.

    The archives are streamed record by record, so a task holds a compressed file and one chunk. An
    empty cell is NULL, and so is a cell that does not fit its type.
    """
    return unzip(spark.read.format("binaryFile").load(path).select("path", "content"), schema, sep, partitions)


def unzip(files: DataFrame, schema: T.StructType | str, sep: str = ";", partitions: int | None = None) -> DataFrame:
    """As `read_zipped`, for archives in a column: `(path, content)`."""
    wanted = _typed(schema)
    text = T.StructType([T.StructField(n, T.StringType()) for n in wanted.names])
    cells = files.mapInArrow(_unzipped(wanted.names, sep, 20_000), text)
    if partitions:
        cells = cells.repartition(partitions)
    return cells.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


# --- discovery -----------------------------------------------------------------------------


def find_files(spark: SparkSession, root: str, suffix: str, containing: str = "") -> DataFrame:
    """`(path, length)` of files below `root` by suffix and name part, in path order."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{containing}*{suffix}").load(root)
    )
    return listing.select("path", "length").orderBy("path")


def first_file(spark: SparkSession, root: str, suffix: str, containing: str = "") -> str:
    row = find_files(spark, root, suffix, containing).first()
    if row is None:
        raise FileNotFoundError(f"no *{containing}*{suffix} below {root}")
    return row["path"]


# --- writing -------------------------------------------------------------------------------


# Which layer comes before.
LAYERS = {"intrants": "raw", "graphs": "intrants"}


def layer_root(root: str, layer: str) -> str:
    """Folder of the next layer: beside a folder named as the layer before, else inside `root`."""
    parent, _, name = root.rstrip("/").rpartition("/")
    return f"{parent}/{layer}" if parent and name == LAYERS[layer] else f"{root.rstrip('/')}/{layer}"


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create or replace a stored table of the session's catalog from a query, in one write; its files
    lie in the warehouse or at `path`."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_by_area(df: DataFrame, path: str, area: str = AREA) -> None:
    """Parquet with one folder per area; only the areas in `df` are replaced.

    Rows are brought together by area; Spark splits the areas that are too large for one task by
    their bytes, so a large area has many files of even size and a small one has one.
    """
    require(df, area)
    dealt = df.hint("rebalance", area)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(area).parquet(path)


def write_geo_by_area(df: DataFrame, path: str, area: str = AREA, polygons: str = "polygons") -> None:
    """As `write_by_area`, with the geometry as a WKB column."""
    write_by_area(df.withColumn("geometry", to_wkb(F.col(polygons))).drop(polygons), path, area)


def write_labels(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def areas_present(spark: SparkSession, path: str, area: str = AREA) -> DataFrame:
    """Areas that a per-area table holds; none if there is no such table. A store that fails to answer raises, as
    taking it for empty would write areas anew that exist."""
    try:
        # declared, as inference would turn "01" into the number 1
        return spark.read.schema(f"{area} string").parquet(path).select(area).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{area} string")


def missing_areas(requested: DataFrame, present: DataFrame, area: str = AREA) -> DataFrame:
    """Requested areas, padded, that are not present yet."""
    want = requested.select(pad_code(F.col(area)).alias(area)).distinct()
    return want.join(present.select(pad_code(F.col(area)).alias(area)).distinct(), area, "left_anti")


def ingest_missing(source: DataFrame, path: str, area: str = AREA) -> None:
    """Write only the areas of `source` that the target lacks."""
    spark = source.sparkSession
    padded = source.withColumn(area, pad_code(F.col(area)))
    write_by_area(padded.join(areas_present(spark, path, area), area, "left_anti"), path, area)


def manifest(tables: dict[str, DataFrame], area: str = AREA) -> DataFrame:
    """Row counts per area as `(dep, n_<table>...)`."""
    counts = None
    for name, df in tables.items():
        one = df.groupBy(area).agg(F.count("*").alias("n")).select(area, F.lit(name).alias("t"), "n")
        counts = one if counts is None else counts.union(one)
    pivot = [F.coalesce(F.sum(F.when(F.col("t") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}") for name in tables]
    return counts.groupBy(area).agg(*pivot)


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


# --- graph package -------------------------------------------------------------------------


def write_graph(graph, path: str, indices: dict[str, DataFrame] | None = None) -> None:
    """One Parquet folder per node type, per relation and per node index `(key, node_id)`."""
    for kind, df in (indices or {}).items():
        df.write.mode("overwrite").parquet(f"{path}/index/{kind}")
    for kind, df in graph.nodes.items():
        df.write.mode("overwrite").parquet(f"{path}/nodes/{kind}")
    for relation, df in graph.edges.items():
        df.write.mode("overwrite").parquet(f"{path}/edges/{'-'.join(relation)}")


def read_index(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Keys and node ids of one node type of a graph package."""
    return spark.read.parquet(f"{path}/index/{kind}")


def read_graph(spark: SparkSession, path: str, kinds: Sequence[str], relations: Sequence[tuple[str, str, str]]):
    from plotweave.operators.graph import Graph

    return Graph(
        {k: spark.read.parquet(f"{path}/nodes/{k}") for k in kinds},
        {r: spark.read.parquet(f"{path}/edges/{'-'.join(r)}") for r in relations},
    ).check()
