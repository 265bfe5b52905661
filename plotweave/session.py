"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. Hot keys in joins against a table that is
# unique on the key are split by AQE; forcing the split is worth the extra exchange.
_RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # wide vectors take some fifty times their shuffled bytes once they are aggregated in a task
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app_name: str = "plotweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` keys use `__` for `.`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_RUNTIME_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # the cluster default only makes empty tasks on one machine
        spark.conf.set("spark.sql.shuffle.partitions", str(parallelism(spark)))
    ship(spark)
    return spark


# Bytes of stored tables per shuffle partition; the rows derived from them are some ten times larger.
_SHUFFLE_BYTES = 4 << 20


def size_shuffles(spark: SparkSession, folder: str) -> SparkSession:
    """At least a shuffle partition per 4 MB of the tables in `folder`, so that what a task holds does not grow with them.

    The number is only ever raised; AQE puts small partitions together again.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    stored = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    wanted = -(-stored // _SHUFFLE_BYTES)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return spark


@contextmanager
def batches_by_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches bounded by rows alone, for actions over tables of short vectors.

    The byte limit is checked by measuring every nested vector of a row, which costs more than the
    conversion itself. Only for rows of a known small size; the limit of the session returns behind it.
    """
    with _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)):
        yield


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows, for actions whose tasks keep much else in memory."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers, whatever folder they start in."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="plotweave-"), "plotweave.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)


def group_partitions(spark: SparkSession, n_groups: int) -> int:
    """Partition count for a shuffle that feeds `n_groups` grouped-map calls.

    Given explicitly because AQE coalesces by bytes, and these groups are light in bytes
    but heavy in CPU. A task sorts its groups together, so it gets few of them.
    """
    return max(1, min(n_groups, max(2 * parallelism(spark), n_groups // 4)))


# Below this estimated size per core an input may sit in a single split.
_SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input to all cores before CPU-heavy work on them.

    Only inputs whose planned size is small are shuffled; a large one has splits enough.
    """
    spark = df.sparkSession
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except (AttributeError, TypeError, ValueError):
        return df
    n = parallelism(spark)
    return df.repartition(n) if size < _SPREAD_BYTES * n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors can reach: `spark.checkpoint.dir` of the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="plotweave-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/plotweave-{label}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, all tables that `cut` writes inside.

    Results that still read them must be written before. The files are deleted through the file system
    of the shared folder, whatever store that is.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, label: str = "stage", dense: bool = False) -> DataFrame:
    """Write `df` once as a table in the shared folder and go on from the written files.

    Unlike cached blocks the files outlive a lost executor, and later readers still prune
    columns. They stay until the enclosing `scratch_scope` ends, or for good without one. `dense` files take less
    room and more time to write.
    """
    path = scratch_path(df.sparkSession, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path, compression="zstd" if dense else None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, label: str = "result", also: Iterable[str] = ()) -> DataFrame:
    """Like `cut`, for the result of a `scratch_scope`: the table outlives the innermost scope.

    `also` names further folders in the shared folder that the scope shall delete.
    """
    inner = _scopes.pop() if _scopes else None
    try:
        out = cut(df, label)
    finally:
        if inner is not None:
            _scopes.append(inner + list(also))
    return out
