"""Records of delimited text that span lines, read from all splits of a file at once.

Whether a line begins inside a quoted cell depends on all lines before it in the file. A first pass
finds for each split in which state it ends for either state it may begin in; a window over those few
rows then gives the true state of each. The second pass puts lines together to records within a
split, and records that reach across a border are joined from their pieces. A split is
handled as a stream, so a task holds one batch of lines and one record.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plotweave.session import cut, parallelism, ship

_SPLITS = "spark.sql.files.minPartitionNum"


def line_ends(sep: str) -> tuple[Callable[[str], bool], Callable[[str], bool]]:
    """Whether a line ends inside quotes, if it begins outside and if it begins inside. A quote opens a
    cell at its start only and is doubled within; what follows the closing one counts as text."""
    s = re.escape(sep)
    cell = rf'(?:"(?:[^"]|"")*+"[^{s}]*+|[^"{s}][^{s}]*+|)'
    outside = re.compile(rf"{cell}(?:{s}{cell})*+", re.DOTALL)
    inside = re.compile(rf'(?:[^"]|"")*+"[^{s}]*+(?:{s}{cell})*+', re.DOTALL)
    return lambda line: '"' in line and not outside.fullmatch(line), lambda line: '"' not in line or not inside.fullmatch(line)


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[str]]]:
    """Lines by split; a split comes in as many runs as it has batches."""
    for b in batches:
        lines = b.column(0).to_pylist()
        keys = list(zip(*(b.column(k).to_pylist() for k in range(1, width))))
        first = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or keys[k] != keys[first]:
                yield keys[first], lines[first:k]
                first = k


def _survey(sep: str):
    """Per split the states it ends in, and its first line where it begins the file."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_out, from_in = line_ends(sep)

        def row(key, ends, head):
            columns = [[key[0]], [key[1]], [key[2]], [ends[0]], [ends[1]], [head if key[1] == 0 else None]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SURVEY_TYPES)], _SURVEY_NAMES)

        current, ends, head = None, (0, 1), None
        for key, lines in _runs(batches, 4):
            if key != current:
                if current is not None:
                    yield row(current, ends, head)
                current, ends, head = key, (0, 1), lines[0]
            for line in lines:
                if '"' in line:
                    after = (int(from_out(line)), int(from_in(line)))
                    ends = after[ends[0]], after[ends[1]]
        if current is not None:
            yield row(current, ends, head)

    return survey


_SURVEY = "file string, at long, size long, from_out int, from_in int, head string"
_SURVEY_NAMES = [f.split()[0] for f in _SURVEY.split(", ")]
_SURVEY_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]


def _stitch(sep: str, pieces: bool, alone: bool = False):
    """Whole records of each split, or its pieces of records that reach across its borders. Where each file
    is one split (`alone`), a last record whose quote is never closed is whole as well."""

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from_out, from_in = line_ends(sep)

        def batch(out):
            columns = list(zip(*out)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES)], _PIECE_NAMES)

        current, held, inside, leading, header = None, [], False, False, False
        for key, lines in _runs(batches, 4):
            out = []
            if key != current:
                if held and (pieces or alone):
                    out.append((current[0], current[1], int(not leading), "\n".join(held)))
                # a split that begins inside quotes first ends the record of the one before
                current, held, inside, leading, header = key, [], bool(key[2]), bool(key[2]), key[1] == 0
            for line in lines:
                held.append(line)
                inside = from_in(line) if inside else from_out(line)
                if not inside:
                    if pieces == leading and not header:
                        record = "\n".join(held)
                        if record.strip("\r"):
                            out.append((current[0], current[1], 0, record))
                    held, leading, header = [], False, False
            if out:
                yield batch(out)
        if held and (pieces or alone):
            yield batch([(current[0], current[1], int(not leading), "\n".join(held))])

    return stitch


_PIECES = "file string, at long, opens int, record string"
_PIECE_NAMES = [f.split()[0] for f in _PIECES.split(", ")]
_PIECE_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.string()]


class SplitText:
    """Files of delimited text: their header lines, and records of any choice of them.

    Both passes must see the same splits, so the number that Spark derives their size from is set
    where it is not, and a split at another place stops the job.
    """

    def __init__(self, spark: SparkSession, path: str, sep: str):
        ship(spark)
        if spark.conf.get(_SPLITS, None) is None:
            spark.conf.set(_SPLITS, str(parallelism(spark)))
        self.sep = sep
        meta = lambda name: F.col(f"_metadata.{name}")
        self._lines = spark.read.option("lineSep", "\n").text(path).select(
            "value", meta("file_path").alias("file"), meta("file_block_start").alias("at"), meta("file_block_length").alias("length"), meta("file_size").alias("size")
        )
        found = cut(self._lines.select("value", "file", "at", "length").mapInArrow(_survey(sep), _SURVEY), "splits")
        self._found = found
        # the step between splits, one for all files
        self._step = found.filter("at > 0").agg(F.min("at")).first()[0]
        self._borders = None
        if self._step is not None:
            borders = cut(self._across(found), "borders")
            self._borders = None if borders.isEmpty() else borders

    @staticmethod
    def _across(found: DataFrame) -> DataFrame:
        """Splits with a record across a border: `(file, at, begins, ends)`, 1 where inside quotes."""
        own = Window.partitionBy("file").orderBy("at")
        before = own.rowsBetween(Window.unboundedPreceding, -1)
        turned = found.withColumn("turns", F.sum(F.when((F.col("from_out") == 1) & (F.col("from_in") == 0), 1).otherwise(0)).over(own))
        fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("state"), F.col("turns").alias("turns")))
        states = turned.select(
            "file", "at", "from_out", "from_in", F.last(fixed, ignorenulls=True).over(before).alias("base"), F.coalesce(F.lag("turns").over(own), F.lit(0)).alias("turns")
        )
        zero = lambda c: F.coalesce(c, F.lit(0))
        begins = ((zero(F.col("base.state")) + F.col("turns") - zero(F.col("base.turns"))) % 2).cast("int")
        ends = F.when(F.col("begins") == 1, F.col("from_in")).otherwise(F.col("from_out"))
        return states.withColumn("begins", begins).select("file", "at", "begins", ends.alias("ends")).filter("begins = 1 or ends = 1")

    def headers(self) -> dict[str, list[str]]:
        """Files by their first line."""
        rows = self._found.filter("head is not null").groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
        return {r["head"]: r["files"] for r in sorted(rows, key=lambda r: r["files"][0])}

    def records(self, header: str) -> DataFrame:
        """`(record)` of the files with that first line, which is left out; so are empty lines."""
        files = F.broadcast(self._found.filter((F.col("head") == header)).select("file"))
        step = self._step
        lines = self._lines.join(files, "file", "left_semi")
        if step is not None:
            moved = (F.col("at") % step != 0) | ((F.col("at") + F.col("length") < F.col("size")) & (F.col("length") != step))
            lines = lines.filter(F.when(moved, F.raise_error(F.lit("the splits of the text changed between two passes"))).otherwise(F.lit(True)))
        if self._borders is None:
            whole = lines.select("value", "file", "at", F.lit(0).alias("begins"))
            return whole.mapInArrow(_stitch(self.sep, False, alone=True), _PIECES).select("record")
        begun = lines.join(F.broadcast(self._borders.select("file", "at", "begins")), ["file", "at"], "left")
        shape = lambda df: df.select("value", "file", "at", F.coalesce("begins", F.lit(0)).alias("begins"))
        whole = shape(begun).mapInArrow(_stitch(self.sep, False), _PIECES).select("record")
        # pieces come from the few splits at such borders only
        pieces = shape(begun.filter("begins is not null")).mapInArrow(_stitch(self.sep, True), _PIECES)
        chain = F.sum("opens").over(Window.partitionBy("file").orderBy("at", "opens").rowsBetween(Window.unboundedPreceding, 0))
        joined = pieces.withColumn("chain", chain).groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("at", "opens", "record"))).alias("p"))
        return whole.union(joined.select(F.array_join(F.col("p.record"), "\n").alias("record")))
