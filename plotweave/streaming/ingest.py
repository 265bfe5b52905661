"""Incremental ingest: the rows of every new source file are added to the per-area table exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from plotweave.functions.clean import pad_code
from plotweave.sources.tables import AREA

BATCH = "batch"


def ingest_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType | str, area: str = AREA, sep: str = ";"
) -> StreamingQuery:
    """Take in all delimited files not seen before and stop.

    The stream's checkpoint remembers the files. A batch is written to folders of its own inside each
    area, so late rows of an area join those that are there, and a batch that is repeated after a
    failure replaces itself. The header of a file must name the columns in the order of the schema;
    a file that does not fails the batch.
    """
    reader = spark.readStream.schema(schema).option("sep", sep).option("header", "true").option("enforceSchema", "false")

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({area: pad_code(F.col(area)), BATCH: F.lit(number)})
        dealt = rows.hint("rebalance", area)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(area, BATCH).parquet(target)

    return reader.csv(source).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
