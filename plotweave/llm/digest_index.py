r"""Exact deduplication by a persistent digest index (operator 11), in DataFrame functions only.

Texts are equal if they are identical after each run of `[\x20\x09-\x0D]` is replaced by one space. The index
is a catalog table with one row per different text, `(digest, keep_id, batch)`: bucketed by the SHA-256 digest and
sorted by it inside the buckets. A batch of documents is reduced to one row per digest (map-side first), then
sort-merge anti-joined with the index, which is not shuffled for it; what is new is appended. A second
table of the same layout, `(digest, n, batch)`, counts the rows that each batch had of a digest, so that the size
of a group is a sum without a shuffle. Of a text that is already known, the row that came first stays; inside
a batch it is the row with the smallest id.

A group of copies is one row by the time it is shuffled. Only the last step, which hands each document the row
that stays, has rows of one group side by side; there groups that hold more than one in 4,096 rows are broadcast
(fewer than 4,096 of them), the others joined by a shuffle.

Adding a batch again after a failure appends what is missing and nothing twice: rows of the index are kept
apart by digest, counts by batch.

Defined cases: a null text is empty; a null id comes after all others, as the id that stays only if there is no other; of rows
equal in id and text one stays; an empty batch adds nothing; columns beside `doc_id` and `text` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotweave.llm.hot import join_groups
from plotweave.session import cut, parallelism, scratch_path, scratch_scope, settle

SPACE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 of a text with its white space normalised, as 32 bytes."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(SPACE), F.lit(" "))
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def digested(docs: DataFrame) -> DataFrame:
    """`(doc_id, digest, _row)` per document, written once: the texts are read here only."""
    rows = docs.select(F.col("doc_id"), text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("_row"))
    return cut(rows, "digests")


class DigestIndex:
    """The index under a table name of the catalog; it is made with the first batch.

    `buckets` is fixed when the tables are made (default: the session's shuffle partitions, at least one per
    core). `location` is a folder that all executors share; without one the tables lie in the warehouse.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, location: str | None = None):
        self.spark, self.name, self.location = spark, name, location
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), parallelism(spark))

    @property
    def counts(self) -> str:
        return f"{self.name}_counts"

    def _append(self, rows: DataFrame, table: str) -> None:
        out = rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        if self.location:
            out = out.option("path", f"{self.location.rstrip('/')}/{table.rsplit('.', 1)[-1]}")
        out.saveAsTable(table)

    def _has(self, table: str) -> bool:
        return self.spark.catalog.tableExists(table)

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Take in a batch as `digested` returns it; `(doc_id, digest, kept)` for each of its rows."""
        # the struct orders ids with null last, and rows of equal id by their number
        least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
        own = cut(rows.groupBy("digest").agg(least.alias("_first"), F.count("*").alias("n")), "batch-digests")
        new = own.select("digest", F.col("_first.id").alias("keep_id"), F.lit(batch).alias("batch"))
        if self._has(self.name):
            new = new.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")
        # dealt like the buckets: each task writes one file
        self._append(new.repartition(self.buckets, "digest"), self.name)
        counted = own.select("digest", "n", F.lit(batch).alias("batch"))
        if not self._has(self.counts) or self.spark.table(self.counts).filter(F.col("batch") == batch).isEmpty():
            self._append(counted.repartition(self.buckets, "digest"), self.counts)
        mine = self.spark.table(self.name).filter(F.col("batch") == batch).select("digest")
        stays = own.join(mine.hint("merge"), "digest", "left_semi").select(F.col("_first.row").alias("_row"), F.lit(True).alias("_stays"))
        return rows.join(stays, "_row", "left").select("doc_id", "digest", F.coalesce("_stays", F.lit(False)).alias("kept"))

    def groups(self) -> DataFrame:
        """`(digest, keep_id, group_size)` of everything added so far, without a shuffle."""
        sizes = self.spark.table(self.counts).groupBy("digest").agg(F.sum("n").alias("group_size"))
        return self.spark.table(self.name).select("digest", "keep_id").join(sizes.hint("merge"), "digest")

    def compact(self, name: str, location: str | None = None) -> DigestIndex:
        """The same index under another name, with one sorted file per bucket and a single batch `base`.

        The tables grow by a file per bucket and batch; a batch that failed has to be added again before.
        """
        out = DigestIndex(self.spark, name, self.buckets, location)
        base = F.lit("base").alias("batch")
        sizes = self.spark.table(self.counts).groupBy("digest").agg(F.sum("n").alias("n"))
        out._append(self.spark.table(self.name).select("digest", "keep_id", base).repartition(self.buckets, "digest"), out.name)
        out._append(sizes.select("digest", "n", base).repartition(self.buckets, "digest"), out.counts)
        return out

    def drop(self) -> None:
        """Forget the index; tables in the warehouse are deleted, those at a location stay as files."""
        for table in (self.name, self.counts):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def exact_copies(rows: DataFrame, index: DigestIndex, batches: list[tuple[str, Column]]) -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, digest)` of rows that are added batch by batch."""
    judged = None
    for label, chosen in batches:
        part = cut(index.add(rows.filter(chosen), label), "judged")
        judged = part if judged is None else judged.unionByName(part)
    return join_groups(judged, cut(index.groups(), "groups"), "digest", "group_size", judged.count())


def op11_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the row that stays for them.

    They come in two batches, ids up to the middle first, so that the second one meets an index that knows much of it.
    """
    with scratch_scope(spark):
        rows = digested(spark.read.parquet(f"{folder}/documents.parquet"))
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        place = scratch_path(spark, "digest-index")
        index = DigestIndex(spark, f"plotweave_{place[-32:]}", location=place)
        try:
            early = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
            judged = exact_copies(rows, index, [("early", early), ("late", ~early)])
            out = judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
            return settle(out, "exact-copies", also=[place])
        finally:
            index.drop()


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)
"""
