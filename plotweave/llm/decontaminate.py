"""Benchmark decontamination (operator 9), in DataFrame functions only: which documents hold test items.

A document holds an item if it contains at least `share` of the item's different word shingles. Words are
runs of letters and digits in lower case; a shingle is five words, or all words of an item with fewer.

Items are partitioned by size (number of different shingles, powers of two). From each item a bottom-k
MinHash sketch is taken: its k shingles of least hash, k depending on the partition alone:
k = floor((1 - share) * most) + 1, where `most` is the largest size in the partition. A document that
holds the item lacks at most floor((1 - share) * size) of its shingles, so it holds at least one of any k:
the search loses nothing, however long the document, while it looks for a fifth of the shingles only.
Documents hit by a sketch are then compared with the whole items, exactly.

The sketches are broadcast if their written size is below a bound, else joined by a shuffle on the hash;
AQE splits shingles that very many documents share. Document shingles are not shuffled in the first case.
No pairs of documents are made; pairs (document, item) exist where a sketch shingle occurs in both.

Defined cases: null and empty texts hold nothing, and an item without words is held by nothing; items that
are equal are separate items, also if they have the same id or none; a repeated document gets a row per row
of it. Rows equal in id and text are compared once, their results joined back to each of them; empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plotweave.session import cut

WORD = r"[\p{L}\p{N}]+"
WIDTH = 5
SHARE = 0.8
# Rows of an index that may be broadcast: 16 bytes each, so 32 MB.
BROADCAST_ROWS = 2_000_000


def _words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of `width` words; the width is part of the hash."""
    part = lambda i: F.xxhash64(F.lit(width), *[F.get(words, i + k) for k in range(width)])
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), part)).otherwise(F.array().cast("array<bigint>"))


def _key(docs: DataFrame) -> list[Column]:
    """Rows are told apart by id and text."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_digest")]


def item_shingles(items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """`(item, row, copies, width, size, hash, sketched)`: the shingles of all items, those of the sketches marked.

    Items equal in id and text are one `row` with the number of its copies.
    """
    keyed = items.select(F.col("item_id").alias("item"), F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("row"), F.col("text"))
    single = keyed.groupBy("item", "row").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    words = single.select("item", "row", "copies", _words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    own = F.least(F.size("w"), F.lit(width))
    found = None
    for k in range(1, width + 1):
        found = F.when(own == k, _shingles(F.col("w"), k)) if found is None else found.when(own == k, _shingles(F.col("w"), k))
    # the order of the sketch is a hash of its own, so that it is independent of the values
    ordered = F.array_sort(F.transform(F.array_distinct(found), lambda h: F.struct(F.xxhash64(F.lit("min"), h).alias("o"), h.alias("h"))))
    sized = words.select("item", "row", "copies", own.alias("width"), ordered.alias("hashes")).withColumn("size", F.size("hashes"))
    sized = sized.withColumn("_class", F.floor(F.log2(F.col("size").cast("double"))))
    most = sized.groupBy("_class").agg(F.max("size").alias("_most"))
    # in whole numbers, as 0.2 * 5 is not quite 1
    lacks = lambda n: n - F.ceil(F.round(n * F.lit(share), 9))
    rows = sized.join(most, "_class").withColumn("_k", lacks(F.col("_most")) + 1)
    return rows.select("item", "row", "copies", "width", "size", "_k", F.posexplode("hashes").alias("_at", "_h")).select(
        "item", "row", "copies", "width", "size", F.col("_h.h").alias("hash"), (F.col("_at") < F.col("_k")).alias("sketched")
    )


def _exploded(docs: DataFrame, widths: list[int]) -> DataFrame:
    """`(_id, _digest, doc_id, hash)` for the different shingles of each document, for the widths that items have."""
    rows = docs.select(F.col("doc_id"), *_key(docs), _words(F.col("text")).alias("_w"))
    all_widths = F.array_distinct(F.concat(*[_shingles(F.col("_w"), k) for k in widths]))
    return rows.select("doc_id", "_id", "_digest", F.explode(all_widths).alias("hash"))


def _sized(index: DataFrame) -> DataFrame:
    return F.broadcast(index) if index.count() <= BROADCAST_ROWS else index


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """`(doc_id, item_id, n_shared, n_item, containment)` plus the row key, for every row of a document that holds an item."""
    index = cut(item_shingles(items, width, share), "items")
    widths = sorted(r["width"] for r in index.select("width").distinct().collect())
    sketch = index.filter("sketched").select("hash").distinct()
    found = _exploded(docs, widths or [width]).join(_sized(sketch), "hash")
    hit = cut(found.select("_id", "_digest").distinct(), "hits")
    # only documents with a hit are read again; each is compared with whole items
    again = docs.select(F.col("doc_id"), F.col("text"), *_key(docs)).join(hit, ["_id", "_digest"], "left_semi")
    shared = _exploded(again, widths or [width]).join(_sized(index), "hash")
    counts = shared.groupBy("_id", "_digest", "item", "row", "copies", "size").agg(F.countDistinct("hash").alias("n_shared"))
    part = F.col("n_shared") / F.col("size")
    kept = cut(counts.filter(F.round(part, 9) >= share), "held")
    # a row for each row of the document and each copy of the item
    rows = again.select("doc_id", "_id", "_digest").join(kept, ["_id", "_digest"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("doc_id", F.col("item").alias("item_id"), "n_shared", F.col("size").cast("long").alias("n_item"), F.round(part, 9).alias("containment"), "_id", "_digest")


def op9_decontamination(spark, folder: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return contained_items(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).drop("_id", "_digest")


def decontamination_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    held = cut(contained_items(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).select("_id", "_digest").distinct(), "held")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *_key(docs))
    return rows.join(held, ["_id", "_digest"], "left_anti").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


OP9_SQL = r"""
WITH i AS (
  SELECT item_id, row_number() OVER () AS row, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), s AS (
  SELECT DISTINCT item_id, row, least(len(w), 5) AS width, array_to_string(w[k : k + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS k FROM i WHERE len(w) > 0)
), n AS (SELECT row, count(*) AS size FROM s GROUP BY row),
d AS (SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
v AS (SELECT DISTINCT width FROM s),
x AS (
  SELECT DISTINCT doc_id, doc, width, array_to_string(w[k : k + width - 1], ' ') AS g
  FROM (SELECT doc_id, doc, width, w, unnest(range(1, len(w) - width + 2)) AS k FROM d, v WHERE len(w) >= width)
)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(size) AS n_item, round(count(*) / any_value(size), 9) AS containment
FROM x JOIN s USING (width, g) JOIN n USING (row) GROUP BY doc_id, doc, item_id, row
HAVING round(count(*) / any_value(size), 9) >= 0.8
"""
