"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to
one row per digest with map-side aggregation, anti-joined to the index without
moving the index, and what is new is appended. What the index says about the batch's
digests is looked up the same way, so nothing else of the index is ever read into a
join or broadcast. Only built-in expressions are used.

Defined results: a null text counts as empty; texts are equal when they are after
deleting every space, tab, line feed, vertical tab, form feed and carriage return.
Of equal texts the row with the most code points in the original stays, then the
smallest doc_id (a null doc_id comes last). Rows that repeat a doc_id and its text
are one document and share its decision. A group's size counts the copies in all
batches up to and including the one that is decided. An empty table gives an empty result.
Other columns, whatever their names, pass through ``drop_copies`` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.rows import without_rows
from textloom.skew import join_counted
from textloom.storage import materialize, new_path, read_table

_WHITE = "[\\x20\\x09-\\x0D]+"
_NO_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _WHITE, "")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def _code_points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest (SHA-256 of the normalised text) and code points of every row."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        _digest(F.col(text)).alias("digest"),
        _code_points(F.col(text)).alias("code_points"),
    )


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and the size of the group.

    The order (most code points, then smallest doc_id) is a maximum over a pair, so
    hot digests shrink to one row per task before the shuffle.
    """
    order = F.struct(F.col("code_points"), (-F.coalesce("doc_id", F.lit(_NO_ID))).alias("neg_id"), F.col("doc_id"))
    return (
        rows.groupBy("digest")
        .agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("copies"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.code_points").alias("keep_code_points"), "copies")
    )


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far.

    A digest has one row that says which document stays, from the batch that brought it
    (``first``), and one row with its count from each later batch. Give the ``path`` of an
    earlier index to continue it; the metastore entry is made anew for each session from
    the bucket specification.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"textloom_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, first BOOLEAN, keep_id BIGINT, keep_code_points BIGINT, copies BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def read(self) -> DataFrame:
        """digest, keep_id, keep_code_points, copies (in all batches): one row per digest; the index is not moved."""
        kept = F.max(F.when(F.col("first"), F.struct("keep_id", "keep_code_points"))).alias("kept")
        return self.rows().groupBy("digest").agg(kept, F.sum("copies").alias("copies")).select("digest", "kept.keep_id", "kept.keep_code_points", "copies")

    def append(self, rows: DataFrame) -> DataFrame:
        """Adds the digests of a batch; returns the batch's digests as the index has them then.

        Those that the index lacks are found by a sort-merge anti-join. A digest that is
        already there keeps its earlier document: an index never takes back a decision on
        a batch that has gone out. ``in_batch`` counts the copies in this batch.
        """
        batch = materialize(representatives(rows), "batch-digests")
        known = self.rows().where("first").select("digest")
        fresh = batch.hint("merge").join(known.hint("merge"), "digest", "left_anti").withColumn("first", F.lit(True))
        again = batch.hint("merge").join(known.hint("merge"), "digest", "left_semi").select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("keep_code_points"), "copies", F.lit(False).alias("first"))
        (
            fresh.unionByName(again).select("digest", "first", "keep_id", "keep_code_points", "copies").repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)
        return batch.select("digest", F.col("copies").alias("in_batch")).hint("merge").join(self.read().hint("merge"), "digest")

    def forget(self) -> None:
        """Removes the session's metastore entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _decided(docs: DataFrame, index: DigestIndex | None) -> DataFrame:
    """doc_id, digest, code_points, keep_id, copies, kept of every row."""
    rows = materialize(digests(docs), "digests")
    used = index or DigestIndex(docs.sparkSession)
    # Only the batch's digests go on, and its own counts tell which of them are hot.
    found = materialize(used.append(rows), "batch-decisions")
    if index is None:
        used.forget()
    kept = F.expr("doc_id <=> keep_id AND code_points = keep_code_points").alias("kept")
    return join_counted(rows, found, "digest", "in_batch", rows.count()).select("doc_id", "digest", "code_points", "keep_id", "copies", kept)


def exact_groups(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs, index).select("doc_id", "keep_id", F.col("copies").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row is recognised by its doc_id, text digest and code points, which also settle
    whether it is kept. Digests are shuffled. Texts are not where the losers are few, and
    else only those that a filter of the losers' keys does not rule out.
    """
    losers = _decided(docs, index).where(~F.col("kept")).select("doc_id", "digest", "code_points")
    return without_rows(docs, [F.col("doc_id").cast("long"), _digest(F.col("text")), _code_points(F.col("text"))], losers)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
