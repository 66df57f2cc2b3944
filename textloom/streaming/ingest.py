"""Incremental ingestion: new documents of a stream become chunks of a collection, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.chunking import chunk
from textloom.operators.store import Collection, new_documents
from textloom.sources.text import text_scan
from textloom.storage import materialize

CHUNKS = "doc_id string, chunk_seq int, chunk_id string, modality string, element_types array<string>, text string, page int, confidence double, section_path array<string>, is_atomic boolean, token_count int"


def ingest_batch(docs: DataFrame, collection: Collection, force: bool = False) -> None:
    """Chunks documents (doc_id, text) that the collection lacks and upserts them.

    Only additions to the collection that may hold the documents are read. A batch that is repeated after
    a failure adds nothing: ids are derived, not drawn. A batch of nothing new adds nothing either.
    """
    named = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    held = named if force else materialize(collection.existing(named.select(named["doc_id"].alias("id")).distinct()), "existing-ids").toDF("doc_id")
    fresh = new_documents(named, held, force=force)
    chunks = materialize(chunk(text_scan(fresh)), "new-chunks")
    if not chunks.isEmpty():
        collection.upsert(chunks)


def ingest_stream(docs: DataFrame, collection: Collection, checkpoint: str) -> StreamingQuery:
    """Starts a query that ingests what there is and ends."""
    return docs.writeStream.foreachBatch(lambda batch, _: ingest_batch(batch, collection)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_collection(spark: SparkSession, path: str) -> Collection:
    return Collection(spark, path, CHUNKS)
