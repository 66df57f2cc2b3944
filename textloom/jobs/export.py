"""Chunks as JSON lines, documents as Markdown: what downstream loaders read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.chunking import render_markdown

# The fields of a chunk's payload. Images are left out on purpose.
PAYLOAD = (
    "chunk_id", "doc_id", "source_file", "page", "element_types", "modality", "text", "latex", "html", "is_atomic", "token_count",
    "section_path", "cross_refs", "graph_json", "concept_tags", "confidence", "caption_json", "enriched_text",
)


def payload(chunks: DataFrame) -> Column:
    """A chunk's fields as one JSON text; fields that the table lacks, and nulls, are null in it."""
    return F.to_json(F.struct(*[(F.col(c) if c in chunks.columns else F.lit(None).cast("string")).alias(c) for c in PAYLOAD]), {"ignoreNullFields": "false"})


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON text a line."""
    chunks.select(payload(chunks).alias("value")).write.mode("overwrite").text(path)


def write_markdown(elements: DataFrame, path: str) -> None:
    """doc_id and Markdown of every document as JSON lines, which keep line breaks."""
    render_markdown(elements).write.mode("overwrite").json(path)
