"""Token counts from flat token files, found by a scan for end-of-document ids.

A token file is nothing but little-endian ids of one width; a separator closes each
document and no index tells where. Files are cut into blocks of equal size. A task
searches its blocks for the separator with one vector comparison each. A prefix
scan over the blocks of a file (how many separators came before, and where the
last one was) then numbers the documents and stitches those that cross blocks,
however many blocks they span.

Defined results: two separators in a row are an empty document; ids after the last
separator are one more document; an empty file has none; a file whose size is no
multiple of the width is refused. Null texts are empty, a null doc_id stays null, rows
that repeat are counted each for itself, an empty table gives an empty result. Columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.files import committed, filesystem
from textloom.llm.tokens import encode
from textloom.storage import materialize, maybe_broadcast, new_path, read_table

#: Bytes of a block.
BLOCK_BYTES = 1 << 22
#: Blocks counted to be at most so many are broadcast with what the scan found.
BROADCAST_ROWS = 500_000


def write_token_files(docs: DataFrame, path: str, ranks: str, separator: int, width: int = 2) -> DataFrame:
    """Writes one flat file per partition; returns (shard, ordinal, doc_id), which holds no token positions."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ordinal = TaskContext.get().partitionId(), 0
        batch = next(batches, None)
        if batch is None:
            return
        with committed(f"{path}/{shard:08d}.tokens") as out:
            while batch is not None:
                for text in batch["text"]:
                    ids = np.append(encode(text.as_py(), ranks), separator)
                    if len(ids) and ids.max() >> (8 * width):
                        raise ValueError(f"an id does not fit into {width} bytes")
                    out.write(ids.astype(f"<u{width}").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(ordinal, ordinal + n)), batch["doc_id"]], ["shard", "ordinal", "doc_id"])
                ordinal += n
                batch = next(batches, None)

    return materialize(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task, "shard long, ordinal long, doc_id long"), "token-docs")


def blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """shard, file, size, begin: the blocks of all token files, from the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(path).select("path", F.col("length").alias("size"))
    return files.where("size > 0").select(
        F.regexp_extract("path", r"(\d+)\.tokens$", 1).cast("long").alias("shard"),
        F.col("path").alias("file"),
        "size",
        F.explode(F.expr(f"sequence(0L, size - 1, {block_bytes}L)")).alias("begin"),
    )


def scan(table: DataFrame, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Separators of each block as token positions in the file; the end of a file closes an open document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["size"] % width or block_bytes % width:
                    raise ValueError(f"{row['file']}: its size is no multiple of {width}")
                system, name = filesystem(row["file"])
                with system.open_input_file(name) as source:
                    ids = np.frombuffer(source.read_at(min(block_bytes, row["size"] - row["begin"]), row["begin"]), f"<u{width}")
                found = np.flatnonzero(ids == separator) + row["begin"] // width
                if row["begin"] + ids.nbytes == row["size"] and ids[-1] != separator:
                    found = np.append(found, row["size"] // width)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]]), pa.array([row["begin"]]), pa.array([found.tolist()], pa.list_(pa.int64()))], ["shard", "begin", "found"])

    return table.mapInArrow(task, "shard long, begin long, found array<long>")


def token_counts(found: DataFrame) -> DataFrame:
    """shard, ordinal, start, n_tokens of every document, from the written separators of the blocks.

    The scan over a file's blocks sees two numbers a block; separators stay with theirs.
    """
    before = Window.partitionBy("shard").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.select("shard", "begin", F.size("found").alias("n"), F.try_element_at("found", F.lit(-1)).alias("end"))
    scanned = ends.select("shard", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), F.coalesce(F.max("end").over(before), F.lit(-1)).alias("last"))
    stitched = found.join(maybe_broadcast(materialize(scanned, "scanned-blocks"), BROADCAST_ROWS), ["shard", "begin"])
    each = stitched.select("shard", "earlier", "last", "found", F.posexplode("found").alias("at", "stop"))
    start = F.when(F.col("at") == 0, F.col("last")).otherwise(F.expr("found[at - 1]")) + 1
    return each.select("shard", (F.col("earlier") + F.col("at")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))


def count_files(spark: SparkSession, path: str, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of the flat token files in a folder."""
    listed = materialize(blocks(spark, path, block_bytes), "token-blocks")
    tasks = max(1, min(listed.count(), 4 * spark.sparkContext.defaultParallelism))
    return token_counts(materialize(scan(listed.repartition(tasks, "shard", "begin"), separator, width, block_bytes), "separators"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents as flat token files, then counts each document's tokens from the files alone."""
    import public_tokenizers as public

    path = new_path(spark, "token-files")
    known = write_token_files(read_table(spark, sf_dir, "documents"), path, public.path("byte_bpe_multi_50k.tiktoken"), 50256)
    if known.isEmpty():
        return known.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "shard", F.col("ordinal").alias("start"))
    return known.join(count_files(spark, path, 50256), ["shard", "ordinal"]).select("doc_id", "n_tokens", "shard", "start")
