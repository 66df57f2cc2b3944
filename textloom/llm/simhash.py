"""Near-duplicates by SimHash fingerprints that meet in the middle of their distance.

A fingerprint has 64 bits; each is set if most of a text's shingles have it set in their
hash. Fingerprints at most ``radius`` bits apart are linked. Every distinct fingerprint
is sent to all variants of it within half the radius, so two that are linked meet at
some variant, and are apart by the radius at most if they do. Spark shuffles on
variants; a variant has no more visitors than it has variants itself (65 for a radius of
2), however many documents share a fingerprint, as copies are one fingerprint with a count.
Visitors of a variant are linked to the least of them, pairs are deduplicated and verified,
and links make components. ``links`` lists all pairs instead.

Defined results: A-Z count as a-z; words end at spaces and at 0x09-0x0D; with fewer words
than a shingle has, all words are one shingle. A null, empty or white text has no words and
the fingerprint zero, which is linked like any other. A component has the smallest doc_id
of its documents; rows with a null doc_id belong to one, but give it no id. Repeated rows
have the same result each. Empty tables give empty results. Columns other than doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.components import components
from textloom.skew import join_counted
from textloom.storage import materialize, read_table

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Bytes of a text whose words are held as objects at a time.
BLOCK = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes, overlap: int, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, a block at a time; each block begins with the last ``overlap`` words before it."""
    at, before = 0, []
    while at < len(text):
        # A block ends behind a word.
        behind = _WHITE.search(text, at + block)
        end = behind.start() if behind else len(text)
        words = before + text[at:end].split()
        at = end
        yield words
        before = words[-overlap:] if overlap else []


def fingerprint(text: str | None, shingle: int = SHINGLE, block: int = BLOCK) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    ones, n, last = np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode().lower(), shingle - 1, block):
        last = words
        if len(words) >= shingle:
            runs = zip(*(words[i:] for i in range(shingle)), strict=False)
            hashes = np.array([xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs], "<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
    if not n and last:
        # Fewer words than a shingle has.
        return xxhash.xxh64_intdigest(b" ".join(last), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed integer) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, fp long")


def _masks(distance: int) -> list[int]:
    """All differences of at most so many bits, as signed integers."""
    every = [sum(1 << i for i in bits) for n in range(distance + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in every]


def variants(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """variant, fp: each fingerprint at all variants within half the radius, rounded up."""
    masks = F.array(*map(F.lit, _masks((radius + 1) // 2)))
    return nodes.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")


def _near(a: str, b: str, radius: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def stars(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: verified links that join what all links join. Visitors of a variant are linked to the least of them.

    For an even radius all visitors are near each other. For an odd one they may be one bit
    further apart; all their pairs are tried then.
    """
    if radius % 2:
        return links(nodes, radius)
    least = F.min("fp").over(Window.partitionBy("variant"))
    met = variants(nodes, radius).withColumn("a", least).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return met.where(_near("a", "b", radius))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b, distance: every pair of distinct fingerprints at most ``radius`` bits apart, once, a < b."""
    sent = variants(nodes, radius)
    met = sent.select("variant", F.col("fp").alias("a")).join(sent.select("variant", F.col("fp").alias("b")), "variant").where("a < b")
    return met.select("a", "b").distinct().where(_near("a", "b", radius)).withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    roots = components(stars(nodes, radius))
    rooted = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    labels = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    # A large component's fingerprints stay where they are, as do the copies of one.
    known = join_counted(rooted, labels, "root", "members", nodes.count()).select("fp", "component_id", "copies")
    return join_counted(rows, materialize(known, "labels"), "fp", "copies", rows.count()).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
