"""Vectors stored by cells of the sphere, and searches that open only the cells they need.

Cells are fitted on at most SAMPLE vectors (spherical k-means); then every vector is
assigned to its nearest cell, and the table is written with the cell as partition. Each
cell keeps its radius, the greatest angle between its centre and one of its vectors. By
the triangle inequality of angles no vector of a cell is nearer to a query than the angle
to the centre less the radius, so an exact search opens the nearest cells, learns the
score of rank k, and then opens only cells that could still reach it. An approximate
search opens a stated number of cells and no more; ``tuned`` finds the number that a
stated recall takes.

Cells that hold many vectors are written in parts of about PART_ROWS rows, and a search
joins parts, so no task gets a whole hot cell. What is known of the cells (centre, radius,
rows) is bounded by MAX_CELLS and travels with the tasks.

Defined results: vectors that are null, have a null or NaN in them, have no length, a length
that is not finite or another number of dimensions than the sample are in no result, as chunks or as queries.
Ids of queries and chunks are unique; an empty table gives no hits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.vectors import dot
from textloom.operators import nearest
from textloom.operators.retrieval import BROADCAST_ROWS, ranked
from textloom.storage import materialize, maybe_broadcast, new_path

#: Vectors that cells are fitted on, at most; cells, at most; rows of one part of a cell.
SAMPLE, MAX_CELLS, PART_ROWS = 20_000, 4_096, 50_000
_STEPS, _SEED = 12, 42
#: Scores have nine digits; angles and bounds get this much slack.
_SLACK = 1e-6


def _matrix(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows of length one."""
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of at most ``cells`` cells by spherical k-means on rows of length one."""
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.random.default_rng(_SEED).permutation(len(distinct))[:cells]]
    for _ in range(_STEPS):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        # A cell that lost its vectors keeps its place.
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _usable(rows: DataFrame, dimensions: int | None = None) -> DataFrame:
    e = F.col("embedding")
    sized = e.isNotNull() & (F.size(e) == dimensions) if dimensions else e.isNotNull()
    return rows.where(sized & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & (dot(e, e) > 0) & (dot(e, e) < float("inf")))


@dataclass
class CellIndex:
    """A written index; ``radii`` in radians, ``rows`` and ``parts`` by cell."""

    table: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    rows: np.ndarray
    parts: np.ndarray

    def _plan(self, limit: int, probes: int | None) -> Column:
        """Per query the cells in order of nearness: (cell, parts, first, bound)."""
        centres, radii, sizes, parts = self.centres, self.radii, self.rows, self.parts

        @F.pandas_udf("array<struct<cell:int,parts:int,first:boolean,bound:double>>")
        def plan(vectors: pd.Series) -> pd.Series:
            out = []
            for angles in np.arccos(np.clip(_matrix(vectors) @ centres.T, -1, 1)):
                order = np.argsort(angles, kind="stable")[:probes]
                before = np.cumsum(sizes[order]) - sizes[order]
                bounds = np.cos(np.maximum(0, angles - radii - _SLACK))
                out.append([(int(c), int(parts[c]), probes is not None or bool(b < limit), float(bounds[c])) for c, b in zip(order, before, strict=True) if sizes[c]])
            return pd.Series(out)

        return plan("q")

    def _scored(self, routes: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
        """query_id, chunk_id, score: what may be among the best ``limit`` of the routed queries in their cells, from ``worst`` on where routes have it."""
        # At most MAX_CELLS numbers; they become the partitions that the scan lists.
        opened = [r.cell for r in routes.select("cell").distinct().collect()]
        blocks = max(1, -(-asked.count() // nearest.QUERY_BLOCK))
        floor = [F.col("worst").alias("floor")] if "worst" in routes.columns else []
        each = routes.select("query_id", "cell", *floor, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        told = each.join(maybe_broadcast(asked, BROADCAST_ROWS), "query_id").withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        held = self.table.where(F.col("cell").isin(opened)).withColumnsRenamed({"embedding": "v", "size": "v_size"})
        held = held.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = nearest.best_of_blocks(told, held, ["cell", "part", "q_block"], limit)
        return found.withColumn("score", F.round("score", 9))

    def search(self, queries: DataFrame, limit: int, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Hits (query_id, chunk_id, score, rank), and the opened cells (query_id, cell).

        Without ``probes`` the hits are those of ``retrieval.dense_topk``. Where queries have
        ``allowed``, null or a list, only chunks of these modalities count.
        """
        e = F.col("embedding")
        usable = _usable(queries, self.centres.shape[1]).repartition("query_id")
        asked = materialize(usable.select("query_id", e.alias("q"), F.sqrt(dot(e, e)).alias("q_size"), *(["allowed"] if "allowed" in queries.columns else [])), "asked")
        routes = materialize(asked.select("query_id", F.explode(self._plan(limit, probes)).alias("r")).select("query_id", "r.*"), "routes")
        first = routes.where("first")
        hits = materialize(ranked(self._scored(first, asked, limit), limit), "first-hits")
        if probes is not None:
            return hits, first.select("query_id", "cell")
        worst = hits.where(F.col("rank") == limit).select("query_id", F.col("score").alias("worst"))
        rest = routes.where("not first").join(worst, "query_id", "left").where(F.col("worst").isNull() | (F.col("bound") >= F.col("worst") - _SLACK))
        rest = materialize(rest, "more-routes")
        more = self._scored(rest, asked, limit)
        return ranked(hits.select("query_id", "chunk_id", "score").unionByName(more), limit), first.unionByName(rest.drop("worst")).select("query_id", "cell")

    def topk(self, queries: DataFrame, limit: int, probes: int | None = None) -> DataFrame:
        return self.search(queries, limit, probes)[0]

    def tuned(self, queries: DataFrame, limit: int, recall: float = 0.95) -> int:
        """The least number of probes with which these queries, searched exactly, find a share ``recall`` of their hits.

        For other queries this is an estimate: give a few hundred that stand for them.
        """
        at = materialize(_usable(queries, self.centres.shape[1]).select("query_id", F.col("embedding").alias("q")), "tuning")
        order = at.select("query_id", F.posexplode(self._plan(limit, len(self.centres))).alias("at", "r")).select("query_id", "r.cell", "at")
        hits = materialize(self.topk(queries, limit), "tuning-hits").select("query_id", "chunk_id")
        placed = self.table.select("chunk_id", "cell").join(maybe_broadcast(hits, BROADCAST_ROWS), "chunk_id")
        found = placed.join(order, ["query_id", "cell"]).agg(F.percentile("at", recall)).first()[0]
        return math.ceil(found or 0) + 1

    def read_share(self, opened: DataFrame) -> float:
        """Share of all pairs of a query and a vector that lie in opened cells."""
        sizes = [int(n) for n in self.rows]
        per_cell = opened.groupBy("cell").count().collect()  # at most MAX_CELLS rows
        n_queries = opened.select("query_id").distinct().count()
        return sum(sizes[r.cell] * r["count"] for r in per_cell) / max(1, n_queries * sum(sizes))


def build(chunks: DataFrame, path: str | None = None, cells: int | None = None) -> CellIndex:
    """Writes the index of ``chunks`` (chunk_id, embedding, modality if there is one); every usable row is in it."""
    spark = chunks.sparkSession
    path = path or new_path(spark, "cells")
    kept = chunks.select("chunk_id", "embedding", *(["modality"] if "modality" in chunks.columns else []))
    taken = _usable(kept).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").collect()
    dimensions = len(taken[0].embedding) if taken else 1
    sample = [r.embedding for r in taken if len(r.embedding) == dimensions]
    kept = _usable(kept, dimensions)
    wanted = min(MAX_CELLS, cells or math.ceil(math.sqrt(kept.count())) or 1)
    centres = fit(_matrix(pd.Series(sample)), wanted) if sample else np.ones((1, dimensions)) / math.sqrt(dimensions)

    @F.pandas_udf("cell int, angle double")
    def assigned(vectors: pd.Series) -> pd.DataFrame:
        found = _matrix(vectors) @ centres.T
        cell = found.argmax(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "angle": np.arccos(np.clip(found[np.arange(len(cell)), cell], -1, 1))})

    e = F.col("embedding")
    placed = materialize(kept.withColumn("at", assigned("embedding")).select(*kept.columns, F.sqrt(dot(e, e)).alias("size"), "at.cell", "at.angle"), "placed")
    radii, rows = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # at most MAX_CELLS rows
        rows[r.cell], radii[r.cell] = r.n, r.radius
    parts = np.maximum(1, -(-rows // PART_ROWS))
    known = F.broadcast(spark.createDataFrame([(i, int(n)) for i, n in enumerate(parts)], "cell int, parts int"))
    dealt = placed.drop("angle").join(known, "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")
    dealt.repartition("cell", "part").write.partitionBy("cell").parquet(path)
    schema = dealt.select(*(c for c in dealt.columns if c != "cell"), "cell").schema
    return CellIndex(spark.read.schema(schema).parquet(path), centres, radii, rows, parts)
