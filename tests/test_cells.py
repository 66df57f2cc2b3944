"""The index of cells against a search of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.harness import SF
from textloom.jobs import fixtures
from textloom.operators import cells, retrieval


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


def clustered(spark, n=3000, dims=16):
    """Vectors around 40 centres, a third of all rows one and the same vector."""
    r = np.random.default_rng(5)
    middle = r.normal(size=(40, dims))
    rows = [(i, (middle[0] if i % 3 == 0 else middle[i % 40] + 0.15 * r.normal(size=dims)).tolist(), ["text", "image"][i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>, modality string")


def test_exact_mode_and_recall_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 200)
    chunks = clustered(spark)
    asked = fixtures.vector_queries(chunks).select("query_id", "embedding")
    index = cells.build(chunks)
    assert index.rows.sum() == 3000 and index.parts.max() >= 5
    assert index.table.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 400
    found, opened = index.search(asked, 10)
    want = retrieval.dense_topk(asked, chunks, 10)
    assert hits(found) == hits(want)
    assert index.read_share(opened) < 0.6
    some, opened = index.search(asked, 10, probes=3)
    # A hit counts when its score is that of an exact hit of its rank or better: equal vectors are interchangeable.
    least = {r.query_id: r.score for r in want.where("rank = 10").collect()}
    good = sum(r.score >= least[r.query_id] for r in some.collect())
    assert good / want.count() >= 0.9


def test_allowed_modalities(spark):
    chunks = clustered(spark, 400)
    asked = fixtures.vector_queries(chunks).select("query_id", "embedding", F.when(F.col("query_id") % 40 == 0, F.array(F.lit("image"))).alias("allowed"))
    assert hits(cells.build(chunks).topk(asked, 300)) == hits(retrieval.dense_topk(asked, chunks, 300))


@pytest.mark.parametrize("probes", [None, 2])
def test_awkward_vectors(spark, probes):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [0.0, 2.0]), (7, [-1.0, 0.0]), (8, [])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").withColumn("cell", F.lit("mine"))
    asked = chunks.withColumnRenamed("chunk_id", "query_id")
    index = cells.build(chunks, cells=2)
    got = index.topk(asked, 5, probes)
    assert {r.query_id for r in got.collect()} == {1, 6, 7} == {r.chunk_id for r in got.collect()}
    assert index.topk(asked.limit(0), 5, probes).count() == 0
    assert cells.build(chunks.limit(0)).topk(asked, 5, probes).count() == 0


def test_recall_on_the_given_vectors(spark):
    chunks = fixtures.chunk_vectors(spark, SF)
    asked = fixtures.vector_queries(chunks).select("query_id", "embedding")
    want = {(q, c) for q, _, c, _ in hits(retrieval.dense_topk(asked, chunks, 10))}
    index = cells.build(chunks)
    # Tuned on other queries than those that are measured.
    others = chunks.where("chunk_id % 20 = 7").select(F.col("chunk_id").alias("query_id"), "embedding")
    probes = index.tuned(others, 10)
    got = {(q, c) for q, _, c, _ in hits(index.topk(asked, 10, probes=probes))}
    assert len(got & want) / len(want) >= 0.9
