"""Scores by blocks against every pair worked out by itself."""

import math

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import graphs, nearest, retrieval


def brute(queries, chunks, limit):
    """The best hits; queries (id, vector, allowed), chunks (id, vector, modality)."""
    out = []
    for q, a, allowed in queries:
        found = []
        for c, b, modality in chunks:
            if a is None or b is None or None in a or None in b or (allowed is not None and modality not in allowed):
                continue
            # As Spark compares: NaN is greater than any number.
            size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            if size > 0 or math.isnan(size):
                score = None if len(a) != len(b) else sum(x * y for x, y in zip(b, a)) / size
                found.append(((-math.inf, c) if score is not None and math.isnan(score) else (math.inf, c) if score is None else (-round(score, 9), c)))
        out += [(q, c, n) for n, (_, c) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out)


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 9)
    monkeypatch.setattr(nearest, "CHUNK_BLOCK", 60)
    monkeypatch.setattr(nearest, "TILE", 4)
    r = np.random.default_rng(3)
    middle = r.normal(size=(5, 8))
    # Half of all rows are copies of five vectors, some of them longer.
    vectors = [(middle[i % 5] * (1 + i % 3) if i % 2 else r.normal(size=8)).tolist() for i in range(400)]
    vectors[10:16] = [None, [0.0] * 8, [1.0] * 3, [math.nan] * 8, [None] * 8, []]
    chunks = [(i, v, [None, "text", "image"][i % 3]) for i, v in enumerate(vectors)]
    queries = [(i, v, [None, ["image"], ["text", "code"], []][i % 4]) for i, v in enumerate(vectors[:40])]
    held = spark.createDataFrame(chunks, "chunk_id long, embedding array<double>, modality string")
    for asked, schema in ((queries, "query_id long, embedding array<double>, allowed array<string>"), ([(q, v, None) for q, v, _ in queries], "query_id long, embedding array<double>, allowed array<string>")):
        df = spark.createDataFrame(asked, schema)
        got = retrieval.dense_topk(df if asked is queries else df.drop("allowed"), held, 7)
        assert sorted((x.query_id, x.chunk_id, x["rank"]) for x in got.collect()) == brute(asked, chunks, 7)


def test_few_pairs_become_rows(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).tolist()) for i in range(3000)] + [(i, [1.0] * 8) for i in range(3000, 4000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = chunks.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    assert nearest.scores(asked, chunks, 5).count() < 200 * 10 * 2


def test_queries_with_the_same_nodes_share_their_ranks(spark):
    hits = spark.createDataFrame([(q, 0, 1) for q in range(50)] + [(50, 1, 1)], "query_id long, chunk_id long, rank int")
    chunks = spark.createDataFrame([(0, "a"), (1, "z"), (2, "b"), (3, "b"), (4, "c"), (4, "b")], "chunk_id long, node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("z", "y")], "source string, target string")
    got = graphs.traverse(hits, chunks, edges)
    assert sorted((x.query_id, x.chunk_id, x["rank"]) for x in got.collect()) == [(q, c, n) for q in range(50) for n, c in enumerate((2, 3, 4), 1)]
    # The ranking comes before the queries: no window over a row for each query and chunk.
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
