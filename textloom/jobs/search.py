"""Batches of queries answered by one job: routing, two channels, fusion, graph, reranking, gate, web fallback.

Models are slots: a router is a column, a reranker a function from pairs to answers,
an embedder is applied before (``retrieval.embed``). Every slot has a default that needs
no model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import graphs, render, retrieval


@dataclass(frozen=True)
class Graph:
    """Edges (source, target) and the chunks of their nodes (node, chunk_id)."""

    edges: DataFrame
    node_chunks: DataFrame


def routed(queries: DataFrame, router: Column | None = None) -> DataFrame:
    """``queries`` (query_id, query, ...) with intent, final (hits wanted, as a factor) and allowed (modalities, null for all)."""
    named = queries.withColumn("intent", router if router is not None else retrieval.intent(F.col("query")))
    allowed = F
    for intent, modalities in retrieval.INTENT_MODALITIES.items():
        allowed = allowed.when(F.col("intent") == intent, F.array(*map(F.lit, modalities)))
    return named.withColumns({"factor": F.when(F.col("intent") == "analytical", 2).otherwise(1), "allowed": allowed})


def search(
    queries: DataFrame,
    chunks: DataFrame,
    top_k: int = 10,
    router: Column | None = None,
    graph: Graph | None = None,
    wanted: Column | None = None,
    reranker: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The best hits of every query, with the chunks' columns.

    ``queries`` has query_id, query and embedding, ``chunks`` chunk_id, text, modality and
    embedding. Analytical queries take twice as many hits. A query whose intent asks for
    some modalities sees chunks of these alone. Hits near the best ones in ``graph`` join
    them. ``wanted`` then picks hits, for the queries that have any such.
    """
    asked = routed(queries, router)
    channel, fused, _ = retrieval.candidate_limits(True, top_k)
    factors = asked.select("query_id", "factor")
    cut = F.col("rank") <= channel // 2 * F.col("factor")
    dense = retrieval.dense_topk(asked.select("query_id", "embedding", "allowed"), chunks.select("chunk_id", "embedding", "modality"), channel)
    words = retrieval.token_weights(chunks.select("chunk_id", "text"), "chunk_id").join(chunks.select("chunk_id", "modality"), "chunk_id")
    tokens = retrieval.token_weights(asked.select("query_id", F.col("query").alias("text")), "query_id").join(asked.select("query_id", "allowed"), "query_id")
    sparse = retrieval.sparse_topk(tokens, words, channel)
    channels = [c.join(factors, "query_id").where(cut).select("query_id", "chunk_id", "score", "rank") for c in (dense, sparse)]
    hits = retrieval.fuse(channels, fused).join(factors, "query_id").where(F.col("rank") <= fused // 2 * F.col("factor"))
    hits = hits.drop("factor").withColumn("retrieval_source", F.lit("vector"))
    if graph is not None:
        near = graphs.traverse(hits, graph.node_chunks, graph.edges).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        hits = hits.unionByName(near)
    hits = hits.join(chunks.drop("embedding"), "chunk_id").join(asked.select("query_id", "query", "factor"), "query_id")
    if wanted is not None:
        hits = retrieval.postfilter(hits, wanted)
    best = retrieval.rerank(hits, 2 * top_k) if reranker is None else retrieval.rescored(hits, reranker, 2 * top_k)
    return best.where(F.col("rank") <= top_k * F.col("factor")).drop("factor")


@dataclass(frozen=True)
class Answers:
    """What a batch of queries gets: answers, their sources by number, the hits behind them, and the gates."""

    answers: DataFrame
    sources: DataFrame
    hits: DataFrame
    gates: DataFrame


def answer(queries: DataFrame, hits: DataFrame, web: DataFrame | None = None, threshold: float = retrieval.GROUNDED) -> Answers:
    """Extractive answers to ``queries`` from the hits of ``search`` and, where those are too weak, from web results."""
    gates = retrieval.gate(queries, retrieval.groundedness(hits), threshold)
    if web is not None:
        hits = retrieval.with_fallback(hits, retrieval.web_hits(web).withColumn("rank", F.lit(1_000_000)), gates)
    return Answers(render.extractive_answer(queries, hits), retrieval.source_refs(hits), hits, gates)
