"""Batches of queries against chunks: sparse and dense channels, fusion, reranking, gates.

Hits are rows (query_id, chunk_id, score, rank) and queries are a table, so one job
answers all of them. Every ranking breaks ties by chunk_id. ``row_number() <= n``
lets Spark cut each query's candidates before the shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.hashing import md5_bucket
from textloom.functions.text import head, words
from textloom.operators import nearest
from textloom.storage import materialize, maybe_broadcast

RRF_K = 60
GROUNDED = 0.45
#: Query rows counted to be at most so many are broadcast.
BROADCAST_ROWS = 100_000
#: Rows of words that a task hands on at once, about.
COUNTED_ROWS = 100_000
# Modalities that an intent asks for.
INTENT_MODALITIES = {"visual": ("image", "graph"), "mathematical": ("formula",), "code": ("algorithm", "code")}
# Words that give a query's intent when no model does; first match wins.
INTENT_WORDS = (
    ("visual", r"\b(chart|figure|diagram|image|picture|plot|graph)s?\b"),
    ("mathematical", r"\b(formula|equation|theorem|integral|derive)s?\b"),
    ("code", r"\b(code|algorithm|function|pseudocode|implementation)s?\b"),
    ("relational", r"\b(relate|relates|related|relationship|depends|connected)\b"),
    ("analytical", r"\b(why|compare|analyse|analyze|explain|trend|impact)\b"),
    ("factual", r"\b(what|who|when|where|which|how many|how much)\b"),
)


def intent(text: Column, limit: int | None = None) -> Column:
    """The default router: one of seven classes by key words of the text, or of its first ``limit`` characters."""
    lowered = F.lower(head(text, limit))
    found = F
    for name, pattern in INTENT_WORDS:
        found = found.when(lowered.rlike(pattern), name)
    return found.otherwise("general")


def _row_counts(docs: DataFrame, key: str) -> DataFrame:
    """key, token, tf, most: the lower-cased words of each row, how often it has them, and its greatest such number."""
    rows = docs.select(key, F.lower("text").alias("text"))
    schema = T.StructType([rows.schema[key], T.StructField("token", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("most", T.LongType())])

    def count(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            at: list[int] = []
            tokens: list[bytes] = []
            tf: list[int] = []
            most: list[int] = []

            def made() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()), pa.array(most, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=schema.names)

            for i in range(len(texts)):
                # Bytes are split at space and 0x09-0x0D.
                found = Counter((texts[i].as_py() or b"").split())
                if found:
                    at.extend(repeat(i, len(found)))
                    tokens.extend(found)
                    tf.extend(found.values())
                    most.extend(repeat(max(found.values()), len(found)))
                if len(at) >= COUNTED_ROWS:
                    yield made()
                    for x in (at, tokens, tf, most):
                        x.clear()
            yield made()

    return rows.mapInArrow(count, schema)


def _by_uniqueness(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key is theirs alone, and the others, if there are any."""
    repeated = materialize(docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("_repeated")), "repeated-keys")
    if repeated.isEmpty():
        return docs, None
    same, side = F.col(key).eqNullSafe(F.col("_repeated")), maybe_broadcast(repeated, BROADCAST_ROWS)
    return docs.join(side, same, "left_anti"), docs.join(side, same, "left_semi")


def _weighted(counts: DataFrame, key: str, name: str) -> DataFrame:
    """key, name, tf, weight of counts that are to be added up."""
    summed = counts.repartition(key).groupBy(key, name).agg(F.sum("tf").alias("tf"))
    return summed.select(key, name, "tf", (F.col("tf") / F.max("tf").over(Window.partitionBy(key))).alias("weight"))


def token_weights(docs: DataFrame, key: str) -> DataFrame:
    """key, token, weight: frequency of each lower-cased word over the most frequent one's.

    Words are counted within their row; only rows that share a key are shuffled.
    """
    alone, shared = _by_uniqueness(docs.select(key, "text"), key)
    weights = _row_counts(alone, key).select(key, "token", "tf", (F.col("tf") / F.col("most")).alias("weight"))
    return weights if shared is None else weights.unionByName(_weighted(_row_counts(shared, key), key, "token"))


def sparse_encode(docs: DataFrame, key: str, bucket=md5_bucket) -> DataFrame:
    """key, bucket, weight: hashed frequencies; words that share a bucket add up.

    A word is hashed once in each row that has it, and numbers alone are shuffled.
    """
    counts = _row_counts(docs, key).select(key, bucket(F.col("token")).alias("bucket"), "tf")
    return _weighted(counts, key, "bucket").drop("tf")


def ranked(scores: DataFrame, limit: int, order: list[Column] | None = None) -> DataFrame:
    """The best ``limit`` rows of each query with their rank from 1."""
    by = order or [F.desc("score"), F.col("chunk_id")]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= limit)


def _allowed(pairs: DataFrame) -> DataFrame:
    """The pairs whose chunk has a modality that the query allows."""
    return pairs.where("allowed is null or array_contains(allowed, modality)") if "allowed" in pairs.columns else pairs


def sparse_topk(queries: DataFrame, chunks: DataFrame, limit: int, on: str = "token") -> DataFrame:
    """Dot products of the weights of shared tokens; both sides have ``on`` and weight.

    Where queries have ``allowed``, null or a list, only chunks of these modalities count.
    """
    limits = [c for c in ("allowed",) if c in queries.columns]
    asked = maybe_broadcast(queries.select("query_id", on, F.col("weight").alias("wq"), *limits), BROADCAST_ROWS)
    met = _allowed(chunks.select("chunk_id", on, "weight", *(["modality"] if limits else [])).join(asked, on))
    scores = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("wq") * F.col("weight")), 9).alias("score"))
    return ranked(scores, limit)


def dense_topk(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Cosine of every query with every chunk (a stated query set against all rows), worked out by blocks; the hits are written.

    Where queries have ``allowed``, null or a list, only chunks of these modalities count.
    """
    return materialize(ranked(nearest.scores(queries, chunks, limit), limit), "dense-hits")


def candidate_limits(analytical: bool, top_k: int) -> tuple[int, int, int]:
    """(per channel, fused, final): analytical queries take twice as many."""
    final = 2 * top_k if analytical else top_k
    return 9 * final, 3 * final, final


def fuse(channels: list[DataFrame], limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: a hit of rank r from 0 adds 1 / (k + r + 1)."""
    rows = None
    for i, channel in enumerate(channels):
        one = channel.select("query_id", "chunk_id", F.lit(i).alias("list"), (F.col("rank") - 1).alias("r"))
        rows = one if rows is None else rows.unionByName(one)
    score = F.round(F.sum(1.0 / (k + F.col("r") + 1)), 12)
    fused = rows.groupBy("query_id", "chunk_id").agg(score.alias("score"), F.min(F.struct("list", "r")).alias("first"))
    return ranked(fused, limit, [F.desc("score"), F.col("first"), F.col("chunk_id")]).drop("first")


def prefilter(chunks: DataFrame, intent_name: str) -> DataFrame:
    """Only the modalities that an intent asks for; reaches the scan as a predicate."""
    wanted = INTENT_MODALITIES.get(intent_name)
    return chunks.where(F.col("modality").isin(list(wanted))) if wanted else chunks


def postfilter(hits: DataFrame, wanted: Column) -> DataFrame:
    """Hits that match, for each query; all of them where none does."""
    matches = F.coalesce(wanted, F.lit(False))
    marked = hits.withColumn("_match", matches).withColumn("_any", F.max(matches).over(Window.partitionBy("query_id")))
    return marked.where("_match or not _any").drop("_match", "_any")


def rerank(hits: DataFrame, top_n: int, limit: int | None = None) -> DataFrame:
    """The default reranker: share of a query's distinct words that the text, or its first ``limit`` characters, holds.

    ``hits`` has query_id, query, chunk_id, text, score; the new score replaces the old.
    """
    asked = F.array_distinct(words(F.lower("query")))
    held = F.array_distinct(words(F.lower(head(F.col("text"), limit))))
    cover = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, held)) / F.size(asked)).otherwise(0.0)
    scored = hits.withColumnRenamed("score", "first_score").withColumn("score", F.round(cover, 9))
    return ranked(scored.drop("rank"), top_n, [F.desc("score"), F.desc("first_score"), F.col("chunk_id")])


def rescored(hits: DataFrame, model: Callable[[DataFrame], DataFrame], top_n: int) -> DataFrame:
    """The best ``top_n`` hits of each query by a model's scores.

    ``model`` takes query_id, query, chunk_id, text and returns query_id, chunk_id and
    answer, a number or a text. Numbers are kept within [0, 1]; an answer that is no
    number counts as 0.5; a pair without an answer keeps its score.
    """
    said = model(hits.select("query_id", "query", "chunk_id", "text")).select("query_id", "chunk_id", F.col("answer").cast("string").alias("_answer"))
    number = F.regexp_extract("_answer", r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$", 1).try_cast("double")
    new = F.when(F.col("_answer").isNull(), F.col("score")).when(number.isNull(), 0.5).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))
    scored = hits.drop("rank").join(said, ["query_id", "chunk_id"], "left").withColumn("first_score", F.col("score")).withColumn("score", F.round(new, 9)).drop("_answer")
    return ranked(scored, top_n, [F.desc("score"), F.desc("first_score"), F.col("chunk_id")])


def hash_embedding(text: Column, size: int = 64) -> Column:
    """The default embedder: how often a text's words fall into each of ``size`` buckets, at unit length; zeros without words."""
    buckets = F.transform(words(F.lower(text)), lambda w: F.pmod(md5_bucket(w), F.lit(size)).cast("int"))
    counts = F.aggregate(buckets, F.array_repeat(F.lit(0.0), size), lambda a, b: F.transform(a, lambda x, i: F.when(i == b, x + 1).otherwise(x)))
    return F.get(F.transform(F.array(counts), lambda c: F.transform(c, lambda x: F.coalesce(x / F.nullif(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y * y)), F.lit(0.0)), F.lit(0.0)))), F.lit(0))


def embed(texts: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``texts`` (key, text, ...) with ``embedding``; each distinct text goes to the model once, in no set order.

    ``model`` takes a table with text and returns text and embedding.
    """
    if model is None:
        return texts.withColumn("embedding", hash_embedding(F.coalesce("text", F.lit(""))))
    return texts.join(model(texts.select("text").distinct()).select("text", "embedding"), "text", "left").select(*texts.columns, "embedding")


def graph_topk(queries: DataFrame, graphs: DataFrame, limit: int) -> DataFrame:
    """Chunks by the cosine of their graph's vector; ``graphs`` has chunk_id and embedding, null where a chunk has no graph."""
    return dense_topk(queries, graphs.where("embedding is not null"), limit).withColumn("retrieval_source", F.lit("graph"))


def latency(events: DataFrame, by: str, value: str, threshold: float) -> DataFrame:
    """``by``, mean, least and greatest value, and the share of rows that reach the threshold."""
    v = F.col(value)
    return events.groupBy(by).agg(F.round(F.avg(v), 9).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(F.when(v >= threshold, 1.0).when(v.isNotNull(), 0.0)), 9).alias("share"))


def top_values(rows: DataFrame, by: Column, n: int = 10) -> DataFrame:
    """value, count of the ``n`` most frequent values, smaller ones first among equals; a report for the driver."""
    return rows.groupBy(by.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(n)


def large_figures(elements: DataFrame, least: int = 40) -> DataFrame:
    """Figures whose box (bbox with x0, y0, x1, y1) is at least so wide and high."""
    wide, high = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    return elements.where((F.col("label") == "figure") & (wide >= least) & (high >= least))


def groundedness(hits: DataFrame) -> DataFrame:
    """query_id, groundedness: mean of the scores weighted by themselves, negative ones as 0, within [0, 1]."""
    s = F.greatest(F.col("score"), F.lit(0.0))
    mean = F.sum(s * s) / F.nullif(F.sum(s), F.lit(0.0))
    return hits.groupBy("query_id").agg(F.round(F.least(F.greatest(F.coalesce(mean, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 9).alias("groundedness"))


def gate(queries: DataFrame, grounded: DataFrame, threshold: float = GROUNDED) -> DataFrame:
    """query_id, groundedness, fallback_used for every query; one without hits has 0."""
    score = F.coalesce("groundedness", F.lit(0.0))
    return queries.select("query_id").join(grounded, "query_id", "left").select("query_id", score.alias("groundedness"), (score < threshold).alias("fallback_used"))


def web_hits(results: DataFrame) -> DataFrame:
    """Web results (query_id, url, title, snippet, score) in the form of hits."""
    text = F.concat("title", F.lit("\n\n"), "snippet")
    return results.select(
        "query_id", F.concat(F.lit("web:"), "url").alias("chunk_id"), F.lit("web").alias("doc_id"), F.col("url").alias("source_file"), F.lit(1).alias("page"),
        F.lit("text").alias("modality"), text.alias("text"), text.alias("enriched_text"), F.expr("cast(array() as array<string>)").alias("section_path"), "url", "score", F.lit("web").alias("retrieval_source"),
    )


def with_fallback(hits: DataFrame, web: DataFrame, gates: DataFrame) -> DataFrame:
    """Appends the web hits of the queries whose gate is open."""
    opened = web.join(gates.where("fallback_used").select("query_id"), "query_id", "left_semi")
    return hits.unionByName(opened, allowMissingColumns=True)


def effective_text(enriched: Column, text: Column) -> Column:
    """The enriched text, or the text where that is null or empty."""
    return F.coalesce(F.nullif(enriched, F.lit("")), text)


def search_projection(hits: DataFrame) -> DataFrame:
    """The ten columns of a search answer; the text is cut at 500 characters."""
    tags = F.coalesce("concept_tags", F.expr("cast(array() as array<string>)"))
    return hits.select("query_id", "chunk_id", "doc_id", "source_file", F.coalesce("page", F.lit(1)).alias("page"), "modality", "score", F.substring(effective_text(F.col("enriched_text"), F.col("text")), 1, 500).alias("text"), "section_path", tags.alias("concept_tags"), "retrieval_source")


def source_refs(hits: DataFrame) -> DataFrame:
    """Numbered references of the answers' sources; a web source's title is its text's first 80 characters."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))
    title = F.when(F.col("retrieval_source") == "web", F.substring("text", 1, 80))
    return hits.select("query_id", number.alias("source"), "chunk_id", "source_file", "page", title.alias("title"))
