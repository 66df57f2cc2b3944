"""Exact scores of queries with all vectors, by blocks.

Vectors and queries are dealt into blocks of bounded size, and Spark brings every block of
queries together with every block of vectors. A task multiplies two blocks as matrices and
gives on, of each query, only what may be among its best ``limit``: the product finds the
candidates, whose scores are then added up in index order, as ``functions.vectors.dot`` does.
All pairs are looked at, but none of the others is ever a row. Equal vectors of a block are
multiplied once, and of these the smallest ids count.

Rows that matrices do not fit (not finite, or of another number of dimensions than most) are
paired one by one, and give what they always gave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.vectors import dot
from textloom.storage import materialize

#: Queries and vectors of a block, numbers of a block of vectors, queries multiplied at once.
QUERY_BLOCK, CHUNK_BLOCK, BLOCK_NUMBERS, TILE = 8_192, 32_768, 1 << 23, 256
#: Scores have nine digits; two that are equal then differ by less than this.
_SLACK = 3e-9
_LEAST, _MOST = 1e-100, 1e100


def plain_vector(v: Column, size: Column, dimensions: int) -> Column:
    """Whether a vector with this length fits into a matrix."""
    return F.coalesce((F.size(v) == dimensions) & (size > _LEAST) & (size < _MOST), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array([c.flatten() for c in column.chunks], column.type.value_type).to_numpy()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _best(q: np.ndarray, q_size: np.ndarray, floor: np.ndarray, v: np.ndarray, v_size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and vectors, and scores, of all that may be a query's best; vectors come in order of their ids."""
    rows = np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel()
    _, first, group = np.unique(rows, return_index=True, return_inverse=True)
    members = np.argsort(group, kind="stable")
    counts = np.bincount(group)
    starts = np.cumsum(counts) - counts
    units = (v[first] / v_size[first][:, None]).T
    out = []
    for at in range(0, len(q), TILE):
        tile = slice(at, at + TILE)
        scores = (q[tile] / q_size[tile][:, None]) @ units
        least = np.full(len(scores), -np.inf) if len(first) <= limit else np.partition(scores, len(first) - limit, axis=1)[:, len(first) - limit]
        i, j = np.nonzero(scores >= np.maximum(least, floor[tile])[:, None] - _SLACK)
        total = np.zeros(len(i))
        for d in range(v.shape[1]):
            total += v[first[j], d] * q[at + i, d]
        total /= v_size[first[j]] * q_size[at + i]
        # Of equal vectors the smallest ids.
        n = np.minimum(counts[j], limit)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, total, place = np.repeat(i, n), np.repeat(total, n), members[np.repeat(starts[j], n) + step]
        order = np.lexsort((place, -total, i))
        i, total, place = i[order], total[order], place[order]
        begin = np.searchsorted(i, np.arange(len(scores)))
        found = np.searchsorted(i, np.arange(len(scores)), "right") - begin
        last = np.where(found >= limit, total[np.minimum(begin + limit - 1, max(0, len(i) - 1))] if len(i) else 0.0, -np.inf)
        kept = total >= last[i] - _SLACK
        out.append((at + i[kept], place[kept], total[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_of_blocks(queries: DataFrame, chunks: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """query_id, chunk_id, score: of every pair of groups with the same ``keys`` what may be among a query's best ``limit``.

    ``queries`` has query_id, q, q_size and perhaps allowed and floor, a score below which nothing is asked for;
    ``chunks`` has chunk_id, v, v_size and perhaps modality. Vectors are plain ones.
    """
    schema = T.StructType([queries.schema["query_id"], chunks.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    allowing, floored = "allowed" in queries.columns, "floor" in queries.columns

    def pair(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "chunk_id", "score"]
        parts = []
        if asked.num_rows and held.num_rows:
            held = held.take(pc.sort_indices(held, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
            q, v = _matrix(asked["q"]), _matrix(held["v"])
            q_size, v_size = asked["q_size"].to_numpy(), held["v_size"].to_numpy()
            floor = pc.fill_null(asked["floor"], -np.inf).to_numpy() if floored else np.full(len(q), -np.inf)
            sets: dict = {None: np.arange(len(q))}
            if allowing:
                said = [None if x is None else frozenset(x) for x in asked["allowed"].to_pylist()]
                sets = {s: np.array([i for i, x in enumerate(said) if x == s]) for s in set(said)}
                modality = np.array(held["modality"].to_pylist(), object)
            for allowed, at in sets.items():
                seen = np.arange(len(v)) if allowed is None else np.flatnonzero([m is not None and m in allowed for m in modality])
                if len(seen):
                    i, j, score = _best(q[at], q_size[at], floor[at], v[seen], v_size[seen], limit)
                    parts.append(pa.table([asked["query_id"].take(pa.array(at[i])), held["chunk_id"].take(pa.array(seen[j])), pa.array(score)], names=names))
        return pa.concat_tables(parts) if parts else pa.table([asked["query_id"].slice(0, 0), held["chunk_id"].slice(0, 0), pa.array([], pa.float64())], names=names)

    return queries.groupBy(*keys).cogroup(chunks.groupBy(*keys)).applyInArrow(pair, schema)


def _vectors(rows: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    e = F.col("embedding")
    if rows.schema["embedding"].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        e = e.cast("array<double>")
    return rows.select(key, *more, e.alias(vector), F.sqrt(dot(e, e)).alias(f"{vector}_size")).where(f"{vector}_size is not null")


def _dealt(rows: DataFrame, key: str, into: str, n: int, across: str, m: int) -> DataFrame:
    """``rows`` in ``n`` blocks by their key, each of them for all ``m`` blocks of the other side."""
    return rows.withColumns({into: F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), across: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})


def scores(queries: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """query_id, chunk_id, score in nine digits: at least the best ``limit`` chunks of every query by score and chunk_id.

    ``queries`` has query_id and embedding, ``chunks`` chunk_id and embedding. Where queries have
    ``allowed``, null or a list, only chunks of these modalities count. A pair without length on a side has no score.
    """
    limits = "allowed" in queries.columns
    asked = materialize(_vectors(queries, "query_id", "q", *(["allowed"] if limits else [])), "asked-vectors")
    held = materialize(_vectors(chunks, "chunk_id", "v", *(["modality"] if limits else [])), "vectors")
    dimensions = held.where("v_size > 0").agg(F.mode(F.size("v"))).first()[0] or 0
    q_plain, v_plain = plain_vector(F.col("q"), F.col("q_size"), dimensions), plain_vector(F.col("v"), F.col("v_size"), dimensions)

    def counted(rows: DataFrame, plain: Column, size: str) -> tuple[int, int]:
        found = rows.agg(F.count_if(plain).alias("plain"), F.count_if(~plain & (F.col(size) != 0)).alias("odd")).first()
        return found.plain, found.odd

    (n_q, odd_q), (n_v, odd_v) = counted(asked, q_plain, "q_size"), counted(held, v_plain, "v_size")
    block = max(1, min(CHUNK_BLOCK, BLOCK_NUMBERS // max(1, dimensions)))
    q_blocks, v_blocks = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_v // block))
    left = _dealt(asked.where(q_plain), "query_id", "q_block", q_blocks, "v_block", v_blocks)
    right = _dealt(held.where(v_plain), "chunk_id", "v_block", v_blocks, "q_block", q_blocks)
    found = best_of_blocks(left, right, ["q_block", "v_block"], limit)
    if odd_q or odd_v:
        odd = held.where(~v_plain & (F.col("v_size") != 0)).crossJoin(asked)
        odd = odd.unionByName(held.where(v_plain | (F.col("v_size") == 0)).crossJoin(asked.where(~q_plain & (F.col("q_size") != 0))))
        odd = odd.where("allowed is null or array_contains(allowed, modality)") if limits else odd
        size = F.col("v_size") * F.col("q_size")
        found = found.unionByName(odd.where(size > 0).select("query_id", "chunk_id", (dot(F.col("v"), F.col("q")) / size).alias("score")))
    return found.withColumn("score", F.round("score", 9))
