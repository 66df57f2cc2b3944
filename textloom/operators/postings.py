"""Stored postings in blocks of chunks, by impact, and exact top-k searches that leave lists out.

``build`` tokenises a corpus once. A posting is a token's weight in a chunk. Chunks go into blocks of
bounded size in the order in which they are read, so the store is written without a shuffle and no
token is too frequent for a task. In a block, weights fall into levels, each a factor of the square
root of two below the one before, and a token's postings of one level make a list with its largest
weight.

A search for the best k chunks of a batch of queries

1. adds up each query's rarest lists until some postings are read: the k-th best of these partial scores
   is one that the k-th best chunk reaches,
2. brings a block's lists of the queries' tokens together. For each query lists are left out, those of the lowest
   bounds first, as long as the bounds of what is left out add up to less than a share of that
   score. A chunk that occurs only there cannot be among the best, and of the others only those whose
   scores may reach it with the bounds get what they lack,
3. takes the best k of each block on.

So no pair of a query and a chunk is a row unless it is among the best of its block, but for the few
of the first step; what is shuffled are the postings of the queries' tokens and the queries, once a block.
The result is that of scoring every chunk. Ties go by chunk_id. Weights are above zero.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.retrieval import ranked, token_weights
from textloom.storage import maybe_broadcast, materialize

#: Chunks of a block, and postings and bytes from which on it takes no other chunk.
BLOCK, BLOCK_POSTINGS, BLOCK_BYTES = 8192, 1 << 20, 1 << 26
#: Postings that a query's first lists have together, at most, for each hit wanted.
FIRST_POSTINGS = 50
#: Share of the first bound that the lists left out may add up to.
LEFT_OUT = 0.6
#: Scores that a task holds at once.
CELLS = 1 << 22
#: Rows counted to be at most so many are broadcast.
BROADCAST_ROWS = 200_000
#: What sums of weights may differ by in another order, far more than they do.
_SLACK = 1e-6


@dataclass(frozen=True)
class PostingStore:
    """``blocks`` (block, token, level, n, top, entries, weights; entries are places in the block) and ``members`` (block, chunks by place, modalities)."""

    blocks: DataFrame
    members: DataFrame

    def topk(self, queries: DataFrame, limit: int) -> DataFrame:
        """query_id, chunk_id, score, rank of the best ``limit`` chunks; where ``allowed`` is a list, of these modalities."""
        schema = T.StructType([queries.schema["query_id"], T.StructField("chunk_id", self.members.schema["chunks"].dataType.elementType), T.StructField("score", T.DoubleType())])
        best = materialize(self._searched(queries, limit, schema, share=False), "block-hits")
        return ranked(best.withColumn("score", F.round("score", 9)), limit)

    def read_share(self, queries: DataFrame, limit: int) -> DataFrame:
        """query_id, read, postings: of the postings of each query's tokens, how many are in lists that are not left out."""
        schema = T.StructType([queries.schema["query_id"], T.StructField("read", T.LongType()), T.StructField("postings", T.LongType())])
        return self._searched(queries, limit, schema, share=True).groupBy("query_id").agg(F.sum("read").alias("read"), F.sum("postings").alias("postings"))

    def _searched(self, queries: DataFrame, limit: int, schema: T.StructType, share: bool) -> DataFrame:
        limits = [c for c in ("allowed",) if c in queries.columns]
        asked = materialize(queries.groupBy("query_id", "token", *limits).agg(F.sum("weight").alias("wq")), "asked")
        tokens = maybe_broadcast(materialize(asked.select("token").distinct(), "asked-tokens"), BROADCAST_ROWS)
        met = self.blocks.join(tokens, "token", "left_semi")
        least = maybe_broadcast(materialize(self._least(asked, met, limit), "least-scores"), BROADCAST_ROWS)
        asked = asked.join(least, asked["query_id"].eqNullSafe(least["of"]), "left").drop("of")
        lists = met.select("block", "token", "level", "entries", "weights").unionByName(self.members, allowMissingColumns=True)
        every = asked.crossJoin(self.members.select("block"))
        return lists.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(_scorer(limit, LEFT_OUT, CELLS, share, schema.names), schema)

    def _least(self, asked: DataFrame, met: DataFrame, limit: int) -> DataFrame:
        """of, least: a score that a query's limit-th best chunk reaches, where its rarest lists have so many chunks."""
        lexicon = met.groupBy("token", "level").agg(F.sum("n").alias("n"))
        rare = Window.partitionBy("query_id").orderBy("n", F.desc("wq"), "token", "level")
        first = lexicon.join(asked, "token").withColumn("run", F.sum("n").over(rare)).where(F.col("run") <= FIRST_POSTINGS * limit)
        first = maybe_broadcast(materialize(first.drop("n", "run"), "first-lists"), BROADCAST_ROWS)
        opened = met.join(first, ["token", "level"]).select("query_id", "wq", "block", *(["allowed"] if "allowed" in asked.columns else []), F.explode(F.arrays_zip("entries", "weights")).alias("e"))
        if "allowed" in asked.columns:
            kinds = self.members.select("block", F.posexplode("modalities").alias("entries", "modality"))
            known = opened.withColumn("entries", F.col("e.entries")).join(kinds, ["block", "entries"])
            opened = known.where("allowed is null or array_contains(allowed, modality)")
        sums = opened.groupBy("query_id", "block", F.col("e.entries").alias("at")).agg(F.sum(F.col("wq") * F.col("e.weights")).alias("score"))
        return ranked(sums, limit, [F.desc("score"), F.col("block"), F.col("at")]).where(F.col("rank") == limit).select(F.col("query_id").alias("of"), F.col("score").alias("least"))


def _scorer(limit: int, left_out: float, cells: int, share: bool, names: list[str]) -> Callable:
    """A function of one block's lists and of the queries' tokens that gives each query's best chunks of the block, or the postings it reads of them."""

    def task(found, asked):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        inside = found.filter(pc.is_null(found["token"]))
        lists = found.filter(pc.is_valid(found["token"])).sort_by([("token", "ascending"), ("level", "ascending")]).combine_chunks()
        chunks, kinds = (inside[c].combine_chunks().flatten() for c in ("chunks", "modalities"))
        kinds = kinds if len(kinds) else pa.nulls(len(chunks), pa.string())
        query = pc.dictionary_encode(asked["query_id"].combine_chunks(), null_encoding="encode")
        query, who = query.dictionary, query.indices.to_numpy()
        sizes = pc.list_value_length(lists["entries"]).to_numpy()
        begin = np.append(0, np.cumsum(sizes))
        at, weight = (lists[c].combine_chunks().flatten().to_numpy() for c in ("entries", "weights"))
        top = np.maximum.reduceat(weight, begin[:-1]) if len(sizes) else weight
        known = pc.unique(lists["token"])
        of_list = pc.index_in(lists["token"], value_set=known).to_numpy()

        # Pairs of a list and a query that asks for its token, by list.
        place = pc.fill_null(pc.index_in(asked["token"], value_set=known), -1).to_numpy()
        by_token = place.argsort(kind="stable")
        low, high = (np.searchsorted(place[by_token], of_list, side) for side in ("left", "right"))
        pair = np.repeat(np.arange(len(sizes)), high - low)
        row = by_token[np.arange(len(pair)) - np.repeat(np.cumsum(high - low) - high, high - low)]
        q, wq = who[row], asked["wq"].to_numpy()[row]
        least = np.full(len(query), -np.inf)
        least[who] = pc.fill_null(asked["least"], -np.inf).to_numpy()

        # A token's lists share no chunk, so each adds only what its bound is above those below.
        bound = wq * top[pair]
        order = np.lexsort((bound, of_list[pair], q))
        before = np.append(-1, order[:-1])
        same = (q[before] == q[order]) & (of_list[pair][before] == of_list[pair][order]) & (before >= 0) if len(order) else order > 0
        step = np.empty(len(pair))
        step[order] = bound[order] - np.where(same, bound[before], 0) if len(order) else 0
        order = np.lexsort((of_list[pair], bound, q))
        run, first = np.cumsum(step[order]), np.searchsorted(q[order], q[order])
        run -= run[first] - step[order][first] if len(order) else 0
        skip, more = np.zeros(len(pair), bool), np.zeros(len(query))
        skip[order] = run <= least[q[order]] * left_out - _SLACK
        np.maximum.at(more, q[order], np.where(skip[order], run, 0))
        if share:
            read, whole = (np.bincount(q, sizes[pair] * w, len(query)).astype(np.int64) for w in (~skip, 1))
            return pa.table([query, read, whole], names=names)

        def add(scores, pairs, first, where=None) -> None:
            starts = np.flatnonzero(np.diff(pair[pairs], prepend=-1))
            for s, e in zip(starts, np.append(starts[1:], len(pairs)), strict=True):
                j, some = pair[pairs[s]], pairs[s:e]
                here = np.ix_(q[some] - first, at[begin[j] : begin[j + 1]])
                given = wq[some][:, None] * weight[begin[j] : begin[j + 1]]
                if where is None:
                    scores[here] += given
                elif (wanted := where[here]).any():
                    scores[here] += given * wanted

        hits = []
        if "allowed" in asked.column_names:
            modes = dict(zip(who.tolist(), asked["allowed"].to_pylist(), strict=True))
        for first in range(0, len(query), share_of := max(1, cells // len(chunks))):
            last = min(len(query), first + share_of)
            own = np.flatnonzero((q >= first) & (q < last))
            scores = np.zeros((last - first, len(chunks)))
            add(scores, own[~skip[own]], first)
            partial = scores
            if "allowed" in asked.column_names:
                may = np.array([np.ones(len(chunks), bool) if modes[i] is None else pc.fill_null(pc.is_in(kinds, value_set=pa.array(modes[i], pa.string())), False).to_numpy(zero_copy_only=False) for i in range(first, last)])
                partial = np.where(may, scores, 0)
            floor = least[first:last]
            if len(chunks) >= limit:
                floor = np.maximum(floor, np.partition(partial, len(chunks) - limit, axis=1)[:, len(chunks) - limit])
            wanted = (partial > 0) & (partial + more[first:last, None] >= floor[:, None] - _SLACK)
            add(scores, own[skip[own]], first, wanted)
            rows, columns = np.nonzero(wanted)
            score = scores[rows, columns]
            # Places are in order of chunk_id, and scores are compared as they are rounded.
            order = np.lexsort((columns, -np.floor(score * 1e9 + 0.5), rows))
            best = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < limit]
            hits.append((rows[best] + first, columns[best], score[best]))
        who, where, score = (np.concatenate(x) if hits else np.empty(0, np.int64) for x in (zip(*hits, strict=True) if hits else [()] * 3))
        return pa.table([query.take(pa.array(who)), chunks.take(pa.array(where)), pa.array(score, pa.float64())], names=names)

    return task


def _blocks(key, most_chunks: int, most_postings: int, most_bytes: int) -> tuple[Callable, T.StructType]:
    """What makes blocks of rows (chunk_id, token, weight), in which each chunk's rows stand together, and its rows' schema."""
    fields = [("block", T.LongType()), ("token", T.StringType()), ("level", T.IntegerType()), ("n", T.LongType()), ("entries", T.ArrayType(T.IntegerType())), ("weights", T.ArrayType(T.DoubleType())), ("chunks", T.ArrayType(key))]
    schema = T.StructType([T.StructField(*x) for x in fields])

    def task(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        task_number, number = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[pa.RecordBatch] = []
        of: list[int] = []
        rows = size = 0

        def made():
            block = task_number << 32 | number
            keys = pa.array(ids, held[0].schema.field(0).type)
            order = pc.sort_indices(keys, null_placement="at_start")
            place = np.empty(len(ids), np.int32)
            place[order.to_numpy()] = np.arange(len(ids), dtype=np.int32)
            at = place[np.repeat(of, [len(x) for x in held])]
            postings = pa.Table.from_batches(held)
            weight = postings["weight"].to_numpy()
            level = np.floor(-2 * np.log2(weight)).astype(np.int32)
            coded = postings["token"].combine_chunks().dictionary_encode()
            words = coded.dictionary
            sorted_words = pc.sort_indices(words).to_numpy()
            rank = np.empty(len(words), np.int32)
            rank[sorted_words] = np.arange(len(words), dtype=np.int32)
            token = rank[coded.indices.to_numpy()]
            by = np.lexsort((at, level, token))
            token, level = token[by], level[by]
            starts = np.flatnonzero((np.diff(token, prepend=-1) != 0) | (np.diff(level, prepend=-1) != 0))
            ends = pa.array(np.append(starts, len(by)).astype(np.int32))
            lists = [words.take(pa.array(sorted_words[token[starts]])), pa.array(level[starts]), pa.array(np.diff(starts, append=len(by)).astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(at[by])), pa.ListArray.from_arrays(ends, pa.array(weight[by]))]
            members = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), keys.take(order))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), block)), *lists, pa.nulls(len(starts), members.type)], names=schema.names)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.nulls(1, x.type) for x in lists), members], names=schema.names)

        for batch in batches:
            runs, start = pc.run_end_encode(batch.column(0)), 0
            for chunk, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if not ids or chunk != ids[-1]:
                    if len(ids) == most_chunks or rows >= most_postings or size >= most_bytes:
                        yield from made()
                        number, rows, size = number + 1, 0, 0
                        for x in (ids, held, of):
                            x.clear()
                    ids.append(chunk)
                held.append(batch.slice(start, end - start))
                of.append(len(ids) - 1)
                rows, size, start = rows + end - start, size + batch.nbytes * (end - start) // batch.num_rows, end
        if ids:
            yield from made()

    return task, schema


def open_store(spark: SparkSession, path: str) -> PostingStore:
    """A store that was built before."""
    return PostingStore(spark.read.parquet(f"{path}/blocks").where("token is not null").drop("chunks"), spark.read.parquet(f"{path}/members"))


def build(chunks: DataFrame, path: str) -> PostingStore:
    """Writes the store of ``chunks`` (chunk_id, text and perhaps modality; one row a chunk) into ``path``."""
    spark = chunks.sparkSession
    # The words of a chunk stand together: they are counted within its row, or within its window where rows share a chunk_id.
    weights = token_weights(chunks, "chunk_id").select("chunk_id", "token", "weight")
    task, schema = _blocks(chunks.schema["chunk_id"].dataType, BLOCK, BLOCK_POSTINGS, BLOCK_BYTES)
    weights.mapInArrow(task, schema).write.parquet(f"{path}/blocks")
    members = spark.read.parquet(f"{path}/blocks").where("token is null").select("block", "chunks")
    if "modality" in chunks.columns:
        kinds = chunks.select(F.col("chunk_id").alias("of"), "modality")
        each = members.select("block", F.posexplode("chunks").alias("at", "chunk_id"))
        each = each.join(kinds, F.col("chunk_id").eqNullSafe(F.col("of"))).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "modality"))).alias("m"))
        members = each.select("block", F.col("m.chunk_id").alias("chunks"), F.col("m.modality").alias("modalities"))
    else:
        members = members.withColumn("modalities", F.lit(None).cast("array<string>"))
    members.write.parquet(f"{path}/members")
    return open_store(spark, path)
