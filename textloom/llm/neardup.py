"""Near-duplicate groups by SetSketch registers, banding, likelihood and exact sets.

A document's set holds its distinct shingles of ``shingle`` words (A-Z as a-z).

1. Every set gets a fingerprint of 128 bits and m SetSketch registers: a register
   is the exponentially spaced, truncated minimum floor(1 - log_b h) of the set's
   hashes h, so the registers of a union are the maxima. Equal sets become one
   node; only nodes go on, with the smallest doc_id and the size of their set.
2. Registers are cut into bands; nodes that agree on a whole band share a bucket.
   A bucket links each node to its heaviest node, its hub, never all pairs. Heavy
   nodes are those in the largest buckets, so the original of many copies is the hub
   of all of them.
3. For a candidate pair the joint likelihood of the register comparison and the
   two set sizes gives a Jaccard estimate; pairs that fall below the wanted
   similarity by many standard errors are dropped.
4. What is left is verified on the full sets, by two 64-bit hashes a shingle. A hub's
   nodes are dealt out, and stream past one copy of its set. Links make components.
5. A bucket whose nodes are all in one component is done. In the others, nodes
   outside the bucket's largest component are compared with all others by sketch, in
   blocks. Those that have a promising partner meet it again with their full sets, so
   sets are moved for these alone. No link between different sets is lost to the
   hubs, and pairs that the sketches rule out are never rows.

Components come from large-star/small-star rounds on tables in the shared folder.

Defined results: a null or white text has an empty set and is linked with nothing;
a row with a null doc_id is counted but neither linked nor dropped; rows that
repeat have the same set and are linked; an empty table gives an empty result.
Columns other than doc_id and text are not read, whatever their names, and pass
through ``keep_one``, which keeps rows that repeat a doc_id and its text all or none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.wordhash import blocks, mix
from textloom.operators.components import components
from textloom.rows import without_rows
from textloom.skew import join_counted
from textloom.storage import maybe_broadcast, materialize, read_table

#: Bands, registers of a band; base and largest value of the registers.
BANDS, ROWS = 32, 4
BASE, LIMIT = 1.001, 65_534
#: Candidates whose estimate is lower by so many standard errors are dropped.
DOUBT = 6.0
#: Node ids known to be at most so many are broadcast.
BROADCAST_ROWS = 500_000
#: Nodes that share a task with one copy of a hub's set, or make a block of a bucket.
BLOCK_NODES = 512
#: Shingles of the sets of a block, on average.
BLOCK_SHINGLES = 1 << 19
#: Rows of parts that are compared together at least, and pairs of sketches compared at a time.
BUNDLE_ROWS, PAIRS = 1024, 8192
#: Bytes of sets that a task sends on at a time.
SEND_BYTES = 1 << 21

_RNG = np.random.default_rng(77)
_FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By block: index of the first text, and the distinct shingles of each text.

    Those of text j of the block are ``first[j]:first[j + 1]`` of two lanes of hashes,
    ascending by the first lane.
    """
    for i, n, words in blocks(texts, fold=True):
        counts = np.diff(words.first)
        owner = np.repeat(np.arange(n), counts)
        whole = np.flatnonzero(words.first[owner + 1] - np.arange(len(owner)) >= shingle)
        owners, lanes = [owner[whole]], [[words.runs(shingle, lane)[whole]] for lane in (0, 1)]
        for size in range(1, shingle):
            short = np.flatnonzero(counts == size)
            if len(short):
                owners.append(short)
                for lane in (0, 1):
                    lanes[lane].append(words.few(short, size, lane))
        owner, a, b = np.concatenate(owners), np.concatenate(lanes[0]), np.concatenate(lanes[1])
        order = np.lexsort((b, a, owner))
        owner, a, b = owner[order], a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])
        yield i, np.searchsorted(owner[new], np.arange(n + 1)), a[new], b[new]


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers of sets ``hashes[first[i]:first[i + 1]]``, none of them empty."""
    lowest = np.full((len(first) - 1, len(_FACTORS)), np.uint64(2**64 - 1))
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for at in range(0, len(hashes), 512):
        mine = owner[at : at + 512]
        begin = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        least = np.minimum.reduceat(hashes[at : at + 512, None] * _FACTORS + _TERMS, begin, axis=0)
        lowest[mine[begin]] = np.minimum(lowest[mine[begin]], least)
    # The smallest of n uniform hashes, as the smallest of n exponential ones.
    smallest = -np.log1p(-(lowest.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(np.maximum(smallest, 1e-300)) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def fingerprints(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums for each set; they do not depend on the order. Zero for empty sets."""
    out = []
    for lane in (a, b):
        sums = np.zeros(len(lane) + 1, np.uint64)
        np.cumsum(mix(lane), out=sums[1:])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, fp1, fp2, sketch of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, first, a, b in sets(batch["text"], shingle):
                n, sizes = len(first) - 1, np.diff(first)
                some = np.flatnonzero(sizes)
                made = np.full(n, None, object)
                for j, row in zip(some, registers(a, np.append(first[some], len(a))), strict=True):
                    made[j] = row.tobytes()
                one, two = fingerprints(first, a, b)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, n), batch["text_hash"].slice(i, n), pa.array(sizes), pa.array(one), pa.array(two), pa.array(made, pa.binary())], ["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(task, "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, sketch binary")


def _matrix(sketch: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketch.to_pylist()), np.uint16).reshape(len(sketch), BANDS * ROWS)


def buckets(nodes: DataFrame) -> DataFrame:
    """node, key, band: one row for each node and band."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.random.default_rng(5).integers(0, 2**63, ROWS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                made = _matrix(batch["sketch"]).reshape(-1, BANDS, ROWS)
                keys = mix(mix(made.astype(np.uint64) + np.uint64(1)) @ weights + salts)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch["node"]), BANDS)), pa.array(keys.view(np.int64).ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows))], ["node", "key", "band"])

    return nodes.select("node", "sketch").mapInArrow(task, "node long, key long, band int")


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest joint likelihood, given registers and set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    top = np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    best, found = np.full(len(u), -np.inf), np.zeros(len(u))
    for share in np.linspace(0.0, 1.0, 101):
        j = top * share
        p, q = chance(np.maximum(u - v * j, 0)), chance(np.maximum(v - u * j, 0))
        likely = more * np.log(p) + less * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-12, 1))
        better = likely > best
        best, found = np.where(better, likely, best), np.where(better, j, found)
    return found


def least_estimate(similarity: float) -> float:
    return similarity - DOUBT * np.sqrt(similarity * (1 - similarity) / (BANDS * ROWS))


def promising(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (hub, node) that the sketches do not rule out."""
    floor = least_estimate(similarity)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                keep = estimate(_matrix(batch["hub_sketch"]), _matrix(batch["sketch"]), np.asarray(batch["hub_n"]), np.asarray(batch["n_shingles"])) >= floor
                yield batch.select(["hub", "node"]).filter(pa.array(keep))

    counts = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("pairs"))
    hubs = materialize(nodes.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("sketch").alias("hub_sketch")).join(counts, "hub"), "hubs")
    # A hub of very many nodes is broadcast, the nodes stay where they are.
    near = join_counted(pairs, hubs, "hub", "pairs", pairs.count()).join(nodes.select("node", "n_shingles", "sketch"), "node")
    near = near.where(F.least("hub_n", "n_shingles") * 100 >= F.greatest("hub_n", "n_shingles") * round(similarity * 100))
    return near.select("hub", "node", "hub_n", "n_shingles", "hub_sketch", "sketch").mapInArrow(task, "hub long, node long")


def members(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, sketched: bool = False) -> DataFrame:
    """node, the fields of its places, a, b, n_shingles, sketch (or null): the sets of the wanted nodes in two lanes, made anew from one document each.

    ``wanted`` has node, places; a node's set is a row for each of its places. What meets a set
    so meets its text before, and sets are moved once, by the caller. They are not written besides.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp1, fp2 = np.asarray(batch["fp1"]), np.asarray(batch["fp2"])
            rows, held = [], 0

            def made() -> pa.RecordBatch:
                at, *columns = zip(*rows, strict=True)
                found = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([batch["node"].take(found), batch["places"].take(found), *(pa.array(c, pa.binary()) for c in columns)], ["node", "places", "a", "b", "sketch"])  # noqa: B023

            for i, first, a, b in sets(batch["text"], shingle):
                one, two = fingerprints(first, a, b)
                # A doc_id may be on several rows with different texts: the node's own text counts.
                for j in np.flatnonzero((one == fp1[i : i + len(one)]) & (two == fp2[i : i + len(one)])):
                    mine = slice(first[j], first[j + 1])
                    sketch = registers(a[mine], np.array([0, first[j + 1] - first[j]]))[0].tobytes() if sketched else None
                    rows.append((i + j, a[mine].tobytes(), b[mine].tobytes(), sketch))
                    held += len(rows[-1][1]) * 2
                if held > SEND_BYTES:
                    yield made()
                    rows, held = [], 0
            if rows:
                yield made()

    known = materialize(nodes.select("node", "doc_id", "fp1", "fp2").join(wanted, "node"), "wanted-sets")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(maybe_broadcast(known, BROADCAST_ROWS), "doc_id")
    places = known.schema["places"].dataType.simpleString()
    # Rows that repeat give a set twice, which changes nothing.
    found = texts.select("text", "node", "fp1", "fp2", "places").mapInArrow(collect, f"node long, places {places}, a binary, b binary, sketch binary")
    return found.select("node", F.explode("places").alias("place"), "a", "b", "sketch").select("node", "place.*", "a", "b", F.expr("length(a) div 8").alias("n_shingles"), "sketch")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_NODES = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("side", pa.int32()), ("band", pa.int32())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def similar(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], percent: int) -> bool:
    """100 * intersection >= percent * union, for sets in two lanes."""
    a, b = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    common = int(((a[1:] == a[:-1]) & (b[1:] == b[:-1])).sum())
    return 100 * common >= percent * (len(x[0]) + len(y[0]) - common)


def _set(a: pa.Scalar, b: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: the pairs (hub, node) whose full sets are similar enough.

    Each BLOCK_NODES of a hub's nodes make a part, to which the hub's set comes once.
    """
    percent = round(similarity * 100)
    sized = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NODES).alias("parts"))
    dealt = join_counted(pairs, sized, "hub", "parts", max(1, pairs.count() // BLOCK_NODES))
    dealt = materialize(dealt.select("hub", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node"), "dealt-pairs")
    hubs = dealt.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("node"))
    every = dealt.withColumn("is_hub", F.lit(False)).unionByName(hubs.withColumn("is_hub", F.lit(True)))
    sent = members(every.groupBy("node").agg(F.collect_list(F.struct("hub", "part", "is_hub")).alias("places")), nodes, docs, shingle)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            links = []
            for h, part, node, is_hub, a, b in zip(*(batch[c] for c in ("hub", "part", "node", "is_hub", "a", "b")), strict=True):
                here = (h.as_py(), part.as_py())
                if is_hub.as_py():
                    at, hub = here, _set(a, b)
                elif at == here and similar(hub, _set(a, b), percent):
                    links.append((h.as_py(), node.as_py()))
            if links:
                yield _rows(links, _LINKS)

    ordered = sent.repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("is_hub"))
    return ordered.select("hub", "part", "node", "is_hub", "a", "b").mapInArrow(compare, "a long, b long")


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole parts (key, part) of sorted batches, BUNDLE_ROWS together at least, and where each begins."""

    def bounds(table: pa.Table) -> np.ndarray:
        key, part = np.asarray(table["key"]), np.asarray(table["part"])
        return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BUNDLE_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            first = bounds(table)
            # The last part may go on in the next batch.
            if first[-1]:
                yield table.slice(0, first[-1]).combine_chunks(), np.append(first[:-1], first[-1])
                held = table.slice(first[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(bounds(table), table.num_rows)


def _dealt(entries: DataFrame) -> DataFrame:
    """``entries`` (key, node, root, n_shingles) dealt into parts: key, part, node, root, side.

    A bucket's nodes make blocks. Each part holds a block of the nodes outside the
    bucket's largest component (side 0) and a block of any nodes (side 1). The largest
    component is thus never compared with itself. A node that is in both blocks of a part
    is one row of it (side 2), so its sketch and its set come once.
    """
    rooted = entries.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    sizes = rooted.groupBy("key").agg(F.sum("n").alias("nodes"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "root", "shingles")).alias("most"))
    ceiling = [F.ceil(F.greatest(n / BLOCK_NODES, s / BLOCK_SHINGLES)) for n, s in ((F.col("nodes") - F.col("most.n"), F.col("shingles") - F.col("most.shingles")), (F.col("nodes"), F.col("shingles")))]
    sizes = materialize(sizes.select("key", "nodes", F.col("most.root").alias("main"), ceiling[0].alias("low"), ceiling[1].alias("high")), "bucket-blocks")
    known = join_counted(entries.select("key", "node", "root"), sizes, "key", "nodes", entries.count())
    h = F.xxhash64("node")
    others = known.where("root <> main").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1))).where(F.col("other") != F.pmod(h, "high"))
    rows = others.select("key", (F.pmod(h, "low") * F.col("high") + F.col("other")).alias("part"), "node", "root", F.lit(0).alias("side"))
    every = known.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("low") - 1)))
    both = (F.col("root") != F.col("main")) & (F.col("other") == F.pmod(h, "low"))
    return rows.unionByName(every.select("key", (F.col("other") * F.col("high") + F.pmod(h, "high")).alias("part"), "node", "root", F.when(both, 2).otherwise(1).alias("side")))


def _meet(dealt: DataFrame, compare: Callable[[pa.Table, np.ndarray], pa.RecordBatch], kind: str) -> DataFrame:
    """Runs ``compare`` on bundles of parts of buckets and sends on the rows that it returns."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _bundles(batches):
            yield compare(table, first)

    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "key", "part").sortWithinPartitions("key", "part").mapInArrow(task, kind)


def across(opened: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: links between nodes of different components that meet in a bucket.

    ``opened`` has key, band, node, root for the buckets with several components.
    """
    percent, floor = round(similarity * 100), least_estimate(similarity)
    entries = materialize(opened.join(nodes.select("node", "n_shingles"), "node"), "open-entries")
    dealt = _dealt(entries)
    sketched = dealt.join(entries.select("key", "band").distinct(), "key").join(nodes.select("node", "n_shingles", "sketch"), "node")

    def partners(table: pa.Table, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of side 0 with rows of side 1 of the same part, those of both included, that the sketches do not rule out."""
        roots, side, band = (np.asarray(table[c]) for c in ("root", "side", "band"))
        made, sizes = _matrix(table["sketch"].combine_chunks()), np.asarray(table["n_shingles"])

        def likely(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            equal = made[i] == made[j]
            # Nodes that meet in several buckets are compared in the first one.
            keep = (equal.mean(axis=1) >= floor - 0.1) & (equal.reshape(len(i), BANDS, ROWS).all(axis=2).argmax(axis=1) == band[i])
            i, j = i[keep], j[keep]
            keep = estimate(made[i], made[j], sizes[i], sizes[j]) >= floor
            return i[keep], j[keep]

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for begin, end in zip(first[:-1], first[1:], strict=True):
            columns = begin + np.flatnonzero(side[begin:end] != 0)
            for i in begin + np.flatnonzero(side[begin:end] != 1):
                j = columns[(roots[columns] != roots[i]) & (100 * np.minimum(sizes[columns], sizes[i]) >= percent * np.maximum(sizes[columns], sizes[i]))]
                held.append((np.full(len(j), i), j))
                if sum(len(x[1]) for x in held) >= PAIRS:
                    yield likely(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield likely(*map(np.concatenate, zip(*held, strict=True)))

    def by_sketch(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        keep = np.zeros(table.num_rows, bool)
        for i, j in partners(table, first):
            keep[i] = keep[j] = True
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(table[c])[keep]) for c in _NODES.names], schema=_NODES)

    def by_set(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        ids, roots = np.asarray(table["node"]), np.asarray(table["root"]).copy()
        a, b = table["a"].combine_chunks(), table["b"].combine_chunks()
        links = []
        for i, j in partners(table, first):
            for x, y in zip(i, j, strict=True):
                # Roots that have met are one; what they share needs no more links.
                if roots[x] != roots[y] and similar(_set(a[x], b[x]), _set(a[y], b[y]), percent):
                    links.append((int(ids[x]), int(ids[y])))
                    roots[roots == roots[y]] = roots[x]
        return _rows(links, _LINKS)

    sides = sketched.select("key", "part", "node", "root", "side", "band", "n_shingles", "sketch")
    left = materialize(_meet(sides, by_sketch, "key long, part long, node long, root long, side int, band int"), "promising-nodes")
    places = left.groupBy("node").agg(F.collect_list(F.struct("key", "part", "root", "side", "band")).alias("places"))
    whole = members(places, nodes, docs, shingle, sketched=True)
    return _meet(whole, by_set, "a long, b long")


def _hub_pairs(entries: DataFrame) -> DataFrame:
    """hub, node: each entry (key, node, n, weight) with its bucket's weightiest node; n counts the bucket."""
    first = entries.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("first"), F.first("n").alias("n"))
    hubs = materialize(first.select("key", F.col("first.node").alias("hub"), "n"), "bucket-hubs")
    met = join_counted(entries.select("key", "node"), hubs, "key", "n", entries.count())
    return materialize(met.where("node <> hub").select("hub", "node").distinct(), "hub-pairs")


def _decided(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row."""
    rows = materialize(sketches(docs, shingle), "sketches")
    alike = rows.where("sketch is not null and doc_id is not null").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    # Ids of nodes are given once and written; a fingerprint's half might not be unique.
    nodes = materialize(alike.withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = buckets(nodes)
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = materialize(entries.join(shared, "key"), "buckets")
    weights = entries.groupBy("node").agg(F.sum("n").alias("weight"))
    pairs = _hub_pairs(entries.join(weights, "node"))
    likely = materialize(promising(pairs, nodes, similarity), "candidates")
    links = materialize(verified(likely, nodes, docs, shingle, similarity), "verified")
    roots = materialize(components(links), "components")
    labelled = entries.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    opened = materialize(labelled.join(mixed, "key"), "open-buckets")
    if not opened.isEmpty():
        found = materialize(across(opened, nodes, docs, shingle, similarity), "links-across")
        if not found.isEmpty():
            roots = materialize(components(links.unionByName(found)), "components")
    rooted = nodes.join(roots, "node", "left").select("fp1", "fp2", "doc_id", F.coalesce("root", "node").alias("root"))
    label = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    copies = rows.groupBy("fp1", "fp2").agg(F.count(F.lit(1)).alias("copies"))
    # Nodes of one row that are their own component need no label.
    labels = materialize(rooted.join(label, "root").join(copies, ["fp1", "fp2"]).where("copies > 1 or component_id <> doc_id").select("fp1", "fp2", "component_id", "copies"), "labels")
    decided = join_counted(rows.drop("sketch"), labels, ["fp1", "fp2"], "copies", rows.count(), "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return decided.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _decided(docs, shingle, similarity).drop("text_hash")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with all their columns.

    A row is recognised by its doc_id and its text's hash, as a doc_id may be on
    several rows with different texts.
    """
    losers = _decided(docs, shingle, similarity).where("not kept").select("doc_id", "text_hash")
    return without_rows(docs, [F.col("doc_id").cast("long"), F.xxhash64("text")], losers)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read_table(spark, sf_dir, "documents"), shingle=4, similarity=0.8)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p, q FROM i JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM n UNION SELECT r.d, e.q FROM r JOIN e ON e.p = r.m),
k AS (SELECT d, min(m) AS component_id FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.component_id, w.doc_id) AS component_id,
       coalesce(k.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.d = w.doc_id
"""
