"""Removal of word sequences that occur more than once in a corpus: seeds, then window counts.

Seeds: of the runs of ``seed`` words in each window of ``window`` words the one with
the smallest hash is an anchor (winnowing). Two equal windows pick the same anchor,
so every repeat of at least ``window`` words holds an anchor that repeats.

Windows: those that chose an anchor that occurs again are hashed whole and their hashes
counted over the corpus. This stands for extending pairs of occurrences both ways,
which would make a pair of every two copies in a large group. What is removed is the union of
the windows that start at least twice, that is, every maximal repeat of at least
``window`` words, all its occurrences included.

Both comparisons use one routine, ``repeated``: blocks of hashes are deduplicated
where they are, cut into hash ranges of bounded size, compared per range, and
answered with one bit per hash. A hash that a third of all documents share thus
arrives once per block, no pairs are made, and no row is kept per window. Anchors,
which only say where to look, are compared by 64 bits, and the windows, which are
removed, by 128 bits from two independent hashes of their words.

Defined results: words are runs of anything but space and 0x09-0x0D; a null text has
none. Rows that repeat a doc_id and its text count as two occurrences and get the
same result; a null doc_id is a value of its own. Texts of fewer words than a window
are kept whole. An empty table gives an empty result. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.wordhash import Words, blocks
from textloom.storage import materialize, read_table

WINDOW, SEED = 35, 16
#: Hashes of a block, and of a range that one task compares.
BLOCK_HASHES, RANGE_HASHES = 1 << 18, 1 << 19
#: Bytes of text of a block.
BLOCK_TEXT = 8 << 20


def anchors(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts of a block of texts, the anchor of each as an index, anchor places and hashes."""
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(words.hashes))
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        return starts, starts, starts, np.zeros(0, np.uint64)
    seeds = words.runs(seed)
    chosen = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1)[starts].argmin(axis=1) + starts
    # Places never go back from one window to the next.
    new = np.append(True, chosen[1:] != chosen[:-1])
    return starts, np.cumsum(new) - 1, chosen[new], seeds[chosen[new]]


def _grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows of ``h``, group of each row in that order, and size of each group of equal rows."""
    order = np.lexsort(h.T[::-1])
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]).any(axis=1)
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group) if len(group) else np.zeros(0, int)


def seed_hashes(h: pa.Scalar) -> np.ndarray:
    return np.frombuffer(h.as_py(), np.uint64).reshape(-1, 1)


def window_hashes(window: int) -> Callable[[pa.Scalar, pa.Scalar], np.ndarray]:
    """Two hashes of each asked window of a block's texts, made anew, which costs less than to keep them."""

    def read(texts: pa.Scalar, asked: pa.Scalar) -> np.ndarray:
        out, masks = [np.zeros((0, 2), np.uint64)], asked.as_py()
        for i, n, words in blocks(texts.values):
            runs = np.stack([words.runs(window, lane) for lane in (0, 1)], axis=1)
            for j in range(n):
                begin, end = words.first[j], words.first[j + 1] - window + 1
                out.append(runs[begin:end][_bits(masks[i + j], int(end - begin))])
        return np.concatenate(out)

    return read


def repeated(table: DataFrame, columns: list[str], read: Callable[..., np.ndarray], lanes: int) -> DataFrame:
    """block, parts: by range, one bit for each different hash of a block, set when other blocks have it.

    ``flagged`` reads them. ``table`` is materialised and has block (unique), hashes (their number) and the
    ``columns`` from which ``read`` makes them, ``lanes`` uint64 values each. A block sends one row to each
    range that it meets, at most one for each of its hashes.
    """
    total = table.agg(F.sum("hashes")).first()[0] or 0
    # Ranges are those of a hash's first bits, so what a block costs does not grow with their number.
    bits = int(total // RANGE_HASHES).bit_length()

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *given in zip(batch["block"].to_pylist(), *(batch[c] for c in columns), strict=True):
                h = read(*given)
                order, group, _ = _grouped(h)
                once = h[order[np.flatnonzero(np.diff(group, prepend=-1))]]
                met, at = np.unique(once[:, 0] >> np.uint64(64 - bits) if bits else np.zeros(len(once), np.uint64), return_index=True)
                rows = [(int(i), block, once[a:b].tobytes()) for i, a, b in zip(met, at, np.append(at, len(once))[1:], strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["part", "block", "h"])

    def compare(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, lanes) for x in group["h"]]
        order, at, counts = _grouped(np.concatenate(parts))
        flags = np.zeros(len(order), bool)
        flags[order] = counts[at] > 1
        bits = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum([len(p) for p in parts])[:-1])]
        return pa.table({"block": group["block"], "part": group["part"], "n": pa.array([len(p) for p in parts], pa.int64()), "bits": pa.array(bits, pa.binary())})

    scattered = table.select("block", *columns).mapInArrow(scatter, "part long, block long, h binary")
    compared = scattered.groupBy("part").applyInArrow(compare, "block long, part long, n long, bits binary")
    return compared.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "n", "bits"))).alias("parts"))


def flagged(h: np.ndarray, parts: list[dict]) -> np.ndarray:
    """Whether each hash of a block occurs twice in the table."""
    order, at, counts = _grouped(h)
    known = [np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["n"]) for p in parts]
    twice = np.concatenate(known or [np.zeros(0, np.uint8)]).astype(bool) | (counts > 1)
    flags = np.zeros(len(order), bool)
    flags[order] = twice[at]
    return flags


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("text").alias("k"), "text")


def seeds(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Blocks of anchors: block, d and k of the documents, n of their anchors, and the hashes h."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal block
            block += 1
            d, k, n, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([d]), pa.array([k]), pa.array([n]), pa.array([h.tobytes()])], ["block", "d", "k", "n", "h"])

        for batch in batches:
            d, k = np.asarray(batch["d"]), np.asarray(batch["k"])
            for i, n, words in blocks(batch["text"]):
                _, _, places, hashes = anchors(words, window, seed)
                each = np.diff(np.searchsorted(places, words.first))
                some = each > 0
                held.append((d[i : i + n][some], k[i : i + n][some], each[some], hashes))
                if sum(len(x[3]) for x in held) >= BLOCK_HASHES:
                    yield flush()
        if any(len(x[3]) for x in held):
            yield flush()

    return materialize(_ids(docs).select("d", "k", "text").mapInArrow(task, "block long, d array<long>, k array<long>, n array<long>, h binary"), "seeds")


def marks(found: DataFrame) -> DataFrame:
    """d, k, marks: for each document with a repeated anchor, one bit per anchor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, k, n, h, parts in zip(*(batch[c] for c in ("d", "k", "n", "h", "parts")), strict=True):
                d, k, n = (np.array(x.as_py(), np.int64) for x in (d, k, n))
                each = np.split(flagged(seed_hashes(h), parts.as_py()), np.cumsum(n)[:-1])
                some = np.array([x.any() for x in each], bool)
                yield pa.RecordBatch.from_arrays([pa.array(d[some]), pa.array(k[some]), pa.array([np.packbits(x).tobytes() for x, s in zip(each, some, strict=True) if s], pa.binary())], ["d", "k", "marks"])

    counted = found.withColumn("hashes", (F.octet_length("h") / 8).cast("long"))
    known = found.join(repeated(counted, ["h"], seed_hashes, 1), "block").select("d", "k", "n", "h", "parts")
    # Rows that repeat a document have the same marks.
    return materialize(known.mapInArrow(task, "d long, k long, marks binary").dropDuplicates(["d", "k"]), "marks")


_EXTENDED = "block long, doc_id array<long>, text array<string>, n array<long>, asked array<binary>, hashes long, one long, n_words long, kept_sha256 string"


def extend(docs: DataFrame, marked: DataFrame, window: int, seed: int) -> DataFrame:
    """Documents without a mark, finished; blocks of the others with the hashes of the windows in question."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = hashes = 0
        names = [x.split()[0] for x in _EXTENDED.split(", ")]

        def flush() -> pa.RecordBatch:
            nonlocal block, size, hashes
            block += 1
            ids, texts, n, asked = zip(*held, strict=True)
            held.clear()
            count, size, hashes = hashes, 0, 0
            rows = [pa.array([block]), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(texts)], pa.list_(pa.string())), pa.array([list(n)], pa.list_(pa.int64())), pa.array([list(asked)], pa.list_(pa.binary())), pa.array([count], pa.int64())]
            return pa.RecordBatch.from_arrays([*rows, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string())], names)

        for batch in batches:
            ids, known = batch["doc_id"].to_pylist(), batch["marks"].to_pylist()
            done: list[tuple] = []
            for i, n, words in blocks(batch["text"]):
                if any(m is not None for m in known[i : i + n]):
                    starts, anchor, places, _ = anchors(words, window, seed)
                    at, of = np.searchsorted(starts, words.first), np.searchsorted(places, words.first)
                for j in range(n):
                    text, mark = batch["text"][i + j].as_py() or "", known[i + j]
                    count = int(words.first[j + 1] - words.first[j])
                    if mark is None:
                        done.append((ids[i + j], count, hashlib.sha256(b" ".join(text.encode().split())).hexdigest()))
                        continue
                    asked = _bits(mark, int(of[j + 1] - of[j]))[anchor[at[j] : at[j + 1]] - of[j]]
                    held.append((ids[i + j], text, count, np.packbits(asked).tobytes()))
                    size, hashes = size + len(text), hashes + int(asked.sum())
                    if size >= BLOCK_TEXT or hashes >= BLOCK_HASHES:
                        yield flush()
            if done:
                one, n_words, kept = zip(*done, strict=True)
                n = len(done)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.int64()), pa.array(one, pa.int64()), pa.array(n_words, pa.int64()), pa.array(kept)], names)
        if held:
            yield flush()

    joined = _ids(docs).join(marked.hint("shuffle_hash"), ["d", "k"], "left").select("doc_id", "text", "marks")
    return materialize(joined.mapInArrow(task, _EXTENDED), "extended")


def cut(extended: DataFrame, window: int, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of the documents in blocks."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    read = window_hashes(window)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, counts, asked, parts, *given in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "n", "asked", "parts")), batch["text"], batch["asked"], strict=True):
                found, at, rows = flagged(read(*given), parts), 0, []
                for doc_id, text, n, mask in zip(ids, texts, counts, asked, strict=True):
                    windows = np.flatnonzero(_bits(mask, n - window + 1))
                    hit = windows[found[at : at + len(windows)]]
                    at += len(windows)
                    change = np.zeros(n + 1, np.int64)
                    change[hit] += 1
                    change[hit + window] -= 1
                    gone = np.cumsum(change[:n]) > 0
                    kept = b" ".join(compress(text.encode().split(), ~gone))
                    rows.append((doc_id, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])

    asked = extended.where("block is not null")
    return asked.join(repeated(asked, ["text", "asked"], read, 2), "block").select("doc_id", "text", "n", "asked", "parts").mapInArrow(task, schema)


def removals(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    extended = extend(docs, marks(seeds(docs, window, seed)), window, seed)
    whole = extended.where("block is null").select(F.col("one").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return whole.unionByName(cut(extended, window))


def kept_texts(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id and kept_text of the rows that lose words."""
    return cut(extend(docs, marks(seeds(docs, window, seed)), window, seed), window, keep_text=True).where("n_removed > 0").select("doc_id", "kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i+34], ' ')))) AS s FROM w WHERE len(w) >= 35),
r AS (SELECT doc_id, p FROM g JOIN (SELECT s FROM g GROUP BY s HAVING count(*) > 1) USING (s)),
x AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM r) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))) END, ' ')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id)
"""
