"""Hierarchical packing of documents into windows of several lengths.

Each partition of the input packs its own documents, so nothing is shuffled. The
full windows of a long document go out at once. What is left of it, and every
shorter document, is routed to the smallest tier that holds it. Tiers are packed
from the longest down: a piece opens a window of its tier, the gap is filled with
the longest pieces of shorter tiers that fit, and at last with a cut of one that
does not. When no shorter piece is left, the opening piece is cut at the largest
power of two in it. Every window is then full at its own length, and only the
end of a partition makes windows below the shortest tier.

Windows of equal length make step groups of equal token counts (``step_tokens``).

Defined results: a null text is empty and consists of the closing id alone; rows
that repeat a doc_id are packed each for itself; a null doc_id stays null; an empty
table packs to an empty table. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.tokens import encode
from textloom.storage import read_table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"
_ARROW = pa.schema([pa.field(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])
#: Shortest and longest window, tokens of a step group, tokens held back in a task for packing.
TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 1 << 15
HELD_TOKENS = 1 << 22


class Packer:
    """Packs the pieces of one partition; ``rows`` collects what is placed."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, partition: int):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers are ascending powers of two")
        self.tiers, self.step_tokens, self.base = tiers, step_tokens, partition << 40
        self.longest = tiers[-1]
        self.windows = 0
        self.made: dict[int, int] = {}
        self.rows: list[tuple] = []
        self._clear()

    def _clear(self) -> None:
        self.by_length: list[list[tuple]] = [[] for _ in range(self.longest + 1)]
        self.present = 0
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw, n = ids.astype("<u4").tobytes(), len(ids)
        at = 0
        while n - at >= self.longest:
            self._window([(doc_id, at, self.longest, n, raw[4 * at : 4 * (at + self.longest)])], self.longest)
            at += self.longest
        if at < n:
            self._hold((doc_id, at, n - at, n, raw[4 * at :]))

    def _hold(self, piece: tuple) -> None:
        self.by_length[piece[2]].append(piece)
        self.present |= 1 << piece[2]
        self.held += piece[2]

    def _take(self, length: int) -> tuple:
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.present ^= 1 << length
        self.held -= length
        return piece

    @staticmethod
    def _cut(piece: tuple, length: int) -> tuple[tuple, tuple]:
        doc_id, start, size, total, raw = piece
        return (doc_id, start, length, total, raw[: 4 * length]), (doc_id, start + length, size - length, total, raw[4 * length :])

    def pack(self) -> None:
        """Places all pieces that are held."""
        while self.present:
            piece = self._take(self.present.bit_length() - 1)
            size = next((t for t in self.tiers if t >= piece[2]))
            pieces, gap = [piece], size - piece[2]
            if gap and self.held < gap:
                # Too little is left to fill a window of this tier.
                size = 1 << (piece[2].bit_length() - 1)
                head, rest = self._cut(piece, size) if size < piece[2] else (piece, None)
                if rest:
                    self._hold(rest)
                self._window([head], size)
                continue
            while gap:
                fits = self.present & ((1 << (gap + 1)) - 1)
                if fits:
                    pieces.append(self._take(fits.bit_length() - 1))
                else:
                    longer = self.present >> (gap + 1)
                    head, rest = self._cut(self._take(gap + 1 + (longer & -longer).bit_length() - 1), gap)
                    self._hold(rest)
                    pieces.append(head)
                gap -= pieces[-1][2]
            self._window(pieces, size)
        self._clear()

    def _window(self, pieces: list[tuple], size: int) -> None:
        sequence, offset = self.base + self.windows, 0
        nth = self.made.get(size, 0)
        group = self.base + ((size.bit_length() - 1) << 32) + nth // max(1, self.step_tokens // size)
        self.windows, self.made[size] = self.windows + 1, nth + 1
        for doc_id, start, length, total, raw in pieces:
            self.rows.append((doc_id, start, length, zlib.crc32(raw), total, sequence, offset, size, group))
            offset += length

    def drain(self) -> pa.RecordBatch | None:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW) if rows else None


def pack(
    docs: DataFrame,
    ranks: str,
    tokenizer: str | None = None,
    closing_id: int = 0,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: where it comes from, its checksum, its window and its place there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                packer.add(doc_id, np.append(encode(text.as_py(), ranks, tokenizer), np.uint32(closing_id)))
                if packer.held >= HELD_TOKENS:
                    packer.pack()
                if len(packer.rows) >= 20_000:
                    yield packer.drain()
        packer.pack()
        if packer.rows:
            yield packer.drain()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task, SCHEMA)


def production(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public

    return pack(docs, public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production(read_table(spark, sf_dir, "documents"))
