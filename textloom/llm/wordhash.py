"""Vectorised 64-bit hashes of words and of runs of words, in independent lanes.

Works on the bytes of an Arrow string array as they are, so a task never builds
Python strings for words. Words are maximal runs of bytes outside 0x09-0x0D and
0x20, unless another table of separating bytes is given; a null or empty text has
none. With ``fold`` the letters A-Z count as a-z.

A word is read eight bytes at a time, all words of a block together. Each step adds
eight bytes to the state and sends it through a bijection, so words that differ in
one place never meet again by structure. Words beyond LONG bytes are hashed by
BLAKE2. A run's hash is put together from the hashes of its halves, each time through
the same bijection. Lanes start from different seeds; two lanes make 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end a word: white space, or every ASCII byte but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.arange(256) < 128
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_SEEDS = np.random.default_rng(20240607).integers(0, 2**63, 2, dtype=np.int64).astype(np.uint64)
_LEFT = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of text hashed at a time; a single longer text is hashed whole.
BLOCK = 1 << 17
#: Longer words are hashed one by one.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of one sequence followed by another, from theirs."""
    return mix(a * _LEFT + b)


class Words:
    """Words of a block of texts: ``first[i]:first[i+1]`` are those of text i."""

    def __init__(self, body: np.ndarray, ends: np.ndarray, fold: bool = False, ends_word: np.ndarray = WHITE):
        """``body[ends[i]:ends[i+1]]`` are the bytes of text i."""
        n = len(body)
        black = ~ends_word[body]
        edge = np.zeros(n + 1, bool)
        edge[ends] = True
        starts, stops = black.copy(), black.copy()
        starts[1:] &= ~black[:-1] | edge[1:n]
        stops[:-1] &= ~black[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, ends)
        # Eight bytes can be read from every place, the last one included.
        self._bytes = np.zeros(n + 8, np.uint8)
        self._bytes[:n] = _FOLDED[body] if fold else body
        self._eights = np.ndarray((n + 1,), "<u8", self._bytes, strides=(1,))
        self._lanes: dict[int, np.ndarray] = {}

    @property
    def hashes(self) -> np.ndarray:
        return self.lane(0)

    def lane(self, lane: int) -> np.ndarray:
        """One hash for each word."""
        if lane not in self._lanes:
            size = self.end - self.start
            h = mix(size.astype(np.uint64) + _SEEDS[lane])
            h = mix(h ^ self._eights[self.start] & _MASKS[np.minimum(size, 8)])
            at, step = np.flatnonzero((size > 8) & (size <= LONG)), 8
            while len(at):
                more = self._eights[self.start[at] + step] & _MASKS[np.minimum(size[at] - step, 8)]
                h[at] = mix(h[at] ^ more)
                step += 8
                at = at[size[at] > step]
            for i in np.flatnonzero(size > LONG):
                digest = hashlib.blake2b(self._bytes[self.start[i] : self.end[i]], digest_size=8, key=bytes([lane])).digest()
                h[i] = np.frombuffer(digest, "<u8")[0]
            self._lanes[lane] = h
        return self._lanes[lane]

    def prefixes(self, which: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the first ``size`` (at most 8) bytes of the words that a mask picks."""
        return mix(mix(self._eights[self.start[which]] & _MASKS[size]) + np.uint64(size << 32))

    def runs(self, length: int, lane: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each word on; garbage where the block has fewer left."""
        power, left, h, out = 1, length, self.lane(lane), None
        covered = 0
        while left:
            if left & 1:
                # The part behind what is covered so far.
                part = _ahead(h, covered)
                out = part if out is None else joined(out, part)
                covered += power
            left >>= 1
            if left:
                h = joined(h, _ahead(h, power))
                power *= 2
        return out

    def few(self, which: np.ndarray, count: int, lane: int = 0) -> np.ndarray:
        """Hashes of the first ``count`` words of some texts, as one sequence that is no run."""
        h, at = self.lane(lane), self.first[which]
        out = np.full(len(at), _SEEDS[lane] ^ np.uint64(count))
        for i in range(count):
            out = joined(out, h[at + i])
        return out


def _ahead(h: np.ndarray, by: int) -> np.ndarray:
    """Every value's successor ``by`` places on; zero past the end."""
    if not by:
        return h
    out = np.zeros_like(h)
    out[:-by] = h[by:]
    return out


def blocks(texts: pa.Array, fold: bool = False, ends_word: np.ndarray = WHITE) -> Iterator[tuple[int, int, Words]]:
    """Yields (index of the first text, number of texts, Words) over about BLOCK bytes each."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
        yield i, j - i, Words(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i], fold, ends_word)
        i = j
