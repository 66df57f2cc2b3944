"""Hashes of tokens into sparse dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 17


def md5_bucket(token: Column, buckets: int = BUCKETS) -> Column:
    """The first 32 bits of the MD5, modulo ``buckets``: the same in every engine."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 for 32-bit platforms, as published, without sign."""
    c1, c2, mask = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF

    def scramble(k: int) -> int:
        k = k * c1 & mask
        return ((k << 15 | k >> 17) & mask) * c2 & mask

    h, whole = seed, len(data) // 4 * 4
    for k in np.frombuffer(data[:whole], "<u4").tolist():
        h ^= scramble(k)
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & mask
    if whole < len(data):
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


#: Bytes up to which tokens are hashed together.
_TOGETHER = 64


def murmur3_all(tokens: list[bytes]) -> np.ndarray:
    """``murmur3`` of each token, short ones all at once."""
    out = np.zeros(len(tokens), np.uint32)
    sizes = np.array([len(t) for t in tokens], np.uint32)
    for i in np.flatnonzero(sizes > _TOGETHER):
        out[i] = murmur3(tokens[i])
    short = np.flatnonzero(sizes <= _TOGETHER)
    if not len(short):
        return out
    n = sizes[short]
    width = (int(n.max()) // 4 + 1) * 4
    k = np.frombuffer(b"".join(tokens[i].ljust(width, b"\0") for i in short), "<u4").reshape(len(short), -1).astype(np.uint32)

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint32(by) | x >> np.uint32(32 - by)

    # Zeros fill the last word up, as they do in the tail of the hash.
    k = turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h, whole = np.zeros(len(short), np.uint32), n // 4
    for at in range(k.shape[1]):
        mixed = h ^ k[:, at]
        full = turned(mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h = np.where(at < whole, full, np.where((at == whole) & (n % 4 > 0), mixed, h))
    h ^= n
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    out[short] = h ^ h >> np.uint32(16)
    return out


@F.pandas_udf(T.IntegerType())
def murmur3_bucket(tokens: pd.Series) -> pd.Series:
    """Exact MurmurHash3 (x86, 32 bits, seed 0) modulo 2**17; each distinct token of a batch is hashed once."""
    codes, names = pd.factorize(tokens)
    hashed = (murmur3_all([x.encode() for x in names] or [b""]) % BUCKETS).astype(np.int32)
    return pd.Series(hashed[codes]).where(pd.Series(codes) >= 0)
