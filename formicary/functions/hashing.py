"""Seeded hash families."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Bytes of a text up to which it is hashed along with others.
LONG = 4096


def hex_hash(i: Column, x: Column) -> Column:
    """Member i of the default family: eight hex digits of SHA-256 over `i:x`, fixed width and lower case."""
    return F.substring(F.sha2(F.concat(i.cast("string"), F.lit(":"), x), 256), 1, 8)


def hash_value(i: Column, x: Column) -> Column:
    """The same as a number below 2**32."""
    return F.conv(hex_hash(i, x), 16, 10).cast("long")


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit, from the published algorithm; unsigned."""
    c1, c2, m = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF
    h, n = seed & m, len(data)
    for k in np.frombuffer(data[: n & ~3], "<u4").tolist():
        k = k * c1 & m
        k = (k << 15 | k >> 17) & m
        h ^= k * c2 & m
        h = (h << 13 | h >> 19) & m
        h = (h * 5 + 0xE6546B64) & m
    tail = int.from_bytes(data[n & ~3 :], "little")
    if n & 3:
        k = tail * c1 & m
        k = (k << 15 | k >> 17) & m
        h ^= k * c2 & m
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint32(bits) | x >> np.uint32(32 - bits)


def murmur3_array(texts: pa.Array, seeds: np.ndarray) -> np.ndarray:
    """murmur3_32 of every text in UTF-8 as uint32, word by word over all rows; nulls are hashed as empty.

    Texts of more than LONG bytes are hashed one at a time, so that one of them doesn't set the number of rounds.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.concatenate([np.frombuffer(body, np.uint8) if body else np.empty(0, np.uint8), np.zeros(4, np.uint8)])
    size = np.diff(offsets)
    out = np.empty(len(texts), np.uint32)
    for k in np.flatnonzero(size > LONG):
        out[k] = murmur3_32(texts[int(k)].as_py(), int(seeds[k]))
    short = np.flatnonzero(size <= LONG)
    short = short[np.argsort(-size[short], kind="stable")]  # longest first: those with a word left come first
    at, n, h = offsets[:-1][short], size[short], seeds[short].astype(np.uint32)
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    for word in range(int(n[0]) // 4 if len(n) else 0):
        live = int(np.searchsorted(-(n // 4), -word, "left"))
        spots = at[:live] + 4 * word
        k = data[spots[:, None] + np.arange(4)].view("<u4").ravel()
        h[:live] = _rotated(h[:live] ^ _rotated(k * c1, 15) * c2, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    rest = n & 3
    tail = data[(at + (n & ~3))[:, None] + np.arange(4)] * (np.arange(4) < rest[:, None])
    h ^= _rotated(tail.astype(np.uint8).view("<u4").ravel() * c1, 15) * c2  # 0 without a tail
    h ^= n.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    out[short] = h ^ h >> np.uint32(16)
    return out


@F.pandas_udf(LongType())
def murmur3(x: pd.Series, seed: pd.Series) -> pd.Series:
    """Seeded Murmur3 of strings as a signed 32-bit number; null for null (text or seed)."""
    missing = x.isna() | seed.isna()
    seeds = seed.fillna(0).to_numpy(np.int64).astype(np.uint32)
    found = murmur3_array(pa.array(x, pa.string(), from_pandas=True), seeds).view(np.int32).astype(np.int64)
    return pd.Series(found, dtype="Int64").mask(missing.reset_index(drop=True))
