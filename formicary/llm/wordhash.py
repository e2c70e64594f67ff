"""Word, window and MinHash arithmetic over whole batches of texts, in numpy.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes. A word's hash is its polynomial over 2**64
(prefix sums give all words of a slice at once), followed by an invertible mixer; it doesn't depend
on process, batch or position. Equal words always have equal hashes; two different words among n
distinct ones agree with probability about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLAIN = np.arange(256, dtype=np.uint8)
FOLDED = PLAIN.copy()
FOLDED[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept for the longest n so far."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE + 1)
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        have = _powers[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix64, an invertible map."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_slice(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, number of words before each offset) of one slice."""
    n = len(flat)
    inside = np.zeros(n + 2, bool)
    np.logical_not(SPACE[flat], out=inside[1 : n + 1])
    starts = inside[1 : n + 1] & ~inside[:n]
    ends = inside[1 : n + 1] & ~inside[2:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    starts[cut] = inside[cut + 1]
    ends[cut - 1] = inside[cut]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((table[flat].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[last + 1] - sums[first]) * down[first]), np.searchsorted(first, offsets)


def word_slices(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLDED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, word hashes, word offsets by row) for runs of rows of about SLICE bytes.

    A text longer than a slice is a run of its own, hashed piece by piece between words, so that the
    working memory follows its number of words and not a multiple of its bytes.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        end = min(end, rows)
        lo, hi = offsets[row], offsets[end]
        if hi - lo <= SLICE:
            hashes, counts = _hash_slice(flat[lo:hi], offsets[row : end + 1] - lo, table)
            yield row, end, hashes, counts
        else:
            parts, at = [], lo
            while at < hi:
                to = min(at + SLICE, hi)
                while to < hi:
                    gap = np.flatnonzero(SPACE[flat[at:to]])
                    if len(gap):
                        to = at + int(gap[-1]) + 1
                        break
                    to = min(to + SLICE, hi)
                parts.append(_hash_slice(flat[at:to], np.array([0, to - at]), table)[0])
                at = to
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield row, end, hashes, np.array([0, len(hashes)])
        row = end


def windows(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of each window of `size` words, and each row's number of windows.

    A row with some words but fewer than `size` has its whole sequence as one window.
    """
    per_row = np.diff(counts)
    full = np.maximum(per_row - size + 1, 0)
    short = (per_row > 0) & (per_row < size)
    n = full + short
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    at = counts[:-1][row] + np.arange(ends[-1] if len(ends) else 0) - (ends - n)[row]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    wide = np.minimum(per_row, size)[row]
    out = wide.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for k in range(size):
            part = padded[at + k]
            if short.any():
                part = np.where(k < wide, part, np.uint64(0))
            out = out * np.uint64(0xFF51AFD7ED558CCD) + mix(part + np.uint64(k + 1))
    return mix(out), row, n


def distinct_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes sorted within each row, offsets by row)."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(n_rows + 1))


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n members (a odd, b) of the universal family x -> a*x + b modulo 2**32."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, n, np.uint32)


def minhash(hashes: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Minima (rows x permutations) of a*x+b over each row's hashes; a row without any has all ones.

    The 64-bit hash is folded to 32 bits; rows are taken in blocks that stay in the CPU's cache.
    """
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full((len(offsets) - 1, len(a)), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    starts = offsets[some]
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + block)))
        lo, hi = starts[at], offsets[some[min(to, len(some)) - 1] + 1]
        rows, cut = some[at:to], starts[at:to] - lo
        for p in range(0, hi - lo, block) if to == at + 1 else (0,):
            part = x[lo + p : min(lo + p + block, hi)] if to == at + 1 else x[lo:hi]
            for k in range(len(a)):
                got = np.minimum.reduceat(part * a[k] + b[k], cut) if to > at + 1 else (part * a[k] + b[k]).min()
                out[rows, k] = np.minimum(out[rows, k], got)
        at = to
    return out
