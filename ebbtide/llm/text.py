"""Vectorised word and shingle hashes over batches of whole texts (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: ASCII white space separates words; every other byte of the UTF-8 text belongs to one.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte that is no letter or digit separates words; bytes of other scripts belong to one.
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[:128] = [not chr(i).isalnum() for i in range(128)]

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(sizes: list[int], limit: int = 1 << 20) -> Iterator[slice]:
    """Consecutive runs of texts with at most `limit` characters together, or one longer text."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def word_hashes(texts: list[str], separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every lower-cased word, offsets): text i has words offsets[i] to offsets[i + 1]."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    ends_at = np.cumsum([len(r) + 1 for r in raw])
    word = ~separators[data]
    edge = np.diff(np.concatenate(([False], word, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    offsets = np.concatenate(([0], np.searchsorted(starts, ends_at)))
    return hashes, offsets


def shingles(texts: list[str], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of each text's distinct runs of `words` words, sorted.

    A text with fewer words has one shingle of all of them; a text without words has none.
    """
    hashes, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    rows = np.repeat(np.arange(len(texts)), counts)
    left = offsets[1:][rows] - np.arange(len(hashes))
    total = np.zeros(len(hashes), dtype=np.uint64)
    padded = np.concatenate((hashes, np.zeros(words, dtype=np.uint64)))
    for k in range(words):
        part = np.where(left > k, padded[k : k + len(hashes)], np.uint64(k + 1))
        total = mix(total * np.uint64(0x100000001B3) + part)
    first = np.arange(len(hashes)) == offsets[:-1][rows]
    keep = (left >= words) | (first & (counts[rows] < words))
    total, rows = total[keep], rows[keep]
    order = np.lexsort((total, rows))
    total, rows = total[order], rows[order]
    new = np.ones(len(total), dtype=bool)
    new[1:] = (total[1:] != total[:-1]) | (rows[1:] != rows[:-1])
    total, rows = total[new], rows[new]
    return total, np.searchsorted(rows, np.arange(len(texts) + 1))


def minhash(values: np.ndarray, offsets: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """One row of `size` 32-bit minima for each set; sets without members have zeros."""
    draw = np.random.default_rng(seed)
    factors = draw.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(offsets) - 1, size), dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for k in range(size):
            out[full, k] = np.minimum.reduceat((values * factors[k]) >> np.uint64(32), offsets[:-1][full])
    return out
