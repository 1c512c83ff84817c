"""Hashes of words, of word shingles, and MinHash signatures, for whole Arrow batches at once.

Words are maximal runs of characters other than space and the controls from tab to carriage return, with A-Z lower-cased.
The hash of a word of up to 16 bytes mixes all these bytes; of a longer word it is a cryptographic digest of 64 bits, so no
pattern in texts makes words collide. A null or empty text has no words.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes that are read as two numbers.
SHORT = 16
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, "u8")]), dtype="u8") for b in (_BASE, _INVERSE))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offset of each text in them; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each stretch of `data` as two numbers; where a stretch ends before, zeros follow."""
    held = np.concatenate([data, np.zeros(16, "u1")])
    at = np.ndarray(len(data) + 9, "<u8", held, 0, (1,))
    out = []
    for skip in (0, 8):
        left = np.clip(ends - starts - skip, 0, 8)
        mask = np.where(left == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(left, 7) * 8).astype("u8")) - np.uint64(1))
        out.append(at[np.minimum(starts + skip, len(data))] & mask)
    return out[0], out[1]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte (in the text) of every word, and per text the index of its first word, with the end."""
    data, offsets = bytes_of(texts)
    low = _LOWER[data]
    solid = ~_SPACE[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after = np.concatenate([[True], ~solid[:-1]]) if len(data) else np.zeros(0, bool)
    starts = np.flatnonzero(solid & (after | edge[:-1]))
    before = np.concatenate([~solid[1:], [True]]) if len(data) else np.zeros(0, bool)
    ends = np.flatnonzero(solid & (before | edge[1:])) + 1
    size = (ends - starts).astype("u8")
    one, two = first_bytes(low, starts, ends)
    hashes = mix64(mix64(one + np.uint64(0x9E3779B97F4A7C15)) ^ mix64(two * np.uint64(0x9FB21C651E98DF25) + size))
    long = np.flatnonzero(size > SHORT)
    if len(long):
        buffer = memoryview(low.tobytes())
        digests = b"".join(hashlib.blake2b(buffer[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        hashes[long] = np.frombuffer(digests, "<u8")
    first = np.searchsorted(starts, offsets)
    base = np.repeat(offsets[:-1], np.diff(first))
    return hashes, starts - base, ends - base, first


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles, sorted; the whole sequence is one if it is shorter."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    m = len(words) - k + 1
    out = np.full(m, np.uint64(k))
    for i in range(k):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + words[i : i + m])
    return np.unique(out)


@functools.cache
def _coordinates(k: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(11)
    return random.integers(0, 1 << 64, k, "u8") | np.uint64(1), random.integers(0, 1 << 64, k, "u8")


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """The least 32-bit value of the shingles under each of k hash functions."""
    factor, shift = _coordinates(k)
    least, step = np.full(k, np.iinfo("u4").max, "u4"), max(64, (1 << 17) // k)
    for at in range(0, len(shingles), step):
        values = ((shingles[at : at + step, None] ^ shift) * factor) >> np.uint64(32)
        least = np.minimum(least, values.min(axis=0).astype("u4"))
    return least
