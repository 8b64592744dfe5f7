"""Features of texts in numpy: 64-bit hashes with their counts, a text at a time.

Two features of unlike text share a hash with a probability of 2^-64, as among
the shingles' hashes of the joins.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
BASE, STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: Characters whose features are made at once; a longer text is taken whole.
CHUNK = 1 << 18
Counted = tuple[np.ndarray, np.ndarray]
_powers = [np.ones(1, U), np.ones(1, U)]


def release() -> None:
    """Give memory that the allocators keep back to the system: idle workers live on beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the input in every bit of the hash."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n: int) -> list[np.ndarray]:
    """Powers of ``BASE`` and of its inverse, from 0 to n at least."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(1 << n.bit_length(), b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def distinct(h: np.ndarray) -> Counted:
    """Sorted, without repeats, and how often each occurred."""
    h = np.sort(h)
    if not len(h):
        return h, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.diff(first, append=len(h))


def binary(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of binaries that hold numbers, without a copy."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data.view(kind), (at - at[0]) // np.dtype(kind).itemsize


def points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a column of strings; null is empty."""
    col = col.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), begun[at - at[0]]


def _grams(p: np.ndarray, words: tuple[int, ...], chars: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray | None, int]]:
    """Of each kind: (hashes, where the words begin if it is of words, how many one takes)."""
    out, c, size = [], p.astype(U) + U(1), len(p)
    h = c
    for n in range(1, max(chars, default=0) + 1):
        if n > 1:
            h = h[: max(size - n + 1, 0)] * U(BASE) + c[n - 1 :]
        if n in chars:
            out.append((mixed(h ^ U(STEP * (2 * n) % (1 << 64))), None, n))
    if words:
        gap = np.concatenate([[True], p == 32, [True]])
        start, end = (np.flatnonzero(x) for x in (gap[:-2] & ~gap[1:-1], ~gap[1:-1] & gap[2:]))
        pw, inv = powers(size + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(c * pw[:size])])
        h = one = mixed((sums[end + 1] - sums[start]) * inv[start])
        for n in range(1, max(words) + 1):
            if n > 1:
                h = h[: max(len(one) - n + 1, 0)] * U(BASE) + one[n - 1 :]
            if n in words:
                out.append((mixed(h ^ U(STEP * (2 * n + 1) % (1 << 64))), start, n))
    return out


def counted(col: pa.Array, words: tuple[int, ...], chars: tuple[int, ...]) -> Iterator[Counted]:
    """For every text, of tokens joined by blanks: the hashes of its n-grams of words and of
    characters, across words, without repeats, and their counts. A text of fewer has none."""
    p, at = points(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        # a blank between texts: no word goes from one to the next
        lo, sizes = at[i], np.diff(at[i : j + 1])
        own = np.insert(p[lo : at[j]], at[i + 1 : j] - lo, 32)
        begin = at[i:j] - lo + np.arange(j - i)
        kinds = _grams(own, words, chars)
        spans = []
        for h, start, n in kinds:
            if start is not None:
                a, b = np.searchsorted(start, begin), np.searchsorted(start, begin + sizes) - n + 1
            else:
                a, b = begin, begin + sizes - n + 1
            spans.append((h, a.tolist(), b.tolist()))
        for k in range(j - i):
            yield distinct(np.concatenate([h[a[k] : max(b[k], a[k])] for h, a, b in spans]))
        i = j


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def hashed_words(words: list[str], profile: str) -> np.ndarray:
    """The 64 bits that SimHash takes of a feature."""
    of = (lambda w: hashlib.md5(w).digest()[:8]) if profile == "md5" else (lambda w: hashlib.blake2b(w, digest_size=8, person=b"plag-sim").digest())
    return np.array([int.from_bytes(of(w.encode()), "big") for w in words], U)


def weighted(features: Column, profile: str) -> Column:
    """struct(h, tf): 64-bit hashes of an array of strings, without repeats, and their counts, in two binaries."""

    @F.arrow_udf("struct<h: binary, tf: binary>")
    def of(col: pa.Array) -> pa.Array:
        flat = col.flatten()
        at = np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        h = hashed_words(coded.dictionary.to_pylist(), profile)
        rows = [distinct(code[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        release()
        return pa.StructArray.from_arrays([pa.array([h[c].tobytes() for c, _ in rows], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in rows], pa.binary())], ["h", "tf"])

    return of(features)
