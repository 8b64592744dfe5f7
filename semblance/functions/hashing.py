"""Hashes, MinHash signatures and SimHash fingerprints.

``md5`` hashes are native and known to SQL; ``blake2b`` ones (64 bits, tagged
by use) need an Arrow UDF, as Spark has no such function.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .grams import release

PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_LOW = np.uint64((1 << 31) - 1)
_S30, _S31, _S61 = np.uint64(30), np.uint64(31), np.uint64(61)


def blake64(text: str, person: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, person=person).digest(), "big")


def coefficients(num_perm: int, seed: int = 42) -> list[tuple[int, int]]:
    draw = random.Random(seed).randrange
    return [(draw(1, PRIME), draw(PRIME)) for _ in range(num_perm)]


def minhash_md5(s: Column) -> Column:
    """60 bits as a positive long."""
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


def multiply_mod(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """a * h modulo 2^61 - 1 without wider integers."""
    a1, a0, h1, h0 = a >> _S31, a & _LOW, h >> _S31, h & _LOW
    mid = a1 * h0 + a0 * h1
    x = np.uint64(2) * a1 * h1 + (mid >> _S30) + ((mid & np.uint64((1 << 30) - 1)) << _S31) + a0 * h0
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def signature_of(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of every permutation, a * h + b modulo 2^61 - 1, of hashes below that, in
    chunks that a core's cache holds; PRIME where there are none. Every sum stays below 2^63."""
    low = np.full(len(a), _P)
    a1, a0 = a >> _S31, a & _LOW
    for i in range(0, len(h), 256):
        h1, h0 = h[i : i + 256] >> _S31, h[i : i + 256] & _LOW
        mid = np.multiply.outer(a1, h0)
        mid += np.multiply.outer(a0, h1)
        x = np.multiply.outer(a1 + a1, h1)
        x += np.multiply.outer(a0, h0)
        t = mid >> _S30
        x += t
        mid &= np.uint64((1 << 30) - 1)
        mid <<= _S31
        for more in (mid, b[:, None]):
            np.right_shift(x, _S61, out=t)
            x &= _P
            x += t
            x += more
        np.right_shift(x, _S61, out=t)
        x &= _P
        x += t
        np.subtract(x, _P, out=t)  # wraps to a large number below the prime
        np.minimum(x, t, out=x)
        np.minimum(low, x.min(axis=1), out=low)
    return low


def signature(shingles: Column, num_perm: int = 128, seed: int = 42, profile: str = "blake2b") -> Column:
    """Of shingles, or of their hashes in the ``md5`` profile."""
    a, b = (np.array(x, np.uint64) for x in zip(*coefficients(num_perm, seed), strict=True))

    @F.pandas_udf("array<long>")
    def of(x: pd.Series) -> pd.Series:
        if profile == "md5":
            rows = (np.asarray(v, np.int64).astype(np.uint64) % _P for v in x)
        else:
            rows = (np.array([blake64(s, b"plag-min") for s in v], np.uint64) % _P for v in x)
        return pd.Series([signature_of(np.unique(h), a, b).astype(np.int64) for h in rows])

    return of(shingles)


def sets(shingles: Column, num_perm: int = 128, seed: int = 42, profile: str = "blake2b") -> Column:
    """struct(signature, set) of shingles, or of their hashes in the ``md5`` profile, as
    binaries: the MinHash signature and the hashes in order."""
    a, b = (np.array(x, np.uint64) for x in zip(*coefficients(num_perm, seed), strict=True))

    @F.arrow_udf("struct<signature: binary, set: binary>")
    def of(col: pa.Array) -> pa.Array:
        flat = col.flatten()
        at = np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        h = flat.to_numpy().astype(np.uint64) if profile == "md5" else np.array([blake64(s, b"plag-min") for s in flat.to_pylist()], np.uint64)
        rows = [np.unique(h[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        made = (signature_of(np.unique(x % _P), a, b).astype(np.int64).tobytes() for x in rows)
        release()
        return pa.StructArray.from_arrays([pa.array(list(made), pa.binary()), pa.array([x.tobytes() for x in rows], pa.binary())], ["signature", "set"])

    return of(shingles)


def ordered(hashes: Column) -> Column:
    """An array of longs as a binary of unsigned numbers in order, without repeats."""

    @F.arrow_udf("binary")
    def of(col: pa.Array) -> pa.Array:
        h = col.flatten().to_numpy().astype(np.int64).view(np.uint64)
        at = np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return pa.array([np.unique(h[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())

    return of(hashes)
