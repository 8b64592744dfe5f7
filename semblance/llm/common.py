"""Shared pieces: tables, the shared folder, and vectorised word hashing.

Words are maximal runs of Unicode letters and digits of the lower-cased text.
Spark brings a text into that form (:func:`norm`), after which Python needs
only the bytes of the Arrow buffer: every word is a run of bytes between two
spaces, and its hash is a difference of polynomial prefix sums, so no Python
object is made for a word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary one is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="semblance-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` for the session's Python stages: by default a
    batch of texts may take 64 MB, several times over in the JVM and the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def written(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts its lineage, and a
    lost executor costs no recomputation of what came before."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give memory that the allocators keep back to the system: workers live on
    after a task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    release()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def norm(text: Column) -> Column:
    """Lower case, words separated by one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


#: The same for DuckDB, of a column ``text``.
NORM_SQL = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = 1 << max(n - 1, 1).bit_length()
        _pow, _inv = np.full(n, _BASE, U64), np.full(n, _INV, U64)
        _pow[0] = _inv[0] = 1
        np.multiply.accumulate(_pow, out=_pow)
        np.multiply.accumulate(_inv, out=_inv)
    return _pow, _inv


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column, without a copy."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    size = np.int64 if wide else np.int32
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(bufs[1], size)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return off, data


class Words:
    """The words of documents ``first .. last`` of a column.

    ``hash``: a hash per word; ``offset``: where each document's words begin
    (one more entry than documents); ``start``, ``end``: byte positions.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, prefix: int = 0):
        size = int(off[-1] - off[0])
        b = data[off[0] : off[-1]]
        at = off - off[0]
        if size == 0:
            self.hash = np.zeros(0, U64)
            self.prefix = self.hash
            self.offset = np.zeros(len(off), np.int64)
            self.start = self.end = np.zeros(0, np.int64)
            return
        gap = b == 32
        before = np.empty(size, bool)
        before[0] = True
        before[1:] = gap[:-1]
        before[at[:-1][at[:-1] < size]] = True
        after = np.empty(size, bool)
        after[-1] = True
        after[:-1] = gap[1:]
        ends = at[1:]
        after[ends[ends > 0] - 1] = True
        word = ~gap
        self.start = np.flatnonzero(before & word)
        self.end = np.flatnonzero(after & word) + 1
        pw, inv = _powers(size + 1)
        sums = np.empty(size + 1, U64)
        sums[0] = 0
        np.cumsum((b.astype(U64) + U64(1)) * pw[:size], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inv[self.start])
        if prefix:
            cut = np.minimum(self.start + prefix, self.end)
            self.prefix = mix((sums[cut] - sums[self.start]) * inv[self.start])
        self.offset = np.searchsorted(self.start, at)


def word_chunks(col: pa.Array, prefix: int = 0, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first, last, words) of runs of documents of about ``chunk`` bytes; a
    longer document makes a run of its own and is taken whole."""
    off, data = string_buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + chunk, "right")) - 1)
        yield i, j, Words(data, off[i : j + 1], prefix)
        i = j


def hash_words(words: list[str]) -> np.ndarray:
    """The hash of each string taken as one word."""
    return np.concatenate([Words(np.frombuffer(b := w.encode(), np.uint8), np.array([0, len(b)])).hash for w in words]) if words else np.zeros(0, U64)


def _steps(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


def shingles(w: np.ndarray, offset: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of all runs of ``n`` words, document by document.

    A document of 1 to n-1 words has its whole run as the only shingle if
    ``short``, else none; one without words has none.
    """
    size = np.diff(offset)
    a = _steps(n)
    m = len(w)
    total = np.maximum(size - n + 1, 0)
    if m >= n:
        h = w[: m - n + 1] * a[0]
        for k in range(1, n):
            h = h + w[k : m - n + 1 + k] * a[k]
        h = mix(h + U64(n))
    else:
        h = np.zeros(0, U64)
    begin = np.repeat(offset[:-1], total)
    ends = np.cumsum(total)
    inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - total, total)
    out = h[begin + inside] if len(begin) else np.zeros(0, U64)
    if short and ((size > 0) & (size < n)).any():
        few = np.flatnonzero((size > 0) & (size < n))
        extra = np.zeros(len(few), U64)
        for k in range(n - 1):
            has = size[few] > k
            extra[has] += w[offset[:-1][few[has]] + k] * a[k]
        extra = mix(extra + size[few].astype(U64))
        out = np.insert(out, (ends - total)[few], extra)
        total = total.copy()
        total[few] = 1
    return out, np.concatenate([[0], np.cumsum(total)])
