"""Sharding by histogram sort: shards of equal bytes, in key order.

Rows are to go to ``shards`` ranges of the key, each of ``1/shards`` of all
bytes. For every splitter an interval of keys that must hold it is kept. In
each round the open intervals are cut by evenly spaced probes, every partition
counts its bytes below every probe (a search among the sorted probes), these
exact counts are summed, and each interval shrinks to the two probes around its
target. A splitter is final when the bytes below it are within ``tolerance`` of
a shard's size, or its interval can't be cut. Only then are the rows exchanged,
once, each straight to its shard, and sorted there.

Rounds read a thin table (key, bytes) in the shared folder. What is sent to the
driver is a row for each probe, so the number of probes bounds it, not the data.

The key is (``doc_id``, hash of the text), so that repeated ids can be split
between shards. Defined results: null ids come first; null texts count no
bytes; every row also counts one byte, so that empty texts spread too; equal
rows share a shard, which may then exceed the tolerance, as may one whose
single document is larger; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHARDS, TOLERANCE, PROBES = 64, 0.01, 32
_LOW, _TOP = 0, (1 << 128) - 1


def _wide(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """(hi, lo) pairs of signed 64 bits as records that sort as numbers."""
    out = np.empty(len(hi), np.dtype([("hi", "<u8"), ("lo", "<u8")]))
    flip = np.uint64(1 << 63)
    out["hi"], out["lo"] = hi.astype(np.int64).view(np.uint64) ^ flip, lo.astype(np.int64).view(np.uint64) ^ flip
    return out


def _below(hi: np.ndarray, lo: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """How many of the sorted probes are at or below each key."""
    rows = _wide(hi, lo)
    a, b = np.searchsorted(probes["hi"], rows["hi"], "left"), np.searchsorted(probes["hi"], rows["hi"], "right")
    at = a.copy()
    for i in np.flatnonzero(b > a):  # the id equals a probe's: the hash decides
        at[i] = a[i] + np.searchsorted(probes["lo"][a[i] : b[i]], rows["lo"][i], "right")
    return at


def _records(values: list[int]) -> np.ndarray:
    out = np.empty(len(values), np.dtype([("hi", "<u8"), ("lo", "<u8")]))
    out["hi"], out["lo"] = [v >> 64 for v in values], [v & ((1 << 64) - 1) for v in values]
    return out


def _keyed(docs: DataFrame, hi: str, lo: str) -> DataFrame:
    low = F.lit(-(1 << 63)).cast("long")
    return docs.withColumn(hi, F.coalesce(F.col("doc_id").cast("long"), low)).withColumn(lo, F.xxhash64("text"))


def splitters(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """shards - 1 ascending keys (128 bits); a shard begins at its splitter."""
    thin = C.written(spark, _keyed(docs.select("doc_id", "text"), "hi", "lo").select("hi", "lo", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("bytes")), "shard-keys")
    first = thin.agg(F.sum("bytes"), F.min("hi"), F.max("hi")).first()
    total = first[0] or 0
    if not total:
        return []
    low, top = (first[1] + (1 << 63)) << 64, ((first[2] + (1 << 63) + 1) << 64) - 1
    # of each splitter: the bytes wanted below it, and an interval (key, bytes below it) on either side
    want = [total * i // shards for i in range(1, shards)]
    left, right = [(low, 0)] * (shards - 1), [(top + 1, total)] * (shards - 1)
    slack = tolerance * total / shards / 2

    def best(i: int) -> tuple[int, int]:
        return min(left[i], right[i], key=lambda x: abs(x[1] - want[i]))

    while True:
        spans = {(left[i][0], right[i][0]) for i in range(shards - 1) if abs(best(i)[1] - want[i]) > slack and right[i][0] - left[i][0] > 1}
        if not spans:
            break
        cuts = sorted({a + (b - a) * k // (probes + 1) for a, b in spans for k in range(1, probes + 1)} - {a for a, _ in spans})
        at = _records(cuts)

        def count(batches: Iterator[pa.RecordBatch], at: np.ndarray = at) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(at) + 1, np.int64)
            for b in batches:
                pos = _below(b.column("hi").to_numpy(), b.column("lo").to_numpy(), at)
                np.add.at(sums, pos, b.column("bytes").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["probe", "bytes"])

        counted = dict(thin.mapInArrow(count, "probe int, bytes long").groupBy("probe").agg(F.sum("bytes")).collect())
        below = np.cumsum([counted.get(k, 0) for k in range(len(cuts))])
        known = list(zip(cuts, map(int, below), strict=True))
        keys, sums = [k for k, _ in known], [s for _, s in known]
        for i, w in enumerate(want):
            j = int(np.searchsorted(sums, w, "right"))
            for k, s in known[max(0, j - 1) : j + 1]:
                if s <= w and k > left[i][0]:
                    left[i] = (k, s)
                if s >= w and k < right[i][0]:
                    right[i] = (k, s)
        del keys
    return sorted(best(i)[0] for i in range(shards - 1))


def sharded(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> tuple[DataFrame, str]:
    """``docs`` with all columns in ``shards`` partitions of about equal bytes,
    sorted by ``doc_id`` within and across them; and the name of one more
    column, the shard."""
    cuts = splitters(spark, docs, shards, tolerance, probes)
    hi, lo, shard = (C.fresh(docs, x) for x in ("shard_hi", "shard_lo", "shard"))
    keyed = _keyed(docs, hi, lo)
    at = _records(cuts)
    if not cuts:
        return keyed.withColumn(shard, F.lit(0)).drop(hi, lo), shard

    @F.pandas_udf("int")
    def place(h, low):
        import pandas as pd

        return pd.Series(_below(h.to_numpy(), low.to_numpy(), at).astype(np.int32))

    placed = keyed.withColumn(shard, place(hi, lo))
    return placed.repartitionById(shards, F.col(shard)).sortWithinPartitions(hi, lo).drop(hi, lo), shard


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark, C.table(spark, sf_dir, "documents"))[0]
