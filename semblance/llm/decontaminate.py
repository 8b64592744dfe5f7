"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is short and a document may be long, so their Jaccard similarity says
little; what counts is the share of the item's shingles that the document
holds. Documents are partitioned by their number of distinct shingles into
classes ``2^c <= n < 2^(c+1)``. In each class one permutation is hashed into
bins whose number follows the class size, so that the signature of a long
document grows with it and a shared shingle is the minimum of its bin on both
sides with a probability that doesn't fall with length. Items are classed, too, by
the overlap they must reach (powers of two): the number of bins is chosen for the
least overlap of the class, such that a pair at the threshold is missed with
probability ``1 - recall`` at most. Every candidate is verified by exact shingle
containment on the words themselves.

Up to ``BROADCAST_BYTES`` of items are sent to every task, and documents are read
once. Beyond, signatures meet in a join; what a document sends is first held
against a bitmap of the items' shingles, of a fixed size, so that only shingles
that some item may have are shuffled. A full bitmap costs work, never a pair.

Defined results: null and empty texts hold no shingles and match nothing; an
item of ``1 <= k < n`` words is one shingle of ``k`` words; items without words
and items whose text is null never match; an item whose id is null matches like
any other; repeated items and repeated documents
each give their own row (once per distinct ``item_id`` and row).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
N, THRESHOLD, RECALL = 5, 0.5, 0.9999
#: Items up to so many bytes of text are sent to every executor; beyond, signatures are joined by shuffle.
BROADCAST_BYTES = 32 << 20
PAIRS = "doc_id long, item_id long, shared int, item_shingles int, containment double"
#: Bits of the bitmap of the items' shingles: 16 MB.
BITMAP_BITS = 27
_WORD = 1 << 15  # bits in one bitmap of Spark's bitmap functions


def extra_bits(overlap: int, recall: float) -> int:
    """log2 of the bins per shingle: ``overlap`` shared shingles, each the
    minimum of its bin on both sides with probability p, are all missed with
    probability ``(1-p)^overlap <= 1-recall``."""
    p = 1 - (1 - recall) ** (1 / max(1, overlap))
    for bits in range(-2, 24):
        load = 2.0**-bits * 1.5
        if (1 - math.exp(-load)) / load >= p:
            return bits
    return 24


def minima(u: np.ndarray, bits: int) -> np.ndarray:
    """The least hash in each of 2^bits bins of the sorted hashes ``u``."""
    if len(u) < 2 or bits >= 60:
        return u
    b = u >> U64(64 - bits) if bits > 0 else np.zeros(len(u), U64)
    return u[np.concatenate([[True], b[1:] != b[:-1]])]


def bins_of(size: int, more: int) -> int:
    return max(0, size.bit_length() + more)


def overlap_class(shingles: int, threshold: float) -> int:
    """log2 of the overlap that an item of so many shingles must reach, rounded down."""
    return max(1, math.ceil(threshold * shingles - 1e-9)).bit_length() - 1


class Items:
    """Signatures of the items in every size class, and their exact shingles."""

    def __init__(self, rows: list[tuple[int, str]], n: int, threshold: float, recall: float):
        self.n, self.threshold, self.ids, self.sets, self.tables = n, threshold, [], [], {}
        by_k: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item_id, text in rows:
            words = text.split()
            if not words:
                continue
            k = min(n, len(words))
            self.ids.append(item_id)
            self.sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
            w = C.hash_words(words)
            u = np.unique(C.shingles(w, np.array([0, len(w)]), k)[0])
            by_k.setdefault((k, overlap_class(len(u), threshold)), []).append((len(self.ids) - 1, u))
        self.by_k = by_k
        self.more = {x: extra_bits(1 << x[1], recall) for x in by_k}

    def table(self, k: tuple[int, int], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if (k, bits) not in self.tables:
            pairs = [(minima(u, bits), i) for i, u in self.by_k[k]]
            h = np.concatenate([m for m, _ in pairs])
            who = np.concatenate([np.full(len(m), i) for m, i in pairs])
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[(h >> U64(48)).astype(np.int64)] = True
            self.tables[k, bits] = h[order], who[order], seen
        return self.tables[k, bits]

    def candidates(self, k: tuple[int, int], u: np.ndarray) -> set[int]:
        bits = bins_of(len(u), self.more[k])
        h, who, seen = self.table(k, bits)
        sig = minima(u, bits)
        sig = sig[seen[(sig >> U64(48)).astype(np.int64)]]
        if not len(sig):
            return set()
        lo, hi = np.searchsorted(h, sig, "left"), np.searchsorted(h, sig, "right")
        return {int(x) for a, b in zip(lo, hi, strict=True) for x in who[a:b]}

    def verified(self, text: str, found: set[int]) -> list[tuple[int, int, int, float]]:
        words, own, out = text.split(), {}, []
        for i in sorted(found):
            k = len(next(iter(self.sets[i])))
            if k not in own:
                own[k] = {tuple(words[x : x + k]) for x in range(len(words) - k + 1)}
            shared = len(self.sets[i] & own[k])
            if shared >= self.threshold * len(self.sets[i]):
                out.append((self.ids[i], shared, len(self.sets[i]), shared / len(self.sets[i])))
        return out

    def search(self, col: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
        """(row, matches) of the rows of normalised texts that match an item."""
        for first, last, w in C.word_chunks(col):
            found: dict[int, set[int]] = {}
            for k in sorted({k for k, _ in self.by_k}):
                s, o = C.shingles(w.hash, w.offset, k, short=False)
                own = [x for x in self.by_k if x[0] == k]
                for d in range(last - first):
                    if o[d + 1] > o[d]:
                        u = np.unique(s[o[d] : o[d + 1]])
                        for x in own:
                            if got := self.candidates(x, u):
                                found.setdefault(first + d, set()).update(got)
            for row in sorted(found):
                if m := self.verified(col[row].as_py(), found[row]):
                    yield row, m


def _items(bench: DataFrame) -> DataFrame:
    return bench.select(F.col("item_id").cast("long").alias("item_id"), C.norm(F.col("text")).alias("norm")).where("norm <> ''").distinct()


def _small(items: DataFrame, limit: int) -> bool:
    return (items.agg(F.sum(F.octet_length("norm") + 32)).first()[0] or 0) <= limit


def _local(spark: SparkSession, items: DataFrame, n: int, threshold: float, recall: float):
    return spark.sparkContext.broadcast(Items([(r.item_id, r.norm) for r in items.collect()], n, threshold, recall))


def contaminated(spark: SparkSession, docs: DataFrame, bench: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every pair in
    which the document holds at least ``threshold`` of the item's shingles."""
    items = _items(bench)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.norm(F.col("text")).alias("norm"))
    if not _small(items, broadcast_bytes):
        return _by_shuffle(thin, items, n, threshold, recall).select("doc_id", "item_id", "shared", "item_shingles", "containment")
    known = _local(spark, items, n, threshold, recall)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            out = [(ids[row].as_py(), *m) for row, ms in known.value.search(b.column("norm")) for m in ms]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "item_id", "shared", "item_shingles", "containment"])

    return thin.mapInArrow(pairs, PAIRS)


def clean(spark: SparkSession, docs: DataFrame, bench: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    items = _items(bench)
    extra = C.fresh(docs, "norm")
    if not _small(items, broadcast_bytes):
        key = C.fresh(docs, "content")
        bad = _by_shuffle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.norm(F.col("text")).alias("norm")), items, n, threshold, recall)
        bad = bad.select(F.col("doc_id").alias("_bad"), F.col("content").alias("_content")).distinct()
        keyed = docs.withColumn(key, F.xxhash64(C.norm(F.col("text"))))
        return keyed.join(bad, keyed.doc_id.eqNullSafe(bad["_bad"]) & (keyed[key] == bad["_content"]), "left_anti").drop(key)
    known = _local(spark, items, n, threshold, recall)
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for row, _ in known.value.search(b.column(len(names))):
                keep[row] = False
            yield b.select(list(range(len(names)))).filter(pa.array(keep))

    return docs.withColumn(extra, C.norm(F.col("text"))).mapInArrow(kept, docs.schema)


def _by_shuffle(thin: DataFrame, items: DataFrame, n: int, threshold: float, recall: float, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """The same search where the items are too many to send around: documents'
    signatures meet the items' shingles in a join on (length, class, hash)."""
    spark = thin.sparkSession
    thin = thin.withColumn("content", F.xxhash64("norm"))
    # ids may be null or repeat, so an item is known by its id and words
    items = items.withColumn("item", F.xxhash64("item_id", "norm"))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("norm").to_pylist(), strict=True):
                w = C.hash_words(text.split())
                k = min(n, len(w))
                u = np.unique(C.shingles(w, np.array([0, len(w)]), k)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), item)), pa.array(np.full(len(u), k, np.int32)), pa.array(np.full(len(u), overlap_class(len(u), threshold), np.int32)), pa.array(u.view(np.int64))], names=["item", "k", "class", "h"])

    right = C.written(spark, items.select("item", "norm").mapInArrow(of_items, "item long, k int, class int, h long"), "leak-items")
    # at most n lengths times the classes of overlap, which grow with the logarithm of an item
    more = {(r["k"], r["class"]): extra_bits(1 << r["class"], recall) for r in right.select("k", "class").distinct().collect()}
    slot = F.shiftrightunsigned("h", 64 - bitmap_bits)
    words = right.select(slot.alias("slot")).groupBy(F.expr(f"slot div {_WORD}").alias("word")).agg(F.bitmap_construct_agg(F.col("slot") % _WORD).alias("bitmap")).collect()
    some = np.zeros((1 << bitmap_bits) // 8, np.uint8)
    for r in words:  # the bitmap's size, whatever the items
        own = np.frombuffer(r.bitmap, np.uint8)
        at = r.word * (_WORD // 8)
        some[at : at + len(own)] = own[: len(some) - at]
    known = spark.sparkContext.broadcast(some)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = known.value
        for b in batches:
            ids, content = b.column("doc_id"), b.column("content")
            for first, last, w in C.word_chunks(b.column("norm")):
                for k in sorted({k for k, _ in more}):
                    s, o = C.shingles(w.hash, w.offset, k, short=False)
                    for d in range(last - first):
                        u = np.unique(s[o[d] : o[d + 1]])
                        for c in [c for x, c in more if x == k] if len(u) else ():
                            m = minima(u, bins_of(len(u), more[k, c]))
                            at = (m >> U64(64 - bitmap_bits)).astype(np.int64)
                            m = m[(seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                            if len(m):
                                row = pa.array(np.full(len(m), first + d))
                                yield pa.RecordBatch.from_arrays([ids.take(row), content.take(row), pa.array(np.full(len(m), k, np.int32)), pa.array(np.full(len(m), c, np.int32)), pa.array(m.view(np.int64))], names=["doc_id", "content", "k", "class", "h"])

    left = thin.mapInArrow(of_docs, "doc_id long, content long, k int, class int, h long")
    found = left.join(right, ["k", "class", "h"]).select("doc_id", "content", "item").distinct()
    found = found.join(items, "item").withColumnRenamed("norm", "item_norm").withColumnRenamed("doc_id", "_doc").withColumnRenamed("content", "_content")
    both = thin.join(found, thin.doc_id.eqNullSafe(found["_doc"]) & (thin.content == found["_content"])).select("doc_id", "content", "norm", "item_id", "item_norm")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, c, *m) for d, c, text, i, item in zip(*(b.column(x).to_pylist() for x in range(5)), strict=True) for m in Items([(i, item)], n, threshold, recall).verified(text, {0})]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "content", "item_id", "shared", "item_shingles", "containment"])

    return both.mapInArrow(verify, "doc_id long, content long, item_id long, shared int, item_shingles int, containment double")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split({C.NORM_SQL}, ' ') AS w FROM documents WHERE {C.NORM_SQL} <> ''),
i AS (SELECT item_id, w, least({N}, len(w)) AS k FROM (SELECT DISTINCT item_id, string_split({C.NORM_SQL}, ' ') AS w FROM benchmark WHERE {C.NORM_SQL} <> '')),
si AS (SELECT DISTINCT item_id, w, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM i, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)),
n AS (SELECT item_id, w, count(*) AS item_shingles FROM si GROUP BY ALL),
ks AS (SELECT DISTINCT k FROM i),
sd AS (SELECT DISTINCT r, doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM d CROSS JOIN ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)),
m AS (SELECT r, doc_id, item_id, w, count(*) AS shared FROM sd JOIN si USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, shared::INT AS shared, item_shingles::INT AS item_shingles, shared / item_shingles::DOUBLE AS containment
FROM m JOIN n USING (item_id, w) WHERE shared >= {THRESHOLD} * item_shingles
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
