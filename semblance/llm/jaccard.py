"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents are similar if their sets of word n-grams have a Jaccard
similarity of ``threshold`` at least. No similar pair is lost: every step below
leaves out only what can't be part of one.

1. Equal sets are one set, named by a hash of its n-grams. Of its documents only
   the one of lowest id takes part in the search.
2. A partner of a set of n n-grams must occur on ``T = ceil(threshold * n)`` of
   its inverted lists. Every set asks which of its n-grams others have: 5 bytes
   an n-gram go to the bucket of its leading bits, where lists of one member end,
   and the others return with their length. Sets with fewer than T such lists
   have no partner; on most corpora these are nearly all, and their texts and
   n-grams are done with.
3. DivideSkip: the T - 1 longest lists of a set are set aside, and a partner must
   occur on one of the short ones. The least name on a short list is its pivot,
   and all sets that share a pivot on some list are a cell, so that similar sets
   meet in one cell at least. A pair counts only in the lowest cell both are in.
4. In a cell every set is a query. Its short lists are heap-merged, and a set that
   occurs often enough on them is looked up in the long ones by binary search.
   Lists with the same members are one list with a weight.
5. A cell of more than ``CELL`` n-grams is cut into blocks, and each pair of
   blocks is searched on its own, so no task holds more than two blocks.

n-grams that very many sets have, found on a sample of sets, never ask: they are
known to be shared and only lengthen the long lists. Which ones are found changes
the work, never the result. They are at most ``HOT``, and are sent to every task.

Results: :func:`classes`, a row a document, is what the query returns. Its links
are counted in the cells, so what is stored and shuffled stays in proportion to
the documents. :func:`similar` gives the pairs themselves.

Defined results: null and empty texts, and those without words, are a class of
their own without links; texts of fewer than n words have their whole run as the
only n-gram; repeated rows, and rows of one id with different texts, are documents
of their own; a null id ranks above all others; extra columns are ignored by
``classes`` and ``similar`` and returned by ``one_of_each``; an empty table gives
an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

U64 = np.uint64
N, THRESHOLD = 5, 0.4
#: n-grams in one block of a cell.
CELL = 500_000
#: n-grams that meet in one bucket, and that a task holds before it sends them there.
BUCKET, CHUNK = 2_000_000, 2_000_000
#: n-grams known to be frequent, at most; sets they are looked for in; least share of these sets that has them.
HOT, SAMPLE, SHARE = 1 << 20, 1 << 14, 2.0**-12
#: Rows of (id, content) of 17 bytes are sent to every executor up to so many, and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: A probe of a long list costs so many times a step of the merge (DivideSkip's mu, for numpy).
MU = 1.0
#: Postings from which the short lists are merged by counting in numpy instead of by the heap.
HEAP = 64
LINKS = "u long, v long, links long"
PAIRS = "name_a long, name_b long, overlap int, jaccard double"


def identity(u: np.ndarray) -> int:
    """64 bits that name a set of hashes."""
    with np.errstate(over="ignore"):
        return int(C.mix(np.array([np.add.reduce(C.mix(u + U64(0x1F))) + U64(len(u))], U64))[0].view(np.int64))


def _sets(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, last, w in C.word_chunks(col):
        s, o = C.shingles(w.hash, w.offset, n)
        for d in range(last - first):
            if o[d + 1] > o[d]:
                yield first + d, np.unique(s[o[d] : o[d + 1]])


def _least(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


# the search in a cell


def _merge(lists: list[np.ndarray], weights: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, occurrences) on the lists: a heap of the lists' heads, or the
    same by counting where there are many postings."""
    if sum(map(len, lists)) > HEAP:
        total = np.bincount(np.concatenate(lists), np.repeat(weights, [len(x) for x in lists]), m)
        hit = np.flatnonzero(total)
        return hit, total[hit].astype(np.int64)
    runs, weights = [x.tolist() for x in lists], weights.tolist()
    heap = [(x[0], k, 0) for k, x in enumerate(runs) if x]
    heapq.heapify(heap)
    out: dict[int, int] = {}
    while heap:
        member, k, i = heap[0]
        out[member] = out.get(member, 0) + weights[k]
        if i + 1 < len(runs[k]):
            heapq.heapreplace(heap, (runs[k][i + 1], k, i + 1))
        else:
            heapq.heappop(heap)
    return np.fromiter(out, np.int64, len(out)), np.fromiter(out.values(), np.int64, len(out))


def t_occurrence(sets: list[np.ndarray], threshold: float, sizes: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overlap), i < j, of all pairs of hash sets that reach the Jaccard
    threshold; if ``side`` is given, only those on different sides. ``sizes``
    where the sets lack n-grams that no other set has."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets]) if sizes is None else sizes
    h, who = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    length = np.diff(np.append(begin, len(h)))
    # lists with the same members become one, with a weight
    name = np.add.reduceat(C.mix(who.astype(U64) + U64(1)), begin)
    begin, length, name = begin[length > 1], length[length > 1], name[length > 1]
    none = np.zeros(0, np.int64)
    if not len(begin):
        return none, none, none
    _, at, weight = np.unique(name, return_index=True, return_counts=True)
    order = np.argsort(-length[at], kind="stable")  # longest first
    begin, length, weight = begin[at][order], length[at][order], weight[order]
    lists = [who[b : b + k] for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
    flat, of = np.concatenate(lists), np.repeat(np.arange(len(lists)), length)
    key = of * m + flat  # ascending: a binary search in it is one in a list
    by_member = np.argsort(flat, kind="stable")
    own, edge = of[by_member], np.searchsorted(flat[by_member], np.arange(m + 1))
    out_i, out_j, out_k = [], [], []
    least, logs = _least(sizes, threshold), np.log2(np.maximum(length, 2))
    for q in range(m):
        mine = own[edge[q] : edge[q + 1]]  # the query's lists, longest first
        mass = np.cumsum(weight[mine])
        if not len(mine) or mass[-1] < least[q]:
            continue
        aside = min(least[q] / (MU * logs[mine[0]] + 1), least[q] - 1)
        cut = int(np.searchsorted(mass, aside, "right"))
        rest = [lists[k] for k in mine[cut:].tolist()]
        j, count = _merge(rest, weight[mine[cut:]], m)
        left = int(mass[cut - 1]) if cut else 0
        want = np.ceil(threshold / (1 + threshold) * (sizes[q] + sizes[j]) - 1e-9)
        ok = (j > q) & (count + left >= want)
        if side is not None:
            ok &= side[j] != side[q]
        j, count, want = j[ok], count[ok], want[ok]
        if cut and len(j):
            probe = mine[:cut, None] * m + j[None, :]
            p = np.minimum(np.searchsorted(key, probe.ravel()), len(key) - 1).reshape(probe.shape)
            count = count + weight[mine[:cut]] @ (key[p] == probe)
        ok = (count >= want) & (count >= threshold * (sizes[q] + sizes[j] - count) - 1e-9)
        if ok.any():
            out_i.append(np.full(int(ok.sum()), q))
            out_j.append(j[ok])
            out_k.append(count[ok])
    return tuple(np.concatenate(x) for x in (out_i, out_j, out_k)) if out_i else (none, none, none)


def _once(i: np.ndarray, j: np.ndarray, cell: int, cells: list[list[int]]) -> np.ndarray:
    """Which of the pairs have ``cell`` as the lowest cell of both."""
    lower = [{y for y in x if y < cell} for x in cells]
    some = np.array([bool(x) for x in lower])
    ok = ~(some[i] & some[j])
    for k in np.flatnonzero(~ok):
        ok[k] = not (lower[i[k]] & lower[j[k]])
    return ok


def _searched(batches: Iterator[pa.RecordBatch], threshold: float, pairs: bool) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their keys; a key is a cell, or two blocks of one.
    Gives pairs of names, or what they add to the links of each name (v null)
    and edges that connect what they connect (links null)."""

    def found(group: list[tuple]) -> Iterator[tuple]:
        cell, side, name, size, docs, data, cells = zip(*group, strict=True)
        name, size, docs, side = np.array(name), np.array(size), np.array(docs), np.array(side)
        i, j, k = t_occurrence([np.frombuffer(x, np.int64).view(U64) for x in data], threshold, size, side if side[0] >= 0 else None)
        if not len(i):
            return
        ok = _once(i, j, cell[0], cells)
        i, j, k = i[ok], j[ok], k[ok]
        if pairs:
            yield from zip(name[i].tolist(), name[j].tolist(), k.tolist(), (k / (size[i] + size[j] - k)).tolist(), strict=True)
            return
        links = np.bincount(i, docs[j], len(name)) + np.bincount(j, docs[i], len(name))
        top = list(range(len(name)))

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                top[max(a, b)] = min(a, b)
        for x in np.flatnonzero(links).tolist():
            yield int(name[x]), None, int(links[x])
            if (r := root(x)) != x:
                yield int(name[x]), int(name[r]), None

    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64()) if pairs else (pa.int64(),) * 3
    names = ["name_a", "name_b", "overlap", "jaccard"] if pairs else ["u", "v", "links"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    now, group, out = None, [], []
    for b in batches:
        for key, *row in zip(*(b.column(c).to_pylist() for c in ("key", "cell", "side", "name", "size", "docs", "grams", "cells")), strict=True):
            if key != now:
                if len(group) > 1:
                    out += found(group)
                now, group = key, []
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
            group.append(tuple(row))
    if len(group) > 1:
        out += found(group)
    if out:
        yield batch(out)


# which n-grams are shared


def _rows(key: np.ndarray, count: np.ndarray, **values: np.ndarray) -> Iterator[tuple]:
    """(key, start, end) of the runs of equal keys, with where their values lie;
    ``count`` values belong to each entry."""
    if len(key):
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.concatenate([[0], np.cumsum(count)])
        for a, z in zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True):
            yield key[a], a, z, int(ends[a]), int(ends[z])


_PACKED = "bucket int, kind int, names binary, counts binary, low binary, high binary, df binary"


def _packed(bucket: int, kind: int, names: np.ndarray, counts: np.ndarray, ids: np.ndarray, df: np.ndarray | None = None) -> tuple:
    """Entries (name, n-grams) in 5 bytes an n-gram."""
    high = (ids >> U64(32)).astype(np.uint8)
    return int(bucket), kind, names.tobytes(), counts.astype(np.uint32).tobytes(), ids.astype(np.uint32).tobytes(), high.tobytes(), None if df is None else df.astype(np.uint32).tobytes()


def _unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, counts = np.frombuffer(row[2], np.int64), np.frombuffer(row[3], np.uint32).astype(np.int64)
    return names, counts, np.frombuffer(row[4], np.uint32).astype(U64) | (np.frombuffer(row[5], np.uint8).astype(U64) << U64(32))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "names", "counts", "low", "high", "df"])


def _within(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where in the sorted table each hash is, or -1."""
    out = np.full(len(h), -1, np.int64)
    if len(table):
        seen = np.zeros(1 << 16, bool)
        seen[(table >> U64(48)).astype(np.int64)] = True
        some = np.flatnonzero(seen[(h >> U64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(table, h[some]), len(table) - 1)
        same = table[at] == h[some]
        out[some[same]] = at[same]
    return out


def _asked(batches: Iterator[pa.RecordBatch], n: int, bits: int, hot: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of normalised texts: rows of kind 0, n-grams for the bucket of their
    leading bits; of kind 1, size and frequent n-grams of each set."""
    seen: set[int] = set()
    names, sets, held = [], [], 0

    def rows() -> pa.RecordBatch:
        name, size = np.array(names, np.int64), np.array([len(u) for u in sets])
        u, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        at = _within(u, hot)
        frequent = np.flatnonzero(at >= 0)
        own = np.bincount(who[frequent], minlength=len(name))
        # one more value, the size, leads the frequent ones of each set
        first = np.concatenate([[0], np.cumsum(own + 1)[:-1]])
        values = np.zeros(int((own + 1).sum()), U64)
        values[first] = size
        rest = np.ones(len(values), bool)
        rest[first] = False
        values[rest] = rank[at[frequent]]
        out = [_packed(int(U64(name[0].view(U64)) % U64(1 << bits)), 1, name, own + 1, values)]
        if len(frequent):
            u, who = np.delete(u, frequent), np.delete(who, frequent)
        bucket = (u >> U64(64 - bits)).astype(np.uint32) if bits else np.zeros(len(u), np.uint32)
        order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        u, who, bucket = u[order] >> U64(24 - bits), who[order], bucket[order]
        u &= U64((1 << 40) - 1)
        entry = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (who[1:] != who[:-1])])) if len(u) else np.zeros(0, np.int64)
        count = np.diff(np.append(entry, len(u)))
        for k, a, z, lo, hi in _rows(bucket[entry], count):
            out.append(_packed(k, 0, name[who[entry[a:z]]], count[a:z], u[lo:hi]))
        return _batch(out)

    for b in batches:
        for _, u in _sets(b.column(0), n):
            name = identity(u)
            if name in seen:
                continue
            seen.add(name)
            names.append(name)
            sets.append(u)
            held += len(u)
            if held > CHUNK:
                yield rows()
                names, sets, held = [], [], 0
    if names:
        yield rows()


def _answered(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their buckets: the n-grams of more than one set, with
    the number of sets, for the bucket of each set's name."""
    mask = U64((1 << bits) - 1)

    def by_name(kind: int, names: np.ndarray, counts: np.ndarray, ids: np.ndarray, df: np.ndarray | None) -> Iterator[tuple]:
        to = (names.view(U64) & mask).astype(np.int64)
        order = np.argsort(to, kind="stable")
        start = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
        n = counts[order]
        at = np.arange(int(n.sum())) + np.repeat(start[order] - (np.cumsum(n) - n), n)
        ids, df = ids[at], None if df is None else df[at]
        for k, a, z, lo, hi in _rows(to[order], n):
            yield _packed(k, kind, names[order[a:z]], n[a:z], ids[lo:hi], None if df is None else df[lo:hi])

    def answer(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        name = np.concatenate([np.repeat(r[0], r[1]) for r in rows])
        slot = np.concatenate([r[2] for r in rows])
        order = np.argsort(slot, kind="stable")
        slot, name = slot[order], name[order]
        begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        many = np.repeat(np.diff(np.append(begin, len(slot))) > 1, np.diff(np.append(begin, len(slot))))
        slot, name = slot[many], name[many]
        order = np.lexsort((name, slot))
        slot, name = slot[order], name[order]
        new = np.concatenate([[True], (slot[1:] != slot[:-1]) | (name[1:] != name[:-1])])[: len(slot)]
        slot, name = slot[new], name[new]  # a set may have come from two tasks
        begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])[: len(slot)])
        df = np.diff(np.append(begin, len(slot)))
        df = np.repeat(df, df)
        slot, name, df = slot[df > 1], name[df > 1], df[df > 1]
        if not len(slot):
            return
        order = np.lexsort((slot, name))
        slot, name, df = slot[order], name[order], df[order]
        entry = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        count = np.diff(np.append(entry, len(name)))
        # the bucket travels in the kind: ids of one row share it
        yield _batch([(k, 2 + bucket, *rest) for k, _, *rest in by_name(0, name[entry], count, slot, df)])

    now, rows = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
            if row[1] == 1:
                yield _batch(list(by_name(1, *_unpacked(row), None)))
                continue
            if row[0] != now:
                if rows:
                    yield from answer(now, rows)
                now, rows = row[0], []
            rows.append(_unpacked(row))
    if rows:
        yield from answer(now, rows)


_LISTS = "name long, size int, keep int, cold int, grams array<long>"


def _ordered(batches: Iterator[pa.RecordBatch], threshold: float, hot: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of the buckets of names: each set that may have a
    partner, with its shared n-grams from the rarest to the most frequent (the
    last ones known as frequent: numbers below ``hot``), how many are short lists
    (keep) and how many of all aren't frequent (cold)."""

    def lists(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        name, ids, df = [], [], []
        sizes: dict[int, int] = {}
        for row in rows:
            own, counts, value = _unpacked(row)
            if row[1] == 1:
                first = np.cumsum(counts) - counts
                sizes.update(zip(own.tolist(), value[first].astype(int).tolist(), strict=True))
                rest = np.ones(len(value), bool)
                rest[first] = False
                name.append(np.repeat(own, counts - 1))
                ids.append(value[rest])
                df.append((U64(1 << 32) + U64(hot)) - value[rest])  # numbered from the most frequent on
            else:
                name.append(np.repeat(own, counts))
                ids.append(value | (U64(row[1] - 2) << U64(40)) | U64(1 << 63))
                df.append(np.frombuffer(row[6], np.uint32).astype(U64))
        name, ids, df = np.concatenate(name), np.concatenate(ids), np.concatenate(df)
        order = np.lexsort((ids, df, name))
        name, ids, df = name[order], ids[order], df[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (ids[1:] != ids[:-1])])[: len(name)]
        name, ids, df = name[new], ids[new], df[new]
        begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])[: len(name)])
        shared = np.diff(np.append(begin, len(name)))
        cold = np.add.reduceat((df < 1 << 32).astype(np.int64), begin) if len(begin) else begin
        size = np.array([sizes[x] for x in name[begin].tolist()], np.int64)
        keep = shared - _least(size, threshold) + 1
        ok = keep > 0
        if ok.any():
            at = np.flatnonzero(np.repeat(ok, shared))
            flat = pa.array(ids[at].view(np.int64))
            edge = pa.array(np.concatenate([[0], np.cumsum(shared[ok])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(name[begin[ok]]), pa.array(size[ok].astype(np.int32)), pa.array(keep[ok].astype(np.int32)), pa.array(cold[ok].astype(np.int32)), pa.ListArray.from_arrays(edge, flat)], names=["name", "size", "keep", "cold", "grams"])

    now, rows = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in range(7)), strict=True):
            if row[0] != now:
                if rows:
                    yield from lists(rows)
                now, rows = row[0], []
            rows.append(row)
    if rows:
        yield from lists(rows)


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, name) in order: (cell, name) for each list's pivot and its other members."""
    last, pivot = None, None
    for b in batches:
        gram, name = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(gram):
            continue
        new = np.concatenate([[gram[0] != last], gram[1:] != gram[:-1]])
        least = name[np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))]
        if not new[0]:
            least[: int(new.argmax()) if new.any() else len(new)] = pivot
        last, pivot = gram[-1], least[-1]
        other = name != least
        got = np.unique(np.concatenate([np.stack([least[other], name[other]], 1), np.stack([least[other]] * 2, 1)]), axis=0)
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, 0])), pa.array(np.ascontiguousarray(got[:, 1]))], names=["cell", "name"])


# the plan


def _read(spark: SparkSession, docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` as (doc_id, content, text), content being a hash of the text, and
    the stored (doc_id, content, name, size) of every row; name is null without words."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, size = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int32)
            for row, u in _sets(b.column("norm"), n):
                name[row], size[row] = identity(u), len(u)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("content"), pa.array(name, mask=size == 0), pa.array(size)], names=["doc_id", "content", "name", "size"])

    own = thin.select("doc_id", "content", C.norm(F.col("text")).alias("norm")).mapInArrow(lambda it: C.tidy(named(it)), "doc_id long, content long, name long, size int")
    return thin, C.written(spark, own, "jaccard-sets")


def without(docs: DataFrame, keys: DataFrame, content: str, broadcast_rows: int) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` and column ``content`` are in ``keys``."""
    few = keys.count() <= broadcast_rows
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"))
    return docs.join(F.broadcast(keys) if few else keys, docs.doc_id.cast("long").eqNullSafe(keys["_id"]) & (docs[content] == keys["_content"]), "left_anti")


def _frequent(texts: DataFrame, count: int, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, rank by frequency) of n-grams that many sets of a sample have."""
    share = SAMPLE / max(1, count) + 1 / SAMPLE

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for b in batches:
            sets.update((identity(u), u) for _, u in _sets(b.column(0), n))
        if sets:
            u, k = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            u, k = np.append(u[k > 1], U64(0)), np.append(k[k > 1], len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(k)], names=["gram", "k"])

    some = texts.where(F.pmod(F.col("content"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20))).select(C.norm(F.col("text")))
    total = some.mapInArrow(lambda it: C.tidy(seen(it)), "gram long, k long").groupBy("gram").agg(F.sum("k").alias("k"))
    got = total.where(F.col("k") >= 8).orderBy(F.desc("k"), "gram").limit(most + 1).toArrow()
    gram, k = got["gram"].to_numpy().view(U64), got["k"].to_numpy()
    sampled = int(k[gram == 0].max()) if (gram == 0).any() else 0
    gram = gram[(gram != 0) & (k >= SHARE * sampled)][:most]
    order = np.argsort(gram)
    return gram[order], order.astype(np.uint32)


def _search(spark: SparkSession, docs: DataFrame, n: int, threshold: float, pairs: bool, cell: int, bucket: int, hot: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, content, name, size) of every row, (name, size, docs, rep) of
    every set, and what the cells give."""
    thin, own = _read(spark, docs, n)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    ids = own.where("size > 0").groupBy("name").agg(F.first("size").alias("size"), F.count("*").alias("docs"), F.min(key).alias("rep"))
    copies = own.join(ids.where("docs > 1").select(F.col("name").alias("_name"), "rep"), F.col("name") == F.col("_name")).where(key != F.col("rep")).select("doc_id", "content").distinct()
    copies = C.written(spark, copies, "jaccard-copies")
    texts = without(thin, copies, "content", broadcast_rows)
    total, count = ids.agg(F.sum("size"), F.count("*")).first()
    bits = min(23, max(0, ((total or 0) // bucket).bit_length()))
    frequent, rank = _frequent(texts, count, n, hot)
    known = spark.sparkContext.broadcast((frequent, rank))

    def in_buckets(df: DataFrame) -> DataFrame:
        return df.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket")

    asked = texts.select(C.norm(F.col("text"))).mapInArrow(lambda it: C.tidy(_asked(it, n, bits, *known.value)), _PACKED)
    answered = in_buckets(asked).mapInArrow(lambda it: C.tidy(_answered(it, bits)), _PACKED)
    lists = in_buckets(answered).mapInArrow(lambda it: C.tidy(_ordered(it, threshold, len(known.value[0]))), _LISTS)
    lists = C.written(spark, lists, "jaccard-lists")

    short = lists.select(F.explode(F.slice("grams", 1, F.least("keep", "cold"))).alias("gram"), "name")
    cells = short.repartition("gram").sortWithinPartitions("gram", "name").mapInArrow(_pivots, "cell long, name long")
    # lists of frequent n-grams may be long: their pivots are found by aggregation, and are as few as they
    long = lists.where("keep > cold").select("name", F.explode(F.expr("slice(grams, cold + 1, keep - cold)")).alias("gram"))
    least = long.groupBy("gram").agg(F.min("name").alias("cell"), F.count("*").alias("n")).where("n > 1").select("gram", "cell")
    cells = cells.union(long.join(F.broadcast(least), "gram").select("cell", "name")).distinct()
    cells = C.written(spark, cells, "jaccard-cells")
    weight = cells.join(lists.select("name", F.size("grams").alias("n")), "name").groupBy("cell").agg(F.ceil(F.sum("n") / F.lit(cell)).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").select("cell", "blocks")
    of_set = cells.join(weight, "cell").groupBy("name").agg(F.collect_list(F.struct("cell", "blocks")).alias("c"))
    each = lists.join(of_set, "name").join(ids.select("name", "docs"), "name")
    each = each.select("name", "size", "docs", "grams", F.array_sort(F.transform("c", lambda c: c.cell)).alias("cells"), F.explode("c").alias("at")).select("*", "at.cell", "at.blocks").drop("at")
    block = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    each = each.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    each = each.withColumn("key", F.xxhash64("cell", i, j)).withColumn("side", F.when(i == j, -1).otherwise(F.col("block")))
    each = each.select("key", "cell", "side", "name", "size", "docs", "grams", "cells").repartition("key").sortWithinPartitions("key", "name")
    found = each.mapInArrow(lambda it: C.tidy(_searched(_raw(it), threshold, pairs)), PAIRS if pairs else LINKS)
    return own, ids, C.written(spark, found, "jaccard-found")


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of numbers as their bytes."""
    for b in batches:
        grams = b.column("grams")
        if isinstance(grams, pa.ChunkedArray):
            grams = grams.combine_chunks()
        flat, edge = grams.flatten(), np.asarray(grams.offsets, np.int64)
        edge = (edge - edge[0]) * 8
        data = pa.Array.from_buffers(pa.large_binary(), len(grams), [None, pa.py_buffer(edge), pa.py_buffer(flat.to_numpy())])
        yield pa.RecordBatch.from_arrays([data if name == "grams" else b.column(name) for name in b.schema.names], names=b.schema.names)


def similar(spark: SparkSession, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, cell: int = CELL, bucket: int = BUCKET, hot: int = HOT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id_a, doc_id_b, overlap, jaccard): all pairs of different similar
    sets, each by its document of lowest id, and that document with every other
    one of its set. As many as there are links between sets."""
    own, ids, found = _search(spark, docs, n, threshold, True, cell, bucket, hot, broadcast_rows)
    rep = ids.select("name", F.col("rep.doc_id").alias("x"), F.struct("rep", "name").alias("r"))
    a, b = (rep.toDF(f"name_{s}", f"x_{s}", f"r_{s}") for s in "ab")
    near = found.join(a, "name_a").join(b, "name_b")
    in_order = F.col("r_a") < F.col("r_b")
    near = near.select(F.when(in_order, F.col("x_a")).otherwise(F.col("x_b")).alias("doc_id_a"), F.when(in_order, F.col("x_b")).otherwise(F.col("x_a")).alias("doc_id_b"), "overlap", "jaccard")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    many = ids.where("docs > 1").select("name", "rep")
    equal = own.select("name", "size", "doc_id", key.alias("key")).join(many, "name")
    equal = equal.select(F.col("rep.doc_id").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.col("size").alias("overlap"), F.lit(1.0).alias("jaccard"), (F.col("key") == F.col("rep")).alias("same"))
    return near.union(equal.where("not same").drop("same"))


def _classes(spark: SparkSession, docs: DataFrame, n: int, threshold: float, cell: int, bucket: int, hot: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content, name, size) of every row, and (name, rep, links) of
    every set: the first document of its class, and how many others are similar."""
    own, ids, found = _search(spark, docs, n, threshold, False, cell, bucket, hot, broadcast_rows)
    groups = components(spark, found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy(F.col("u").alias("name")).agg(F.sum("links").alias("near"))
    sets = ids.join(groups, ids.name == groups.node, "left").join(links, "name", "left")
    sets = sets.select("name", "rep", (F.col("docs") - 1 + F.coalesce("near", F.lit(0))).alias("links"), F.coalesce("component", "name").alias("g"))
    first = sets.groupBy("g").agg(F.min("rep").alias("rep"))
    return own, C.written(spark, sets.drop("rep").join(first, "g").select("name", "rep", "links"), "jaccard-classes")


def classes(spark: SparkSession, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, cell: int = CELL, bucket: int = BUCKET, hot: int = HOT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, class_id, links), a row for each row of ``docs``: the lowest id
    among the documents that similarity connects with it, directly or through
    others, and with how many documents it is similar itself."""
    own, sets = _classes(spark, docs, n, threshold, cell, bucket, hot, broadcast_rows)
    return own.join(sets, "name", "left").select("doc_id", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, cell: int = CELL, bucket: int = BUCKET, hot: int = HOT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with one document of each class, the one of lowest id (nulls
    last). Of repeated rows one stays. Rows without words all stay."""
    own, sets = _classes(spark, docs, n, threshold, cell, bucket, hot, broadcast_rows)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    marked = own.join(sets.where("links > 0"), "name").select("doc_id", "content", (key == F.col("rep")).alias("first"))
    marked = C.written(spark, marked.groupBy("doc_id", "content").agg(F.first("first").alias("first"), F.count("*").alias("n")).where("n > 1 or not first"), "jaccard-gone")
    content = C.fresh(docs, "content")
    keyed = docs.withColumn(content, F.xxhash64("text"))
    again = marked.where("first").select("doc_id", "content")
    left = without(keyed, marked.select("doc_id", "content"), content, broadcast_rows)
    if not again.isEmpty():
        keys = again.select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"))
        twice = keyed.join(F.broadcast(keys) if again.count() <= broadcast_rows else keys, keyed.doc_id.cast("long").eqNullSafe(keys["_id"]) & (keyed[content] == keys["_content"]), "left_semi")
        left = left.union(twice.dropDuplicates(["doc_id", content]))
    return left.drop(content)


_S = f"array_to_string(w[p : p + {N - 1}], ' ')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split({C.NORM_SQL}, ' ') AS w FROM documents WHERE {C.NORM_SQL} <> ''),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - {N - 1}) + 1), lambda p: {_S}))) AS s FROM d),
h AS MATERIALIZED (SELECT doc_id, md5(array_to_string(s, chr(10))) AS name, s FROM s),
n AS MATERIALIZED (SELECT name, min(doc_id) AS rep, count(*) AS docs, any_value(s) AS s FROM h GROUP BY name),
e AS MATERIALIZED (SELECT rep, len(s) AS size, unnest(s) AS g FROM n),
o AS (SELECT a.rep AS a, b.rep AS b, a.size AS na, b.size AS nb, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
p AS MATERIALIZED (SELECT a, b FROM o WHERE o >= {THRESHOLD} * (na + nb - o) - 1e-9),
t AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT rep AS node, rep AS top FROM n UNION SELECT t.b, c.top FROM c JOIN t ON t.a = c.node),
k AS (SELECT node, min(top) AS class_id FROM c GROUP BY node),
l AS (SELECT t.a AS rep, sum(n.docs) AS near FROM t JOIN n ON n.rep = t.b GROUP BY t.a)
SELECT doc_id, class_id, (docs - 1 + coalesce(near, 0))::BIGINT AS links FROM h JOIN n USING (name) JOIN k ON k.node = n.rep LEFT JOIN l ON l.rep = n.rep
UNION ALL SELECT doc_id, doc_id, 0 FROM documents WHERE {C.NORM_SQL} = ''
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, C.table(spark, sf_dir, "documents"))
