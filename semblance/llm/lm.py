"""Language-model scoring with a hashed maximum-entropy model.

The next word's probability is factored: a softmax over classes, a softmax over
the members of that class and, below the members that stand for many words,
softmaxes over ``FAN`` branches each, down to the word itself. All are log-linear
in the same features, the n-grams that end before the word and skip-grams around
gaps, of the words themselves, hashed into three tables of ``2^bits`` rows; a row
holds a weight for every class, member or branch.

1. Word counts over all documents. The most frequent words get a slot of their
   own, the others are leaves of a tree below one of ``RARE`` hashed slots; a
   class is a run of slots by frequency. Leaves, depth and rows follow the number
   of distinct words, up to ``LEAVES``. The counts give the unigram logits that the
   features correct, so every such word has its own. A leaf of each tree stands for
   all words beyond, by the sum of their counts, evenly spread over them and the
   words that the corpus doesn't have.
2. Documents are written once as ranks of words, four bytes a word.
3. Gradient updates, distributed: the corpus is cut into ``ROUNDS`` parts by a
   hash of the content. In a round every task starts from the same weights,
   makes AdaGrad steps over its share, whole documents, every position, and
   returns what changed in the rows it touched. Rows are averaged by how often
   each task touched them, block by block, and go out again. A round's order of
   summation is fixed, so a lost executor changes nothing.
4. Documents are scored in numpy batches, gathering only rows their features
   name.

Model and broadcast follow the distinct words up to the bound (about 30 bytes each,
and ``2^bits`` rows of three tables); what is counted, trained on and shuffled follows the corpus.

Defined results: a row for each input row. Null, empty and wordless texts have 0
words and null scores; repeated rows score alike; other columns are ignored; an
empty table gives an empty table. ``bits`` is rounded to 3 decimals, as sums of
floats are not the same in every batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
CLASSES, MEMBERS, RARE, BITS, ROUNDS = 32, 32, 128, 15, 4
#: Branches of a node below a rare slot, a power of two.
DEEP = 5
FAN = 1 << DEEP
#: Words with a leaf of their own, at most; about 30 bytes of each go to every executor (126 MB).
LEAVES = 1 << 22
RATE, MINI, EPS = 0.12, 2048, 1e-3
#: Positions scored at once; they don't depend on each other.
SCORED = 8192
#: Words back from the predicted one: n-grams of one and two, and a skip over one.
FEATURES = ((1,), (1, 2), (2,))
#: Rows of a table that are averaged together.
BLOCK = 1024
_ODD = U64(0x9E3779B97F4A7C15)


class Shape:
    def __init__(self, classes: int = CLASSES, members: int = MEMBERS, rare: int = RARE, bits: int = BITS, rounds: int = ROUNDS):
        self.classes, self.members, self.rare, self.bits, self.rounds = classes, members, rare, bits, rounds
        self.slots = classes * members
        self.known = self.slots - rare


class Model:
    """Vocabulary, unigram logits and the three weight tables."""

    def __init__(self, shape: Shape, h: np.ndarray, n: np.ndarray, beyond: tuple[np.ndarray, np.ndarray] | None = None):
        """``h``, ``n``: hashes and counts of words, from the most frequent on;
        ``beyond``: by rare slot, how many more words there are and the sum of their counts."""
        more, more_n = beyond if beyond else (np.zeros(shape.rare),) * 2
        #: What a word of the shared leaf of each rare slot loses to the others of it.
        self.share = np.log(more + 1).astype(np.float32)
        self.shape, self.words = shape, len(h)
        self.bits = max(shape.bits, (len(h) // FAN).bit_length())  # a weight for each word, at least
        known, rare = h[: shape.known], h[shape.known :]
        # a table by leading bits in which no two known words meet
        self.hash, self.shift = known.copy(), U64(44)
        while len(np.unique(known >> self.shift)) < len(np.unique(known)) and self.shift > 38:
            self.shift -= U64(1)
        self.place = np.zeros(1 << int(U64(64) - self.shift), np.uint16)
        self.place[(known >> self.shift).astype(np.int64)] = np.arange(len(known))
        order = np.argsort(rare)
        self.rare_hash, self.rare_rank = rare[order], order.astype(np.uint32)
        self.rare_rank += np.uint32(len(known))
        del order
        # leaf 0 of each slot is for unknown words, the others are its words by frequency
        self.start = len(h) + shape.rare
        self.slot, self.leaf = np.arange(self.start).astype(np.uint16), np.zeros(self.start, np.uint32)
        own = self.slot[len(known) : len(h)]
        own[:] = rare % U64(shape.rare)
        by_slot = np.argsort(own, kind="stable")
        ends = np.searchsorted(own, np.arange(shape.rare + 1), sorter=by_slot)
        own += np.uint16(shape.known)
        self.slot[len(h) :] = shape.known + np.arange(shape.rare)
        count = np.full(shape.slots, 0.5)
        count[: len(known)] += n[: shape.known]
        # logits of the branches, (slot, node, branch), from the top on; a slot at a time, as the driver holds all words
        width, self.tree = int(np.diff(ends).max()) + 1, []
        while not self.tree or width > 1:
            width = -(-width // FAN)
            self.tree.insert(0, np.empty((shape.rare, width, FAN), np.float32))
        for k in range(shape.rare):
            mine = by_slot[ends[k] : ends[k + 1]] + len(known)
            self.leaf[mine] = np.arange(1, len(mine) + 1)
            below = np.zeros(self.tree[-1][k].size)
            below[0] = 0.5 + more_n[k]
            below[1 : len(mine) + 1] = n[mine]
            count[shape.known + k] = below.sum()
            for tree in self.tree[::-1]:
                below = np.pad(below, (0, tree[k].size - len(below))).reshape(-1, FAN)
                up = below.sum(1)
                tree[k] = np.log(np.maximum(below, 1e-9)) - np.log(np.maximum(up, 1e-9))[:, None]
                below = up
        count = count.reshape(shape.classes, shape.members)
        self.a0 = np.log(count.sum(1) / count.sum()).astype(np.float32)
        self.b0 = np.log(count / count.sum(1, keepdims=True)).astype(np.float32)
        self.tables = [np.zeros((1 << self.bits, width), np.float32) for width in (shape.classes, shape.members, FAN)]
        self.acc = [np.zeros(1 << self.bits, np.float32) for _ in self.tables]
        self.last = np.zeros(1 << self.bits, np.int32)  # scratch of step()

    def without(self, *names: str) -> Model:
        """A copy to send where these parts aren't used."""
        new = copy(self)
        for name in names:
            setattr(new, name, None)
        return new

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Each word's rank; one for the slot of a word that the corpus doesn't have."""
        out = np.empty(len(h), np.uint32)
        rest = np.ones(len(h), bool)
        if len(self.hash):
            at = self.place[(h >> self.shift).astype(np.int64)]
            same = self.hash[at] == h
            out[same], rest = at[same], ~same
        rest = np.flatnonzero(rest)
        u, back = np.unique(h[rest], return_inverse=True)
        ranks = (self.words + (u % U64(self.shape.rare)).astype(np.int64)).astype(np.uint32)
        if len(self.rare_hash):
            at = np.minimum(np.searchsorted(self.rare_hash, u), len(self.rare_hash) - 1)
            same = self.rare_hash[at] == u
            ranks[same] = self.rare_rank[at[same]]
        out[rest] = ranks[back]
        return out

    def choices(self, past: list[np.ndarray], target: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(table, positions, rows, logits, truth) of every softmax on the way to
        the words; rows are features x positions."""
        shift = U64(64 - self.bits)
        keys = np.empty((len(FEATURES), len(target)), U64)
        for k, back in enumerate(FEATURES):
            keys[k] = k + 1
            for o in back:
                keys[k] = (keys[k] + past[o - 1]) * _ODD
                keys[k] ^= keys[k] >> U64(29)
        slot, at = self.slot[target].astype(np.int64), np.arange(len(target))
        klass, member = np.divmod(slot, self.shape.members)

        def rows(own: np.ndarray, node: np.ndarray) -> np.ndarray:
            return (((own + node.astype(U64)) * U64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)

        yield 0, at, rows(keys, np.zeros(1)), self.a0, klass
        yield 1, at, rows(keys, klass + 1), self.b0.take(klass, axis=0), member
        at = np.flatnonzero(slot >= self.shape.known)
        if len(at):
            low, leaf, keys = slot[at] - self.shape.known, self.leaf[target[at]].astype(np.int64), keys[:, at]
            for k, tree in enumerate(self.tree):
                below = leaf >> DEEP * (len(self.tree) - 1 - k)
                node, branch = below >> DEEP, below & (FAN - 1)
                yield 2, at, rows(keys, (node * self.shape.rare + low) * 16 + k), tree.reshape(-1, FAN).take(low * tree.shape[1] + node, axis=0), branch

    def logits(self, table: int, rows: np.ndarray, base: np.ndarray) -> np.ndarray:
        w = self.tables[table]
        z = w.take(rows[0], axis=0)
        z += base
        more = np.empty_like(z)
        for r in rows[1:]:
            z += w.take(r, axis=0, out=more, mode="clip")
        return z

    def step(self, past: list[np.ndarray], target: np.ndarray, touched: list[np.ndarray]) -> None:
        for t, pos, rows, base, truth in self.choices(past, target):
            p = self.logits(t, rows, base)
            np.exp(p, out=p)
            p *= (-1 / _row_sums(p))[:, None]
            p[np.arange(len(pos)), truth] += 1
            acc, table, width = self.acc[t], self.tables[t], p.shape[1]
            size = np.einsum("ij,ij->i", p, p) / np.float32(width)
            # whole rows, and numbers two at a time where there is an even number of them
            whole, unit = table.view(f"V{4 * width}").reshape(-1), np.float32 if width % 2 else np.complex64
            flat, columns = table.reshape(-1).view(unit), np.arange(width * 4 // np.dtype(unit).itemsize)
            change, now, at = np.empty_like(p), np.empty_like(p), np.arange(len(pos), dtype=np.int32)
            for r in rows:
                np.add.at(acc, r, size)
                np.multiply(p, (RATE / np.sqrt(acc[r] + EPS))[:, None], out=change)
                # of positions that share a row the last one stays, then the others add up
                self.last[r] = at
                others = np.flatnonzero(self.last[r] != at)
                table.take(r, axis=0, out=now, mode="clip")
                now += change
                whole[r] = now.view(whole.dtype).reshape(-1)
                if len(others):
                    place = (r[others] * len(columns))[:, None] + columns
                    np.add.at(flat, place.reshape(-1), change.take(others, axis=0).reshape(-1).view(unit))
                np.add.at(touched[t], r, np.float32(1))

    def log_probability(self, past: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        out = np.zeros(len(target), np.float32)
        for t, pos, rows, base, truth in self.choices(past, target):
            z = self.logits(t, rows, base)
            own = z[np.arange(len(pos)), truth]
            np.exp(z, out=z)
            out[pos] += own - np.log(_row_sums(z))
        shared = np.flatnonzero((self.leaf[target] == 0) & (self.slot[target] >= self.shape.known))
        out[shared] -= self.share[self.slot[target[shared]] - self.shape.known]
        return out


def _row_sums(p: np.ndarray) -> np.ndarray:
    return p @ np.ones(p.shape[1], np.float32)  # faster than sum(axis=1)


def batches_of(offset: np.ndarray, flat: np.ndarray, none: int, size: int = MINI) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(first position, words before, words) of runs of ``size`` positions of
    documents that lie end to end; none sees the document before its own, but ``none``."""
    reach = max(o for f in FEATURES for o in f)
    start = np.repeat(offset[:-1], np.diff(offset))
    for i in range(0, len(flat), size):
        j = min(i + size, len(flat))
        pos = np.arange(i, j)
        inside = pos - start[i:j]
        past = [np.where(inside >= o, flat[np.maximum(pos - o, 0)], none).astype(U64) for o in range(1, reach + 1)]
        yield i, past, flat[i:j]


def _ranks_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off, data = C.string_buffers(col)
    return (off - off[0]) // 4, np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint32)


def _counts(docs: DataFrame) -> DataFrame:
    """(word, n): hashes of words and how often they occur in all documents."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for _, _, w in C.word_chunks(b.column(0)):
                if len(w.hash):
                    parts.append(np.unique(w.hash, return_counts=True))
                    held += len(parts[-1][0])
                if held > 2_000_000:
                    yield merged(parts)
                    parts, held = [], 0
        if parts:
            yield merged(parts)

    return docs.select(C.norm(F.col("text")).alias("norm")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _from_most(counts: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and counts in runs, from the most frequent word on. They come to the
    driver a partition at a time; what the caller doesn't take is not fetched."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in b.columns], names=["word", "n"])

    for r in counts.orderBy(F.desc("n"), "word").mapInArrow(packed, "word binary, n binary").toLocalIterator():
        yield np.frombuffer(r.word, U64), np.frombuffer(r.n, np.int64)


#: What only the ranks of words, and what only their probabilities need.
VOCABULARY, WEIGHTS = ("hash", "place", "rare_hash", "rare_rank"), ("slot", "leaf", "tree", "tables", "acc", "last")


def encoded(docs: DataFrame, known: Broadcast, rounds: int) -> DataFrame:
    """(doc_id, part, ranks): every row of ``docs`` as the ranks of its words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, w in C.word_chunks(b.column("norm")):
                flat = known.value.ranks(w.hash)
                data = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((w.offset * 4).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), data], names=["doc_id", "ranks"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.norm(F.col("text")).alias("norm"))
    out = thin.mapInArrow(lambda it: C.tidy(encode(it)), "doc_id long, ranks binary")
    return out.withColumn("part", F.pmod(F.xxhash64("ranks"), F.lit(rounds)).cast("int"))


def train(spark: SparkSession, docs: DataFrame, shape: Shape | None = None, leaves: int = LEAVES) -> tuple[Model, DataFrame]:
    """The model of ``docs``, and ``docs`` encoded."""
    shape = shape or Shape()
    C.small_batches(spark)
    counts = C.written(spark, _counts(docs), "lm-counts")
    # by rare slot, how many words and the sum of their counts; then without those that have a leaf
    slot = F.expr(f"pmod(pmod(word, {shape.rare}) + {(1 << 64) % shape.rare} * cast(word < 0 as int), {shape.rare})")
    beyond = np.zeros((2, shape.rare))
    for r in counts.groupBy(slot.cast("int").alias("slot")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect():
        beyond[:, r.slot] = r.k, r.n
    words, n = np.empty(min(leaves, int(beyond[0].sum())), U64), np.empty(min(leaves, int(beyond[0].sum())), np.int64)
    at = 0
    for h, c in _from_most(counts):
        h, c = h[: len(words) - at], c[: len(words) - at]
        words[at : at + len(h)], n[at : at + len(h)] = h, c
        at += len(h)
        own = (h % U64(shape.rare)).astype(np.int64)
        beyond -= np.stack([np.bincount(own, minlength=shape.rare), np.bincount(own, c, shape.rare)])
        if at == len(words):
            break
    model = Model(shape, words, n, (beyond[0], beyond[1]))
    del words, n
    C.release()
    known = spark.sparkContext.broadcast(model.without(*WEIGHTS))
    own = C.written(spark, encoded(docs, known, shape.rounds), "lm-encoded")
    known.destroy()
    for part in range(shape.rounds if model.words else 0):
        _round(spark, own.where(F.col("part") == part), model)
    return model, own


def _round(spark: SparkSession, own: DataFrame, model: Model) -> None:
    """One exchange of updates; changes ``model``."""
    shared = spark.sparkContext.broadcast(model.without(*VOCABULARY))
    blocks = -(-(1 << model.bits) // BLOCK)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        old = shared.value
        new = copy(old)
        new.tables, new.acc = [t.copy() for t in old.tables], [a.copy() for a in old.acc]
        touched = [np.zeros(len(a), np.float32) for a in old.acc]
        for b in batches:
            offset, flat = _ranks_of(b.column(0))
            for _, past, target in batches_of(offset, flat, old.start):
                new.step(past, target, touched)
        out = []
        for t in range(len(touched)):
            for k in range(blocks):
                n = touched[t][k * BLOCK : (k + 1) * BLOCK]
                hit = np.flatnonzero(n)
                if len(hit):
                    at = hit + k * BLOCK
                    # half precision, kept within its range; test_lm_words.py compares it with single
                    change = np.clip(new.tables[t][at] - old.tables[t][at], -60000, 60000).astype(np.float16)
                    out.append((t, k, TaskContext.get().partitionId(), hit.astype(np.uint16).tobytes(), n[hit].tobytes(), (new.acc[t][at] - old.acc[t][at]).tobytes(), change.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["t", "block", "task", "hit", "n", "acc", "change"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def done() -> pa.RecordBatch:
            n = np.maximum(sums[0], 1)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([(sums[1] / n).astype(np.float32).tobytes()], pa.binary()), pa.array([(sums[2] / n[:, None]).astype(np.float32).tobytes()], pa.binary())], names=["t", "block", "acc", "change"])

        for b in batches:
            for t, k, _, hit, n, acc, change in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (t, k) != now:
                    if now:
                        yield done()
                    now, sums = (t, k), [np.zeros(BLOCK), np.zeros(BLOCK), np.zeros((BLOCK, shared.value.tables[t].shape[1]))]
                at, n = np.frombuffer(hit, np.uint16), np.frombuffer(n, np.float32).astype(np.float64)
                sums[0][at] += n
                sums[1][at] += n * np.frombuffer(acc, np.float32)
                sums[2][at] += n[:, None] * np.frombuffer(change, np.float16).reshape(len(at), -1)
        if now:
            yield done()

    # a task for each core, as every task sends the rows it touched
    deltas = own.select("ranks").coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(learn, "t int, block int, task int, hit binary, n binary, acc binary, change binary")
    sums = deltas.repartition("t", "block").sortWithinPartitions("t", "block", "task").mapInArrow(merge, "t int, block int, acc binary, change binary")
    # the model's size, whatever the corpus; a part of it at a time comes to the driver
    for r in C.written(spark, sums, "lm-changes").toLocalIterator():
        lo, hi = r.block * BLOCK, min((r.block + 1) * BLOCK, len(model.acc[r.t]))
        model.acc[r.t][lo:hi] += np.frombuffer(r.acc, np.float32)[: hi - lo]
        model.tables[r.t][lo:hi] += np.frombuffer(r.change, np.float32).reshape(BLOCK, -1)[: hi - lo]
    shared.destroy()
    C.release()


def score_encoded(spark: SparkSession, own: DataFrame, model: Model) -> DataFrame:
    shared = spark.sparkContext.broadcast(model.without(*VOCABULARY, "acc", "last"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            offset, flat = _ranks_of(b.column("ranks"))
            lp = np.zeros(len(flat))
            for i, past, target in batches_of(offset, flat, m.start, SCORED):
                lp[i : i + len(target)] = m.log_probability(past, target)
            total = np.diff(np.concatenate([[0], np.cumsum(lp)])[offset]) / -np.log(2)
            n = np.diff(offset)
            each = total / np.maximum(n, 1)
            none = n == 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.round(each, 3), mask=none), pa.array(np.round(np.exp2(each), 2), mask=none), pa.array(np.round(total, 3), mask=none), pa.array(n)], names=["doc_id", "bits_per_word", "perplexity", "bits", "words"])

    return own.select("doc_id", "ranks").mapInArrow(score, "doc_id long, bits_per_word double, perplexity double, bits double, words long")


def scored(spark: SparkSession, docs: DataFrame, corpus: DataFrame | None = None, shape: Shape | None = None) -> DataFrame:
    """(doc_id, bits_per_word, perplexity, bits, words) of ``docs`` under the
    model of ``corpus``, by default of ``docs`` themselves."""
    model, own = train(spark, docs if corpus is None else corpus, shape)
    if corpus is not None:
        own = encoded(docs, spark.sparkContext.broadcast(model.without(*WEIGHTS)), model.shape.rounds)
    return score_encoded(spark, own, model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, C.table(spark, sf_dir, "documents"))
