"""Toxicity by gradient-boosted trees over dense features, calibrated.

Features of a document, whole text: densities and distinct hits of the lexicon
(seed words, words and word beginnings that labelled toxic documents use far
more than others), the same after undoing obfuscation (digits and signs for
letters, marks between letters), nearness of second-person words to hits,
capitals, punctuation, exclamation, digits, obfuscation rates and lengths.

Labelled texts are dealt out by the order of their hashes, copies as one and each
kind by itself: half teaches the lexicon, a quarter the trees, a quarter the
isotonic calibration (with fewer than ``DEALT`` of a kind, all teach all three).
A text labelled both ways teaches nothing. At most ``LABELLED`` labelled rows are used, those of lowest hash (a documented
bound for fitting the classifier); every document is scored on its whole text.

Defined results: null and empty texts score like any text without words and are
never rejected; repeated rows score alike; rows of any columns pass unchanged;
with fewer than four labelled texts of either kind nothing can be fitted, and the
seed lexicon alone decides (a document is toxic if two of its words are seeds and
at least one word in 50 is).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .gbt import Isotonic, Trees

U64 = np.uint64
LABELLED = 20_000
#: Labelled texts of either kind that are needed to deal them out; of fewer, every step uses all.
DEALT = 40
THRESHOLD = 0.5
#: Letters that make a word's beginning.
PREFIX = 6
SEEDS = "idiot stupid moron loser scum trash worthless pathetic disgusting clown dumb jerk bastard imbecile crétin connard salaud débile idiota estúpido imbécil basura idiotisch dumm arschloch abschaum wertlos".split()
SECOND = "you your yours yourself u ur ye thou du dich dir dein deine deinen ihr euch euer sie tu toi te ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split()
NAMES = "hits distinct open_hits open_distinct begin begin_distinct seeds per_word per_word_open near_second second capitals shouting marks exclaims digits odd_signs mixed_words log_words word_length repeat".split()


def undone(text):
    """The text with usual obfuscations undone, normalised."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "013457@$", "oieastas")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?<=\p{L})[*._\-]+(?=\p{L})", ""), r"[^\p{L}\p{N}]+", " "))


class Lexicon:
    def __init__(self, words: list[str], beginnings: list[str]):
        seeds = C.hash_words(SEEDS)
        self.seeds = np.unique(seeds)
        self.words = np.unique(np.concatenate([seeds, C.hash_words(words)]))
        self.begin = np.unique(C.hash_words(beginnings))
        self.second = np.unique(C.hash_words(SECOND))


def _within(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(h):
        return np.zeros(len(h), bool)
    seen = np.zeros(1 << 16, bool)
    seen[(table >> U64(48)).astype(np.int64)] = True
    out = seen[(h >> U64(48)).astype(np.int64)]
    some = np.flatnonzero(out)
    out[some] = table[np.minimum(np.searchsorted(table, h[some]), len(table) - 1)] == h[some]
    return out


def _sums(mask: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offset]).astype(np.float64)


def _distinct(h: np.ndarray, mask: np.ndarray, offset: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(mask)
    doc = np.searchsorted(offset, at, "right") - 1
    out = np.zeros(len(offset) - 1)
    if len(at):
        order = np.lexsort((h[at], doc))
        d, v = doc[order], h[at][order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
        np.add.at(out, d[new], 1)
    return out


_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """Bits of every character: 1 upper case, 2 mark, 4 exclamation, 8 digit, 16 odd sign, 32 letter."""
    global _classes
    if _classes is None:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            ch = chr(c)
            kind = unicodedata.category(ch)
            out[c] = 33 if kind in ("Lu", "Lt") else 32 if kind[0] == "L" else 8 if kind[0] == "N" else 6 if ch in "!?¡¿" else 18 if ch in "*@#$%&^~_|<>" else 2 if kind[0] in "PS" else 0
        _classes = out
    return _classes


def characters(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each begins, its code point) of the characters of UTF-8."""
    start = np.flatnonzero((b & 0xC0) != 0x80).astype(np.int32)
    code = b[start].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    size = 2 + (code[wide] >= 0xE0) + (code[wide] >= 0xF0)
    x = code[wide] & np.array([0, 0, 0x1F, 0x0F, 0x07], np.int32)[size]
    for k in (1, 2, 3):
        more = size > k
        x[more] = (x[more] << 6) | (b[start[wide[more]] + k] & 0x3F)
    code[wide] = x
    return start, code


def features(raw: pa.Array, norm: pa.Array, opened: pa.Array, lex: Lexicon) -> np.ndarray:
    """A row of ``NAMES`` for each document."""
    off, data = C.string_buffers(raw)
    out = np.zeros((len(norm), len(NAMES)))
    for first, last, w in C.word_chunks(opened):
        m = _within(w.hash, lex.words)
        out[first:last, 2], out[first:last, 3] = _sums(m, w.offset), _distinct(w.hash, m, w.offset)
        out[first:last, 8] = out[first:last, 2] / np.maximum(np.diff(w.offset), 1)
    for first, last, w in C.word_chunks(norm, prefix=PREFIX):
        n, o = len(w.hash), w.offset
        count = np.diff(o).astype(np.float64)
        words, begin, second = _within(w.hash, lex.words), _within(w.prefix, lex.begin), _within(w.hash, lex.second)
        any_ = words | begin
        around = np.concatenate([[0], np.cumsum(second)])
        doc = np.repeat(np.arange(last - first), np.diff(o))
        hit = np.flatnonzero(any_)
        lo, hi = np.maximum(hit - 5, o[doc[hit]]), np.minimum(hit + 6, o[doc[hit] + 1])
        near = np.zeros(n, bool)
        near[hit] = around[hi] > around[lo]
        x = out[first:last]
        x[:, 0], x[:, 1] = _sums(words, o), _distinct(w.hash, words, o)
        x[:, 4], x[:, 5] = _sums(begin, o), _distinct(w.hash, begin, o)
        x[:, 6] = _sums(_within(w.hash, lex.seeds), o)
        x[:, 7] = _sums(any_, o) / np.maximum(count, 1)
        x[:, 9] = _sums(near, o) / np.maximum(_sums(any_, o), 1)
        x[:, 10] = _sums(second, o) / np.maximum(count, 1)
        x[:, 18] = np.log1p(count)
        length = np.concatenate([[0], np.cumsum(w.end - w.start)])[o]
        x[:, 19] = np.diff(length) / np.maximum(count, 1)
    at = 0
    while at < len(norm):
        to = max(at + 1, int(np.searchsorted(off, off[at] + (C.CHUNK_BYTES >> 2), "right")) - 1)
        o = off[at : to + 1] - off[at]
        start, b = characters(data[off[at] : off[to]])
        o = np.searchsorted(start, o.astype(np.int32))
        size = np.maximum(np.diff(o), 1)
        c = _class_table()[b]
        letters = np.maximum(_sums(c & 32 != 0, o), 1)
        inside = np.zeros(len(b), bool)
        twice = np.zeros(len(b), bool)
        if len(b) > 2:
            sides = (c[:-2] & 32 != 0) & (c[2:] & 32 != 0)
            inside[1:-1] = sides & (c[1:-1] & 26 != 0)
            twice[2:] = (b[2:] == b[1:-1]) & (b[2:] == b[:-2])
        pair = np.zeros(len(b), bool)
        pair[1:] = (c[1:] & 1 != 0) & (c[:-1] & 1 != 0)
        x = out[at:to]
        x[:, 11], x[:, 12] = _sums(c & 1 != 0, o) / letters, _sums(pair, o) / letters
        for k, bit in ((13, 2), (14, 4), (15, 8), (16, 16)):
            x[:, k] = _sums(c & bit != 0, o) / size
        x[:, 17], x[:, 20] = _sums(inside, o) / letters, _sums(twice, o) / size
        at = to
    return out


class Model:
    def __init__(self, lex: Lexicon, trees: Trees | None = None, scale: Isotonic | None = None):
        self.lex, self.trees, self.scale = lex, trees, scale

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return ((x[:, 6] >= 2) & (x[:, 6] >= 0.02 * np.expm1(x[:, 18]))).astype(np.float64)
        p = self.scale.predict(self.trees.logits(x))
        return np.where(x[:, 18] > 0, p, 0.0)


def _with_texts(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    return docs.withColumn(names[0], C.norm(F.col("text"))).withColumn(names[1], undone(F.col("text")))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    C.small_batches(spark)
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    # a document labelled both ways teaches nothing
    known = known.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    known = known.orderBy(F.xxhash64("id"), "id").limit(labelled)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("text is not null")
    found = thin.join(F.broadcast(known), F.col("doc") == F.col("id")).withColumn("content", F.xxhash64("text"))
    # copies and folds are found on hashes; the texts of the chosen rows are read after that
    sets = found.select("doc", "content", "toxic", C.norm(F.col("text")).alias("norm")).where("norm <> ''").select("doc", "content", "toxic", F.xxhash64("norm").alias("h"))
    sets = sets.groupBy("h", "content", "doc", "toxic").agg(F.count("*").alias("n"))
    sets = sets.groupBy("h").agg(F.min(F.struct("content", "doc")).alias("first"), F.max("n").alias("n"), F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("h"))
    chosen = sets.select(F.col("first.doc").alias("_doc"), F.col("first.content").alias("_content"), "h", "n", (3 - (place - 1) % 4).cast("int").alias("fold"))
    chosen = C.written(spark, chosen, "toxic-chosen")
    own = found.join(F.broadcast(chosen), (F.col("doc") == F.col("_doc")) & (F.col("content") == F.col("_content"))).select("h", "fold", "toxic", "text")
    if not chosen.where("n > 1").isEmpty():  # repeated rows
        own = own.dropDuplicates(["h"])
    own = _with_texts(own, ("norm", "opened"))
    own = C.written(spark, own, "toxic-labelled")
    every = {r.toxic: (r.n, r.m) for r in own.groupBy("toxic").agg(F.count_if(F.col("fold") < 2).alias("n"), F.count("*").alias("m")).collect()}
    if len(every) < 2 or min(m for _, m in every.values()) < 4:
        return Model(Lexicon([], []))
    all_ = min(m for _, m in every.values()) < DEALT
    size = {k: m if all_ else n for k, (n, m) in every.items()}
    first, rest = (own, own) if all_ else (own.where("fold < 2"), own.where("fold >= 2"))

    def telling(words, least: int, bar: float) -> list[str]:
        seen = first.select("toxic", F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        odds = F.log((F.col("t") + 0.5) / (size[1] + 1.0)) - F.log((F.col("c") + 0.5) / (size[0] + 1.0))
        return [r.word for r in seen.where(F.col("t") >= least).where(odds > bar).select("word").collect()]

    words = telling(F.split("norm", " "), max(4, size[1] // 250), 2.5)
    # a beginning is cut in bytes: only those of plain letters are whole
    begin = telling(F.transform(F.split("norm", " "), lambda w: F.substring(w, 1, PREFIX)), max(8, size[1] // 100), 2.5)
    lex = Lexicon(words, sorted({b.encode()[:PREFIX].decode(errors="ignore") for b in begin} & {b for b in begin if len(b.encode()) == PREFIX} | {b for b in begin if len(b.encode()) < PREFIX}))
    shared = spark.sparkContext.broadcast(lex)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"), b.column("norm"), b.column("opened"), shared.value)
            flat = pa.array(x.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("toxic"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(NAMES), dtype=np.int32)), flat)], names=["fold", "toxic", "x"])

    got = rest.select("fold", "toxic", "text", "norm", "opened").mapInArrow(rows, "fold int, toxic int, x array<float>").toArrow()
    fold, y = got["fold"].to_numpy(), got["toxic"].to_numpy().astype(np.float64)
    x = np.array(got["x"].to_pylist(), np.float64)
    order = np.lexsort((*x.T[::-1], y, fold))  # rows arrive in any order
    fold, y, x = fold[order], y[order], x[order]
    a, b = (fold >= 0, fold >= 0) if all_ else (fold == 2, fold == 3)
    trees = Trees().fit(x[a], y[a])
    return Model(lex, trees, Isotonic().fit(trees.logits(x[b]), y[b]))


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, probability, toxic) of every row."""
    model = spark.sparkContext.broadcast(train(spark, docs, labels))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.value.score(features(b.column("text"), b.column("norm"), b.column("opened"), model.value.lex))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "probability", "toxic"])
            C.release()

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _with_texts(thin, ("norm", "opened")).mapInArrow(rows, "doc_id long, probability double, toxic int")


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns."""
    model = spark.sparkContext.broadcast(train(spark, docs, labels))
    names = docs.columns
    norm, opened = (C.fresh(docs, f"toxic_{x}") for x in ("norm", "opened"))
    k, text = len(names), [c.lower() for c in names].index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.value.score(features(b.column(text), b.column(k), b.column(k + 1), model.value.lex))
            yield b.select(list(range(k))).filter(pa.array(p < threshold))
            C.release()

    return _with_texts(docs, (norm, opened)).mapInArrow(rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


