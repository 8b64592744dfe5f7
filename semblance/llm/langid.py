"""Language identification by hierarchical discrimination.

The family is predicted first, by one linear support vector machine for each
family against the others. Within the family, one-versus-one linear machines
separate its languages: each pair votes, and the sum of margins breaks ties.

Features are byte bigrams and trigrams of the normalised whole text, hashed
into ``2^BITS`` counts, square-rooted and scaled to length one. A block of
documents is one count matrix, and all machines are one product with it.

Machines (squared hinge, L2) are fitted on the driver from about ``LABELLED``
documents with a given ``lang``, evenly by language, chosen by a hash of id and
text: a documented bound for fitting, as is ``LANGUAGES``. All rows are predicted, on whole texts.

Defined results: a row for each input row; texts that are null, empty or without
words have null family, language and margin; rows with a null ``lang`` teach
nothing and are predicted; a family of one language needs no second step; if
only one language is given it is predicted for every text, with margin 0;
without any, family and language are null. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS, LABELLED = 12, 4096
#: Languages a model tells apart, at most: the most frequent values of ``lang``.
LANGUAGES = 256
#: Documents in one count matrix.
ROWS = 512
_FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "iranian": "fa ku ps",
    "semitic": "ar he",
    "indic": "hi ur bn mr ne pa gu",
}
FAMILIES = {code: family for family, codes in _FAMILIES.items() for code in codes.split()}


def matrices(col: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, features) of runs of rows."""
    off, data = C.string_buffers(col)
    size, n, i = 1 << bits, len(off) - 1, 0
    while i < n:
        j = max(i + 1, min(i + ROWS, int(np.searchsorted(off, off[i] + C.CHUNK_BYTES, "right")) - 1))
        at = off[i : j + 1] - off[i]
        b = data[off[i] : off[j]].astype(np.uint32)
        doc = np.repeat(np.arange(j - i), np.diff(at))
        total = np.zeros((j - i) * size)
        for order, odd in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
            if len(b) >= order:
                m = len(b) - order + 1
                key = b[:m].copy()
                for k in range(1, order):
                    key = (key << np.uint32(8)) | b[k : k + m]
                own = doc[:m] == doc[order - 1 :]
                slot = (key * np.uint32(odd)) >> np.uint32(32 - bits)
                total += np.bincount((doc[:m] * size + slot)[own], minlength=len(total))
        x = np.sqrt(total).reshape(j - i, size).astype(np.float32)
        yield i, j, x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
        i = j


def svm(x: np.ndarray, y: np.ndarray, c: float = 1000.0, steps: int = 150) -> np.ndarray:
    """Weights (the last is the intercept) of a linear machine with squared
    hinge loss, both classes weighing the same, by Nesterov's method."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    weight = np.where(y > 0, c / 2 / max(1, (y > 0).sum()), c / 2 / max(1, (y <= 0).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest curvature
        v = x.T @ (weight * (x @ v))
        top = float(np.sqrt(v @ v))
        v /= np.float32(top)
    step = np.float32(1 / (1 + 2.2 * top))
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * (x.T @ (weight * y * slack)))
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


class Model:
    def __init__(self, langs: list[str], families: dict[str, str]):
        self.langs = sorted(langs)
        self.family = [families.get(x, x) for x in self.langs]
        self.families = sorted(set(self.family))
        self.weights: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []

    def fit(self, x: np.ndarray, lang: np.ndarray) -> Model:
        """``lang``: positions in ``langs``."""
        family = np.array([self.families.index(f) for f in self.family])[lang]
        ones = lambda m: np.where(m, 1.0, -1.0)
        self.weights = [svm(x, ones(family == k)) for k in range(len(self.families))] if len(self.families) > 1 else []
        for a in range(len(self.langs)):
            for b in range(a + 1, len(self.langs)):
                if self.family[a] == self.family[b]:
                    m = (lang == a) | (lang == b)
                    self.pairs.append((a, b))
                    self.weights.append(svm(x[m], ones(lang[m] == a)))
        self.w = np.array(self.weights).T if self.weights else np.zeros((x.shape[1] + 1, 0))
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``langs``, the least margin of the decisions that led there)."""
        z = x @ self.w[:-1] + self.w[-1]
        k, n = len(self.families), len(x)
        if k > 1:
            family, margin = z[:, :k].argmax(1), np.diff(np.sort(z[:, :k], axis=1)[:, -2:], axis=1)[:, 0]
            z = z[:, k:]
        else:
            family, margin = np.zeros(n, np.int64), np.zeros(n)
        votes = np.full((n, len(self.langs)), -np.inf)
        for i, f in enumerate(self.family):
            votes[family == self.families.index(f), i] = 0
        for p, (a, b) in enumerate(self.pairs):
            votes[:, a] += (z[:, p] > 0) + 1e-3 * np.tanh(z[:, p])
            votes[:, b] += (z[:, p] <= 0) - 1e-3 * np.tanh(z[:, p])
        lang = votes.argmax(1)
        for p, (a, b) in enumerate(self.pairs):
            own = (lang == a) | (lang == b)
            margin[own] = np.minimum(margin[own], np.abs(z[own, p])) if k > 1 or p else np.abs(z[own, p])
        return lang, margin


def train(spark: SparkSession, docs: DataFrame, labelled: int = LABELLED, families: dict[str, str] | None = None, bits: int = BITS) -> Model | None:
    size = {r["lang"]: r["count"] for r in docs.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not size:
        return None
    model = Model(list(size), FAMILIES if families is None else families)
    each = labelled / len(size)
    share = F.create_map(*(F.lit(v) for code in model.langs for v in (code, min(1.0, each / size[code]))))
    code = F.create_map(*(F.lit(v) for i, c in enumerate(model.langs) for v in (c, i)))
    own = docs.where(F.col("lang").isNotNull() & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)))
    own = own.select(code[F.col("lang")].alias("code"), C.norm(F.col("text")).alias("norm")).where("norm <> ''")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x in matrices(b.column("norm"), bits):
                yield pa.RecordBatch.from_arrays([b.column("code").slice(i, j - i), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["code", "x"])

    got = own.mapInArrow(rows, "code int, x binary").toArrow()
    if not got.num_rows:
        return None
    y = got["code"].to_numpy()
    x = np.frombuffer(b"".join(v.as_py() for v in got["x"]), np.float16).reshape(len(y), -1).astype(np.float32)
    order = np.lexsort((*(x[:, k] for k in range(0, x.shape[1], 512)), y))  # rows arrive in any order
    if len(set(y.tolist())) < len(model.langs):  # a language may have had only empty texts
        have = sorted(set(y.tolist()))
        model, y = Model([model.langs[k] for k in have], FAMILIES if families is None else families), np.searchsorted(have, y)
    return model.fit(x[order], y[order])


def identified(spark: SparkSession, docs: DataFrame, labelled: int = LABELLED, families: dict[str, str] | None = None, bits: int = BITS) -> DataFrame:
    """(doc_id, family, language, margin) of every row."""
    model = train(spark, docs, labelled, families, bits)
    shared = spark.sparkContext.broadcast(model)
    kind = "doc_id long, family string, language string, margin double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            off, _ = C.string_buffers(b.column("norm"))
            known = (np.diff(off) > 0) & (m is not None)
            lang, margin = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for i, j, x in matrices(b.column("norm"), bits) if m else ():
                lang[i:j], margin[i:j] = m.predict(x)
            at = pa.array(lang, mask=~known)
            names, families_ = (m.langs, m.family) if m else ([""], [""])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(families_).take(at), pa.array(names).take(at), pa.array(np.round(margin, 6), mask=~known)], names=["doc_id", "family", "language", "margin"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.norm(F.col("text")).alias("norm"))
    return thin.mapInArrow(rows, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, C.table(spark, sf_dir, "documents"))
