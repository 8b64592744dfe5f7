"""TF-IDF weights as aggregations; SimHash fingerprints and cosine, text by text, from counts of features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grams
from ..functions.grams import U, binary, release
from ..functions.text import once
from ..sources.store import stored
from . import counts
from .counts import Counts

#: Features whose weights are looked up at once.
GRAMS = 1 << 19


def term_frequency(docs: DataFrame, features: Column, keys: list[str]) -> DataFrame:
    """(keys, feature, tf); the keys are those of a row, whose features are counted where they are."""

    @F.arrow_udf("array<struct<feature: string, tf: bigint>>")
    def of(col: pa.Array) -> pa.Array:
        at = np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded = col.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        rows = [grams.distinct(code[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        own, tf = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*rows, strict=True))
        each = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(own.astype(np.int64))).cast(pa.string()), pa.array(tf)], ["feature", "tf"])
        release()
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(c) for c, _ in rows)]), pa.int32()), each)

    own = once(docs, {"_features": features}).select(*keys, of(F.col("_features")).alias("_each"))
    return own.select(*keys, F.explode("_each").alias("x")).select(*keys, "x.feature", "x.tf")


def idf(tf: DataFrame, n: int) -> DataFrame:
    """(feature, df, idf) of ``n`` documents, empty ones counted."""
    return tf.groupBy("feature").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1)


def weights(tf: DataFrame, model: DataFrame, n: int) -> DataFrame:
    """``tf`` with ``weight``; a feature the model lacks counts as in no document."""
    unseen = F.log(F.lit(float(n + 1))) + 1
    return tf.join(model.select("feature", "idf"), "feature", "left").withColumn("weight", (1 + F.log("tf")) * F.coalesce("idf", unseen)).drop("idf")


def weight_counts(weighted: DataFrame, n: int) -> Counts:
    """The counts of features of a frame whose columns are all :func:`weighted`."""
    return counts.counted(weighted, lambda b: (binary(c.field("h"), U)[0] for c in b.columns), n)


def fingerprint(weighted: Column, model: Counts) -> Column:
    """Of :func:`weighted` features. Weights are whole millionths, so sums have no order;
    a bit is set where its sum is 0 or more, and no features give 0."""

    @F.arrow_udf("long")
    def of(col: pa.Array) -> pa.Array:
        h, at = binary(col.field("h"), U)
        tf, _ = binary(col.field("tf"), np.int32)
        w = np.floor((1 + np.log(tf)) * model.idf(h) * 1e6 + 0.5)
        out = np.zeros(len(col), U)
        for i in np.flatnonzero(np.diff(at)):
            # sums of whole numbers below 2^53, so exact
            own, sums = w[at[i] : at[i + 1]], np.zeros(64)
            for k in range(0, len(own), 4096):
                bits = np.unpackbits(h[at[i] + k : at[i] + min(k + 4096, len(own))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums += own[k : k + 4096] @ bits.astype(np.float64)
            out[i] = np.packbits(2 * sums >= own.sum(), bitorder="little").view(U)[0]
        release()
        return pa.array(out.view(np.int64))

    return of(weighted)


def fingerprints(docs: DataFrame, features: Column, key: str, model: Counts | None = None, profile: str = "blake2b") -> DataFrame:
    """(key, fingerprint) of every row; without ``model`` the IDF is of ``docs`` themselves.
    The features' hashes are stored once; only sums of counts are exchanged."""
    own = once(docs, {"_features": features})
    own = stored(own.select(key, grams.weighted(F.col("_features"), profile).alias("weighted")), "weighted")
    model = model or weight_counts(own.select("weighted"), own.count())
    return own.select(key, fingerprint(F.col("weighted"), model).alias("fingerprint"))


def sides(pairs: DataFrame, key: str, columns: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """Two rows a pair: (key, side, columns)."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), *(F.col(f"{c}_{s}").alias(c) for c in columns)) for s in "ab"))).alias("x")
    return pairs.select(key, each).select(key, "x.*")


def gram_counts(pairs: DataFrame, words: tuple[int, ...], chars: tuple[int, ...], least: int = 2) -> Counts:
    """The counts of the n-grams of both sides of stored ``pairs``; with ``least`` 1 they serve for other texts too."""
    both = pairs.select(*(grams.joined(F.col(f"tokens_{s}")) for s in "ab"))
    return counts.counted(both, lambda b: (h for c in b.columns for h, _ in grams.counted(c, words, chars)), 2 * pairs.count(), least)


def cosine(a: Column, b: Column, words: tuple[int, ...], chars: tuple[int, ...], model: Counts) -> Column:
    """Of two arrays of tokens, by TF-IDF weights; 0 if a side has no features."""

    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        out, held, size = [], [], 0

        def flush() -> None:
            idf = model.idf(np.concatenate([h for h, _ in held]))
            cuts = np.cumsum([0, *(len(h) for h, _ in held)])
            w = [(1 + np.log(tf)) * idf[i:j] for (_, tf), i, j in zip(held, cuts[:-1], cuts[1:], strict=True)]
            for (p, _), (q, _), v, u in zip(held[::2], held[1::2], w[::2], w[1::2], strict=True):
                if not len(p) or not len(q):
                    out.append(0.0)
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                same = q[at] == p
                out.append(float(v[same] @ u[at[same]] / np.sqrt((v @ v) * (u @ u))))

        for p, q in zip(grams.counted(x, words, chars), grams.counted(y, words, chars), strict=True):
            held += [p, q]
            size += len(p[0]) + len(q[0])
            if size >= GRAMS:
                flush()
                held, size = [], 0
        if held:
            flush()
            held = []
        release()
        return pa.array(out, pa.float64())

    return of(grams.joined(a), grams.joined(b))


def pair_cosine(pairs: DataFrame, key: str, words: tuple[int, ...], chars: tuple[int, ...], name: str = "cosine", model: Counts | None = None) -> DataFrame:
    """(key, name): cosine of both sides' n-grams of words and characters; IDF of all sides, or from a ``model``.
    Give it a stored table: it is read twice."""
    model = model or gram_counts(pairs, words, chars)
    return pairs.select(key, cosine(F.col("tokens_a"), F.col("tokens_b"), words, chars, model).alias(name))
