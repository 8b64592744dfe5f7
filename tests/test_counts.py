"""Fingerprints, cosine and count tables against plain Python, and what their plans exchange."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semblance.functions import grams
from semblance.operators import tfidf
from semblance.plans import pipelines as PL
from semblance.plans.queries import QUERIES

DRAW = random.Random(7)
TEXTS = [" ".join(DRAW.choice("alpha beta gamma été straße كتاب 𝔘𝔫 zeta".split()) + str(DRAW.randrange(9)) for _ in range(DRAW.randrange(1, 40))) for _ in range(60)] + ["", "ab", "a b"]


def features(t, words, chars):
    w = t.split()
    return Counter([f"w{n}:" + " ".join(w[i : i + n]) for n in words for i in range(len(w) - n + 1)] + [f"c{n}:" + t[i : i + n] for n in chars for i in range(len(t) - n + 1)])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("words,chars", [((1,), ()), ((1, 2), (3, 4, 5))])
def test_grams_are_told_apart_and_counted(words, chars, monkeypatch):
    monkeypatch.setattr(grams, "CHUNK", 300)
    got = list(grams.counted(pa.array([*TEXTS, None]), words, chars))
    ids = {}
    for t, (h, n) in zip([*TEXTS, ""], got, strict=True):
        want = features(t, words, chars)
        assert sorted(want.values()) == sorted(n.tolist())
        for f, k in want.items():
            ids.setdefault(f, set(h[n == k].tolist())).intersection_update(h[n == k].tolist())
    assert all(ids.values()) and len({frozenset(x) for x in ids.values() if len(x) == 1}) == sum(len(x) == 1 for x in ids.values())


def test_pair_cosine_against_plain_python(spark):
    rows = [(i, TEXTS[i].split(), TEXTS[-1 - i].split()) for i in range(len(TEXTS))]
    pairs = spark.createDataFrame(rows, "k long, tokens_a array<string>, tokens_b array<string>").repartition(3)
    out = tfidf.pair_cosine(pairs, "k", (1, 2), (3, 4, 5))
    sides = [[features(" ".join(x), (1, 2), (3, 4, 5)) for x in r[1:]] for r in rows]
    df, n = Counter(f for s in sides for x in s for f in x), 2 * len(rows)
    for r in out.collect():
        a, b = ({f: (1 + math.log(t)) * (math.log((n + 1) / (df[f] + 1)) + 1) for f, t in x.items()} for x in sides[r.k])
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        assert r.cosine == pytest.approx(sum(v * b.get(f, 0) for f, v in a.items()) / norm if norm else 0.0)
    stored = spark.createDataFrame(rows, "k long, tokens_a array<string>, tokens_b array<string>")
    assert exchanges(tfidf.pair_cosine(stored, "k", (1,), ())) == 0  # features were grouped and joined, three exchanges


def test_a_models_counts_serve_other_texts(spark):
    rows = [(0, ["a", "b"], ["a"]), (1, ["c"], ["a", "c"])]
    pairs = spark.createDataFrame(rows, "k long, tokens_a array<string>, tokens_b array<string>")
    model = tfidf.gram_counts(pairs.where("k = 0"), (1,), (), least=1)
    h = {w: next(grams.counted(pa.array([w]), (1,), ()))[0] for w in "abc"}
    assert [int(model.of(h[w])[0]) for w in "abc"] == [2, 1, 0]


@pytest.mark.parametrize("profile", ["md5", "blake2b"])
def test_fingerprints_against_plain_python(spark, profile):
    rows = [(i, t.split()) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "k long, tokens array<string>")
    out = tfidf.fingerprints(docs, F.col("tokens"), "k", profile=profile)
    df = Counter(w for _, t in rows for w in set(t))
    raw = (lambda w: hashlib.md5(w.encode()).digest()[:8]) if profile == "md5" else (lambda w: hashlib.blake2b(w.encode(), digest_size=8, person=b"plag-sim").digest())
    got = {r.k: r.fingerprint for r in out.collect()}
    for i, t in rows:
        sums = np.zeros(64)
        for w, tf in Counter(t).items():
            h = int.from_bytes(raw(w), "big")
            sums += np.array([1 if h >> b & 1 else -1 for b in range(64)]) * round((1 + math.log(tf)) * (math.log((len(rows) + 1) / (df[w] + 1)) + 1) * 1e6)
        want = sum(1 << b for b in range(64) if sums[b] >= 0) if t else 0
        assert got[i] & (1 << 64) - 1 == want
    assert exchanges(out) == 0  # every feature was exchanged twice


def test_scores_need_no_join(spark):
    pairs = spark.createDataFrame([(i, TEXTS[i], TEXTS[i + 1], i % 2) for i in range(20)], "pair_id long, text_a string, text_b string, label int")
    out = PL.score_pairs(pairs, rule=PL.PairConfig(cosine_threshold=0.3), methods=("simhash", "cosine"))
    assert exchanges(out) == 0 and out.count() == 20


def test_queries_bound_their_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    spark.createDataFrame([(0, "a b c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["minhash_signature"](spark, str(tmp_path)).count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_shingles_are_made_once_and_sorted_natively(spark, tmp_path):
    spark.createDataFrame([(0, "a b c d"), (1, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = lambda q: QUERIES[q](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan("shingles_k3") and "sequence" not in plan("shingles_k3")
    assert plan("lsh_bands").count("concat_ws") == 1  # the filter of empty documents made them again
    assert [r.n for r in QUERIES["shingles_k3"](spark, str(tmp_path)).orderBy("doc_id").collect()] == [1, 0]


def test_term_frequencies_are_counted_in_the_row(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["b"])], "doc_id long, tokens array<string>")
    out = tfidf.term_frequency(docs, F.col("tokens"), ["doc_id"])
    assert {tuple(r) for r in out.collect()} == {(1, "a", 2), (1, "b", 1), (3, "b", 1)}
    assert exchanges(out) == 0  # every word was exchanged
