import tracemalloc
from copy import copy

import numpy as np
import pytest

from semblance.llm import lm

TINY = lm.Shape(4, 4, 2, 8, 2)


def test_each_word_has_its_own_probability():
    """3,000 words in 14 slots of their own and 2 rare ones: untrained, the model is their unigram distribution."""
    rng = np.random.default_rng(5)
    h, n = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), np.sort(rng.integers(1, 5000, 3000))[::-1]
    h[::2] += np.uint64(1)
    m = lm.Model(TINY, h, n)
    assert m.ranks(h).tolist() == list(range(3000)) and len(m.tree) == 3
    past = [np.full(m.start, m.start, np.uint64)] * 2
    p = np.exp(m.log_probability(past, np.arange(m.start)).astype(float))
    assert p.sum() == pytest.approx(1, abs=1e-3) and p[:3000] == pytest.approx(n / n.sum(), rel=2e-2)


def test_rare_words_differ_by_count_and_history(spark):
    common = " ".join(f"c{i} " * 9 for i in range(14))
    texts = [common] * 40 + ["left alpha right beta " * 10] * 20 + [f"{w} only" for w in ("zeta", "eta", "theta", "iota")]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    probe = spark.createDataFrame([(1, "alpha"), (2, "zeta"), (3, "left alpha right beta"), (4, "left beta right alpha")], "doc_id long, text string")
    b = {r.doc_id: r.bits for r in lm.scored(spark, probe, corpus, TINY).collect()}
    assert b[1] < b[2] and b[3] < b[4]


def test_the_driver_builds_a_model_in_few_bytes_a_word():
    rng = np.random.default_rng(6)
    h, n = rng.integers(0, 1 << 63, 300_000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 300_000).astype(np.uint64), np.ones(300_000, np.int64)
    tracemalloc.start()
    try:
        m = lm.Model(lm.Shape(), h, n)
        fixed = sum(x.nbytes for x in (*m.tables, *m.acc, m.place))
        assert (tracemalloc.get_traced_memory()[1] - fixed) / len(h) < 50
    finally:
        tracemalloc.stop()


def test_words_and_weights_reach_the_driver_in_parts(spark, monkeypatch):
    """Only the two numbers of each rare slot are collected at once."""
    corpus = spark.createDataFrame([(i, f"a b c w{i} x{i % 7} " * 3) for i in range(90)], "doc_id long, text string")
    kind, rows = type(corpus), []
    collect, arrow = kind.collect, kind.toArrow
    monkeypatch.setattr(kind, "collect", lambda df: rows.append(len(out := collect(df))) or out)
    monkeypatch.setattr(kind, "toArrow", lambda df: rows.append(len(out := arrow(df))) or out)
    model, _ = lm.train(corpus.sparkSession, corpus, TINY, leaves=60)
    assert model.words == 60 and any(t.any() for t in model.tables) and max(rows, default=0) <= TINY.rare


def test_most_frequent_words_come_first_and_once(spark):
    counts = spark.createDataFrame([(k - 500, 1 + k % 9) for k in range(1000)], "word long, n long")
    got = [(int(w), int(n)) for h, c in lm._from_most(counts) for w, n in zip(h.view(np.int64), c, strict=True)]
    assert got == sorted(((k - 500, 1 + k % 9) for k in range(1000)), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("classes", [4, 3])
def test_positions_that_share_a_row_add_up(classes):
    """One step over repeated words, against sums taken one position at a time."""
    rng = np.random.default_rng(7)
    m = lm.Model(lm.Shape(classes, 5, 2, 8, 1), rng.integers(0, 1 << 63, 200).astype(np.uint64), np.arange(200, 0, -1))
    target = rng.integers(0, 200, 300).astype(np.uint32) % np.uint32(30)
    past = [(rng.integers(0, 3, 300)).astype(np.uint64) for _ in range(2)]
    plain, touched = copy(m), [np.zeros(1 << m.bits, np.float32) for _ in m.tables]
    plain.tables, plain.acc, hits = [t.copy() for t in m.tables], [a.copy() for a in m.acc], [t.copy() for t in touched]
    for t, pos, rows, base, truth in plain.choices(past, target):
        p = np.exp(plain.logits(t, rows, base))
        p *= (-1 / p.sum(1))[:, None]
        p[np.arange(len(pos)), truth] += 1
        for r in rows:
            for i, row in enumerate(r):
                plain.acc[t][row] += (p[i] ** 2).sum() / p.shape[1]
                hits[t][row] += 1
            for i, row in enumerate(r):
                plain.tables[t][row] += p[i] * lm.RATE / np.sqrt(plain.acc[t][row] + lm.EPS)
    m.step(past, target, touched)
    for t in range(3):
        assert np.allclose(m.tables[t], plain.tables[t], atol=1e-4) and np.allclose(m.acc[t], plain.acc[t], rtol=1e-4) and np.array_equal(touched[t], hits[t])
