"""Operator 6 against brute force: classes, links and pairs."""

import numpy as np
import pytest

from semblance.llm import jaccard

A = "one two three four five six seven eight nine ten"
B = A.replace("ten", "eleven")
ROWS = [(5, A), (3, B), (1, A), (4, B), (9, A.upper()), (None, B), (2, "nothing like it at all in here"), (6, None), (7, ""), (5, A), (8, "nothing like it at all in here"), (10, "short"), (11, "Short!"), (11, "something else")]
SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").lower().replace("!", "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(x, y):
    o = len(x & y)
    return bool(o) and o >= 0.4 * len(x | y)


def brute(rows):
    """(doc_id, class_id, links) of each row."""
    sets = [grams(t) for _, t in rows]
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    links = [[j for j in range(len(rows)) if j != i and near(sets[i], sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], rows[min(seen, key=order)][0], len(links[i])))
    return sorted(out, key=str)


def got(spark, rows, **how):
    return sorted((tuple(r) for r in jaccard.classes(spark, spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


def close(rng, k, size=40):
    """Sets whose similarity with a common one lies around the threshold."""
    base = [f"b{k}x{i}" for i in range(size)]
    cut = int(rng.integers(size // 2, size))
    return " ".join(base[:cut] + [f"o{rng.integers(1 << 40)}" for _ in range(size - cut)])


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    shared = " ".join(f"licence{i}" for i in range(12))
    texts = [close(rng, k % 12) for k in range(150)] + [f"{shared} " + " ".join(f"u{rng.integers(1 << 40)}" for _ in range(int(rng.integers(0, 30)))) for _ in range(60)]
    texts += texts[:20] + ["few"] * 3
    return [(i, t) for i, t in enumerate(texts)]


def test_classes_and_links(spark):
    assert got(spark, ROWS) == brute(ROWS)
    assert got(spark, [(1, None)]) == [(1, 1, 0)] and got(spark, []) == []


@pytest.mark.parametrize("how", [{}, {"cell": 30}, {"cell": 200, "bucket": 64}, {"hot": 0}, {"bucket": 16, "broadcast_rows": 0}])
def test_work_is_cut_differently_with_equal_results(spark, rows, how):
    """Pairs around 0.4, boilerplate and copies; small cells, many buckets, with frequent n-grams and without."""
    want = brute(rows)
    assert sum(x[2] for x in want) > 1000 and got(spark, rows, **how) == want


def test_frequent_ngrams_may_be_short_lists(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "SHARE", 0.0)
    assert got(spark, rows) == brute(rows)


def test_pairs(spark, rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(grams(t), []).append(i)
    each = [(min(ids), s) for s, ids in sets.items()]
    want = [(a, b) if a < b else (b, a) for x, (a, s) in enumerate(each) for b, t in each[:x] if near(s, t)] + [(min(ids), i) for ids in sets.values() for i in sorted(ids)[1:]]
    pairs = jaccard.similar(spark, spark.createDataFrame(rows, SCHEMA), cell=100).collect()
    assert sorted((r.doc_id_a, r.doc_id_b) for r in pairs) == sorted(want)
    text = dict(rows)
    assert all(r.jaccard == pytest.approx(len(grams(text[r.doc_id_a]) & grams(text[r.doc_id_b])) / len(grams(text[r.doc_id_a]) | grams(text[r.doc_id_b]))) for r in pairs)


def test_one_of_each_keeps_columns_and_wordless_rows(spark):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], "doc_id long, text string, content string, name string")
    left = jaccard.one_of_each(spark, d)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 6, 7, 10, 11]
    assert jaccard.one_of_each(spark, d.limit(0)).count() == 0
