import pytest
from pyspark.sql import functions as F

from semblance.config import LshConfig, PairConfig, TextConfig
from semblance.functions import hashing as H
from semblance.functions import text as T
from semblance.operators import lsh, metrics
from semblance.plans import pipelines as PL
from semblance.sources import io


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_normalize_matches_the_exact_chain(spark):
    texts = ["The QUICK, brown fox!", None, "", "!!!", "see https://x.y/z or josé@x.com now", "Straße", "اين يك متنِ آزمايشي", "كتـاب می‌روند", "ﬁle ２０ ½", "ΟΔΟΣ", "cafe\u0301", "İstanbul", "한글 ㄱ", "x\x1fy", "😀 a_b", "ｗｗｗ.x.com a", "Ünïcödé WWW.A.b HTTP://q z"]
    for t in texts:
        assert one(spark, t, T.normalize) == T.normalize_text(t)


def test_tokens_and_shingles(spark):
    d = T.prepare(spark.createDataFrame([("The QUICK, brown fox jumps over the lazy dog!",), ("!!!",), ("rare words",)], "text string"))
    a, b, c = d.collect()
    assert a.tokens == ["quick", "brown", "fox", "jumps", "over", "lazy", "dog"]
    assert "quick\x1fbrown\x1ffox" in a.shingles and b.shingles == [] and c.shingles == ["rare\x1fwords"]


def test_adaptive_shingles(spark):
    d = T.prepare(spark.createDataFrame([("how can I learn python quickly",)], "text string"), TextConfig(adaptive_short_text=True))
    assert {"learn", "learn\x1fpython"} <= set(d.first().shingles)


def test_multiply_mod_is_exact():
    import numpy as np

    a = [1, 5, H.PRIME - 1, 123456789012345678]
    for x in a:
        for y in a:
            assert int(H.multiply_mod(np.array([x], np.uint64), np.array([y], np.uint64))[0]) == x * y % H.PRIME


def test_empty_signature_and_adaptive_bands(spark):
    d = lsh.signed(spark.createDataFrame([([],)], "shingles array<string>"), LshConfig(8, 4)).first()
    assert d.signature == [H.PRIME] * 8
    assert lsh.adaptive_params(128, 0.15) == (64, 2)
    for bad in (lambda: LshConfig(10, 3), lambda: LshConfig(8, 0), lambda: TextConfig(2), lambda: PairConfig(simhash_max_distance=65), lambda: lsh.adaptive_params(8, 1.0)):
        with pytest.raises(ValueError):
            bad()


def test_jaccard_join_against_brute_force(spark):
    rows = [(i, f"w{i % 3} a b c d e f g h" + " x" * (i % 4)) for i in range(12)] + [(20, ""), (21, None)]
    d = T.prepare(spark.createDataFrame(rows, "doc_id long, text string")).persist()
    sets = {r.doc_id: set(r.shingles) for r in d.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {(r.document_a, r.document_b) for r in lsh.jaccard_join(d, 0.5).collect()} == want and want


def test_corpus_finds_a_near_copy(spark):
    text = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([("a", text), ("b", text), ("c", "nothing like it at all here")], "document_id string, text string")
    report, summary = PL.corpus(d)
    assert [(r.document_a, r.document_b, r.exact_jaccard, r.simhash_hamming) for r in report.collect()] == [("a", "b", 1.0, 0)]
    assert summary.first().all_possible_pairs == 3


def test_metrics(spark):
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "label int, prediction int")
    m = metrics.classification_metrics(d).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.f1) == (1, 1, 1, 1, 0.5)
    best = metrics.tune_f1_threshold(spark.createDataFrame([(0.9, 1), (0.8, 1), (0.3, 0)], "score double, label int")).first()
    assert (best.threshold, best.f1) == (0.8, 1.0)


def test_labels_and_pairs_file(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text('text_a,text_b,label\n"say ""hi""\nthere",x,Yes\n,y,0\n', encoding="utf-8-sig")
    rows = io.read_labeled_pairs(spark, str(p)).orderBy("index").collect()
    assert [(r.pair_id, r.text_a, r.label) for r in rows] == [("1", 'say "hi"\nthere', 1), ("2", "", 0)]
    with pytest.raises(ValueError):
        io.read_labeled_pairs(spark, str(p), label="none")
    with pytest.raises(NotADirectoryError):
        io.read_text_folder(spark, str(p))
