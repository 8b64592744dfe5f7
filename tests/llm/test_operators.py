import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semblance.llm import chat, decontaminate, exact, jaccard, langid, lm, mixing, sharding, tokens, toxicity

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
TEXTS = ["one two three four five six seven", "one two three four five six seven", "", None, "!!!", LONG, "one two three four five six eight"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, shard int, copies int, Content string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s" if i else None, 1, "x", 1, 2, "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "null id " * 9, None, None, None, None, None, None, None)], SCHEMA)


def test_exact_dedup(spark, docs):
    got = sorted((r.doc_id, r.duplicate_of, r.copies) for r in exact.duplicates(spark, docs).collect())
    assert got == [(0, 0, 3), (1, 0, 3)]
    assert exact.duplicates(spark, docs.limit(0)).count() == 0


def test_t_occurrence_against_brute_force():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(3, 40)).astype(np.uint64)) for _ in range(60)]
    want = set()
    for i in range(60):
        for j in range(i + 1, 60):
            o = len(np.intersect1d(sets[i], sets[j]))
            if o >= 0.4 * (len(sets[i]) + len(sets[j]) - o) - 1e-9:
                want.add((i, j, o))
    assert set(zip(*(x.tolist() for x in jaccard.t_occurrence(sets, 0.4)))) == want and want


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(7, "kappa alpha beta gamma delta epsilon"), (8, None), (9, ""), (10, "nowhere to be found at all here")], "item_id long, text string")
    for limit in (1 << 20, 0):  # by broadcast, and by shuffle
        assert [(r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated(spark, docs, bench, broadcast_bytes=limit).collect()] == [(5, 7, 1.0)]
        kept = decontaminate.clean(spark, docs, bench, broadcast_bytes=limit)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 1


def test_mixing_is_within_one_copy(spark):
    d = spark.createDataFrame([(i, "abcd", "big" if i < 90 else "small") for i in range(100)], "doc_id long, text string, source string")
    n = {r.source: r["count"] for r in mixing.mixed(d, {"big": 0.5, "small": 0.5}).groupBy("source").count().collect()}
    assert abs(n["big"] - 50) <= 1 and abs(n["small"] - 50) <= 1


def test_mixing_edges(spark, docs):
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["it's 's 're'll don'T", "a  b\n\n c \t", "é«x» 日本 😀!", "'s", " ", "1½²x", "\x1c\x85\xa0", "͸ x"])
def test_ids_are_the_tokenizers_own(text):
    enc = tokens.encoder(tokens.VOCABULARY)
    (_, _, ids, _), = tokens.id_arrays(pa.array([text]), tokens.VOCABULARY)
    assert ids.tolist() == enc.own.encode_ordinary(text)


def test_token_round_trip(spark, docs):
    rows = tokens.binary(spark, docs, shard_bytes=200).collect()
    assert len(rows) == docs.count()
    known = next((r.dictionary for r in rows if r.dictionary), None)
    text = {i: t for i, t in enumerate(TEXTS)}
    assert all(tokens.text_of(r.frame, known) == (text[r.doc_id] or "") for r in rows if r.doc_id is not None)
    assert tokens.binary(spark, docs.limit(0)).count() == 0


def test_lm_scores(spark, docs):
    corpus = spark.createDataFrame([(i, "the cat sat on the mat and the dog sat on the rug " * 5) for i in range(40)], "doc_id long, text string")
    probe = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "mat the on sat cat the"), (3, ""), (4, None)], "doc_id long, text string")
    shape = lm.Shape(8, 8, 16, 10, 2)
    got = {r.doc_id: r for r in lm.scored(spark, probe, corpus, shape).collect()}
    assert got[1].bits < got[2].bits and got[3].words == 0 and got[4].bits is None
    assert lm.scored(spark, docs, shape=shape).count() == docs.count()
    assert lm.scored(spark, docs.limit(0), shape=shape).count() == 0


def test_language(spark, docs):
    said = {"en": "the house and the garden with that", "de": "das haus und der garten mit dem", "fr": "la maison et le jardin avec", "es": "la casa y el jardín con los"}
    d = spark.createDataFrame([(i, said[k] + f" {i}", k) for i, k in enumerate(list(said) * 20)], "doc_id long, text string, lang string")
    r = langid.identified(spark, d).join(d, "doc_id")
    assert r.where("language = lang").count() == 80
    assert langid.identified(spark, docs).count() == docs.count()
    assert langid.identified(spark, docs.withColumn("lang", F.lit(None).cast("string"))).where("language is not null").count() == 0


def test_toxicity(spark, docs):
    rows = [(i, ("you idiot moron stupid loser " if i % 2 else "the tree and the river ") * (2 + i % 5)) for i in range(200)]
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(spark, d, labels).where(F.col("toxic") != F.col("doc_id") % 2).count() == 0
    kept = toxicity.clean(spark, docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_chat(spark):
    c = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a <|x|>"), (1, 2, "assistant", "b"), (1, 3, "assistant", None), (2, 0, None, "z")], "conv_id long, turn long, role string, text string")
    rows = chat.examples(c).orderBy("turn").collect()
    assert [r.text[r.train_start : r.train_end] for r in rows] == ["b<|end|>\n", "<|end|>\n"]


def test_sharding(spark, docs):
    out, shard = sharding.sharded(spark, docs, shards=3)
    assert out.count() == docs.count() and out.columns == [*docs.columns, shard]
    assert sharding.sharded(spark, docs.limit(0))[0].count() == 0
