"""Operators without SQL, and their edges, against plain Python."""

import math
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semblance.llm import chat, components, decontaminate, exact, langid, lm, mixing, sharding, toxicity
from semblance.llm import common as C

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# language model


def test_a_score_is_the_product_of_its_softmaxes(spark):
    texts = [("the cat sat on the mat " * 3, 9), ("a dog ran to the cat", 5), ("rare words only here", 1)]
    rows = [(i, t) for i, (t, n) in enumerate(texts) for _ in range(n)]
    model, own = lm.train(spark, frame(spark, rows), lm.Shape(4, 4, 2, 8, 2))
    got = {r.doc_id: r for r in lm.score_encoded(spark, own, model).collect()}
    for i, (t, _) in enumerate(texts):
        words = model.ranks(C.hash_words(t.split())).tolist()
        total = 0.0
        for p, w in enumerate(words):
            past = [np.array([words[p - o] if p >= o else model.start], np.uint64) for o in (1, 2)]
            for table, _, rows_, base, truth in model.choices(past, np.array([w], np.uint32)):
                z = [float(b) + sum(float(model.tables[table][int(r[0]), k]) for r in rows_) for k, b in enumerate(np.atleast_2d(base)[0])]
                total += z[int(truth[0])] - math.log(sum(map(math.exp, z)))
        assert got[i].words == len(words) and got[i].bits == pytest.approx(-total / math.log(2), abs=0.05)


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    m = lm.Model(lm.Shape(4, 4, 2, 8, 2), rng.integers(0, 1 << 63, 40).astype(np.uint64), np.arange(40, 0, -1))
    past, target = [np.array([3], np.uint64), np.array([5], np.uint64)], np.array([7], np.uint32)
    (_, _, rows, base, truth), *_ = m.choices(past, target)
    p = np.exp(base - base.max())
    p /= p.sum()
    grad = -p
    grad[truth[0]] += 1
    m.step(past, target, [np.zeros(1 << m.bits, np.float32) for _ in m.tables])
    want = grad * lm.RATE / np.sqrt((grad**2).sum() / 4 + lm.EPS)
    assert np.allclose(m.tables[0][rows[0][0]], want, atol=1e-5)


def test_words_beyond_the_leaves_share_by_their_counts(spark):
    rows = [(0, " ".join(f"w{k} " * (60 - k) for k in range(50)))]
    shape = lm.Shape(4, 4, 2, 8, 1)
    model, _ = lm.train(spark, frame(spark, rows), shape, leaves=20)
    none = np.full(1, model.start, np.uint64)
    p = sum(math.exp(float(model.log_probability([none, none], model.ranks(C.hash_words([f"w{k}"])))[0])) for k in range(50))
    assert len(model.tree) and model.words == 20 and 0.5 < p < 1.0


# toxicity


def plain(text, lex_words, begins, second, seeds):
    norm = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (text or "").lower()).split()
    hit = [w in lex_words for w in norm]
    beg = [w.encode()[:6] in begins for w in norm]
    some = [a or b for a, b in zip(hit, beg, strict=True)]
    near = [some[i] and any(w in second for w in norm[max(0, i - 5) : i + 6]) for i in range(len(norm))]
    n = max(len(norm), 1)
    chars = text or ""
    up = [unicodedata.category(c) in ("Lu", "Lt") for c in chars]
    let = [unicodedata.category(c)[0] == "L" for c in chars]
    mark = [unicodedata.category(c)[0] in "PS" for c in chars]
    digit = [unicodedata.category(c)[0] == "N" for c in chars]
    letters = max(sum(let), 1)
    return {
        "hits": sum(hit), "distinct": len({w for w, h in zip(norm, hit, strict=True) if h}), "begin": sum(beg), "seeds": sum(w in seeds for w in norm),
        "per_word": sum(some) / n, "near_second": sum(near) / max(sum(some), 1), "second": sum(w in second for w in norm) / n,
        "capitals": sum(up) / letters, "shouting": sum(a and b for a, b in zip(up, up[1:])) / letters, "marks": sum(mark) / max(len(chars), 1),
        "exclaims": sum(c in "!?¡¿" for c in chars) / max(len(chars), 1), "digits": sum(digit) / max(len(chars), 1), "log_words": math.log1p(len(norm)),
        "mixed_words": sum(let[i - 1] and let[i + 1] and (mark[i] or digit[i]) for i in range(1, len(chars) - 1)) / letters,
        "repeat": sum(chars[i] == chars[i - 1] == chars[i - 2] for i in range(2, len(chars))) / max(len(chars), 1),
    }


def test_features_against_plain_python(spark):
    texts = ["You IDIOT, you st*pid l0ser!!!", "ÉCOLE ¡Hola! «sí» Ünïcode ŠKODA", "", None, "the tree and the river", "日本語 テキスト 😀😀😀", "clownish idiotic behaviour of yours  ", "a" * 40]
    lex = toxicity.Lexicon(["loser"], ["clowni", "idioti"])
    words, second = {*toxicity.SEEDS, "loser"}, set(toxicity.SECOND)
    d = toxicity._with_texts(frame(spark, list(enumerate(texts))).withColumn("text", F.coalesce("text", F.lit(""))), ("norm", "opened")).orderBy("doc_id").toArrow().combine_chunks()
    x = toxicity.features(*(d[c].combine_chunks() for c in ("text", "norm", "opened")), lex)
    for i, t in enumerate(texts):
        for name, v in plain(t, words, {b"clowni", b"idioti"}, second, set(toxicity.SEEDS)).items():
            assert x[i, toxicity.NAMES.index(name)] == pytest.approx(v, abs=1e-9), (t, name)


def test_toxicity_on_texts_it_was_not_fitted_on(spark):
    bad, good = "you are a pathetic worthless moron and everyone knows it".split(), "the river runs past a quiet village with old stone houses".split()
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.permutation(bad if i % 3 == 0 else good).tolist() + rng.permutation(good).tolist()[:5])) for i in range(400)]
    labels = frame(spark, [(i, 0, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(i, t, 5, "z") for i, t in rows], "doc_id long, text string, toxic int, norm string")
    got = {r.doc_id: r.toxic for r in toxicity.scored(spark, docs, labels).collect()}
    assert sum(got[i] == (i % 3 == 0) for i in range(200, 400)) >= 196
    left = toxicity.clean(spark, docs, labels)  # the table has columns of the operator's own names
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i in got if not got[i])
    few = labels.where("doc_id < 6")  # too few of a kind: the seed words decide
    assert {r.doc_id for r in toxicity.scored(spark, docs, few).where("toxic = 1").collect()} == {i for i, t in rows if i % 3 == 0}
    assert toxicity.scored(spark, docs.limit(0), labels).count() == 0


def test_toxicity_ignores_texts_labelled_both_ways(spark):
    rows = [(i, "same text here" if i < 50 else f"other text {i}") for i in range(100)]
    labels = frame(spark, [(i, 0, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(spark, frame(spark, rows), labels).where("toxic = 1").count() == 0


# languages


def test_language_of_rows_without_a_given_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    r = langid.identified(spark, hidden).where("doc_id % 3 = 0").join(docs, "doc_id")
    assert r.where("language = lang").count() >= 0.97 * r.where("language is not null").count()
    assert langid.identified(spark, docs.limit(0)).count() == 0
    one = langid.identified(spark, docs.withColumn("lang", F.lit("en"))).select("language", "margin").distinct().collect()
    assert {tuple(x) for x in one} <= {("en", 0.0), (None, None)}


def test_votes_against_plain_python():
    rng = np.random.default_rng(6)
    langs = ["en", "de", "fr", "es", "it"]
    centre = rng.normal(size=(5, 8))
    y = np.repeat(np.arange(5), 30)
    m = langid.Model(langs, langid.FAMILIES)
    order = [m.langs.index(x) for x in langs]
    x = (centre[y] + 0.1 * rng.normal(size=(150, 8))).astype(np.float32)
    m.fit(x, np.array(order)[y])
    got, _ = m.predict(x)
    for i in range(150):
        z = [float(x[i] @ w[:-1] + w[-1]) for w in m.weights]
        family = m.families[int(np.argmax(z[: len(m.families)]))]
        votes = {k: 0.0 for k, f in enumerate(m.family) if f == family}
        for (a, b), v in zip(m.pairs, z[len(m.families) :], strict=True):
            if a in votes:
                votes[a if v > 0 else b] += 1
                votes[a] += 1e-3 * math.tanh(v)
                votes[b] -= 1e-3 * math.tanh(v)
        assert got[i] == max(votes, key=votes.get)
    assert (got == np.array(order)[y]).mean() > 0.95


# shards


def test_shards_are_in_order_and_of_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out, shard = sharding.sharded(spark, docs, shards=8)
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())
    size, span = {}, {}
    for r in rows:
        size[r[shard]] = size.get(r[shard], 0) + len(r.text.encode()) + 1
        span.setdefault(r[shard], []).append(r.doc_id)
        assert r.part == r[shard]
    assert sorted(size) == list(range(8)) and all(x == sorted(x) for x in span.values())
    assert all(span[i][-1] <= span[i + 1][0] for i in range(7))
    mean, largest = sum(size.values()) / 8, max(len(r.text.encode()) for r in rows)
    assert all(abs(x - mean) <= 0.01 * mean + largest for x in size.values())


def test_shards_of_repeated_and_null_ids(spark):
    rows = [(None, "null")] * 3 + [(7, f"text {i}") for i in range(60)] + [(7, "same")] * 5 + [(9, None), (9, "")]
    out, shard = sharding.sharded(spark, frame(spark, rows), shards=4)
    got = out.collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows)) and len({r[shard] for r in got}) == 4
    assert {r[shard] for r in got if r.doc_id is None} == {0} and len({r[shard] for r in got if r.text == "same"}) == 1


# exact copies, mixing, chat, components, decontamination


def test_exact_copies_of_repeated_rows(spark):
    rows = [(3, "x"), (None, "x"), (None, "x"), (1, "x"), (3, "x"), (2, "y"), (2, "y"), (4, ""), (5, ""), (6, None), (7, None), (8, "z")]
    got = sorted(map(str, ((r.doc_id, r.duplicate_of, r.copies) for r in exact.duplicates(spark, frame(spark, rows)).collect())))
    assert got == sorted(map(str, [(None, None, 5), (1, None, 5), (3, None, 5), (3, None, 5), (2, 2, 2), (5, 4, 2)]))


def test_mixing_against_plain_python(spark):
    rows = [(i, "ab" * (i % 5), None if i % 4 == 0 else f"s{i % 3}") for i in range(300)] + [(5, "equal", "s1")] * 4
    docs = frame(spark, rows, "doc_id long, text string, source string")
    import hashlib

    size, own = {}, {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(t)
        own.setdefault(s, []).append(i)
    weight = {s: round(math.sqrt(n) * 1000) for s, n in size.items()}
    want = []
    for s, ids in own.items():
        rate = (weight[s] * mixing.UNIT // sum(weight.values())) * sum(size.values()) // size[s]
        start = int(hashlib.md5(f"{mixing.SEED}:{chr(0) if s is None else s}".encode()).hexdigest()[:8], 16) * mixing.UNIT >> 32
        for k, i in enumerate(sorted(ids, key=lambda i: hashlib.md5(f"{mixing.SEED}/{i}".encode()).hexdigest())):
            want += [(i, s)] * ((start + (k + 1) * rate) // mixing.UNIT - (start + k * rate) // mixing.UNIT)
    got = [(r.doc_id, r.source) for r in mixing.mixed(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(s is None for _, s in got)


def test_small_weights_count_relative_to_each_other(spark):
    docs = frame(spark, [(i, "abcd", "ab"[i % 2]) for i in range(100)], "doc_id long, text string, source string")
    n = {r.source: r["count"] for r in mixing.mixed(docs, {"a": 4e-7, "b": 6e-7}).groupBy("source").count().collect()}
    assert abs(n["a"] - 40) <= 1 and abs(n["b"] - 60) <= 1
    assert mixing.mixed(docs, {}).count() == 0


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, position int"
    rows = [(None, 1, "assistant", "a", 1), (None, 0, "user", "u", 1), (2, 1, "assistant", "b", 1), (2, 1, "assistant", "b", 1), (2, None, "system", "s", 1)]
    got = sorted((str(r.conv_id), r.position, r.context_turns, r.text[r.train_start : r.train_end]) for r in chat.examples(frame(spark, rows, schema)).collect())
    assert got == [("2", 1, 1, "b<|end|>\n"), ("2", 2, 2, "b<|end|>\n"), ("None", 1, 1, "a<|end|>\n")]
    assert chat.examples(frame(spark, [], schema)).count() == 0


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, local):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3), *((100 + i, 101 + i) for i in range(30))]
    got = {r.node: r.component for r in components.components(spark, frame(spark, edges, "u long, v long"), local).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 8, 9), 1), 4: 4, 5: 4, **dict.fromkeys(range(100, 131), 100)}
    assert components.components(spark, frame(spark, [], "u long, v long"), local).count() == 0


def test_decontamination_against_plain_python(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(words, k)) for k in (1, 2, 4, 5, 6, 9, 20, 60, 200)]
    docs = [" ".join(rng.choice(words, 80).tolist() + it.split()[: max(1, int(len(it.split()) * f))] + rng.choice(words, 20).tolist()) for it in items for f in (0.4, 0.55, 1.0)] + ["", None]

    def shingles(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = []
    for i, d in enumerate(docs):
        for j, it in enumerate(items):
            k = min(5, len(it.split()))
            a, b = shingles((d or "").split(), k), shingles(it.split(), k)
            if len(a & b) >= 0.5 * len(b):
                want.append((i, j, len(a & b)))
    d, bench = frame(spark, list(enumerate(docs))), frame(spark, list(enumerate(items)), "item_id long, text string")
    for limit in (1 << 20, 0):
        assert sorted((r.doc_id, r.item_id, r.shared) for r in decontaminate.contaminated(spark, d, bench, broadcast_bytes=limit).collect()) == want
        assert decontaminate.contaminated(spark, d, bench.limit(0), broadcast_bytes=limit).count() == 0
        assert decontaminate.contaminated(spark, d.limit(0), bench, broadcast_bytes=limit).count() == 0
        assert sorted(r.doc_id for r in decontaminate.clean(spark, d, bench, broadcast_bytes=limit).collect()) == sorted(set(range(len(docs))) - {i for i, _, _ in want})
