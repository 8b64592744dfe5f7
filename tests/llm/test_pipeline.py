"""Every stage of the pipeline on its own input: toxicity against the operator's
scores and the labels, the others against plain Python."""

import hashlib
import math
import unicodedata

import corpus_pipeline as P
import pytest
from semblance.llm import mixing, tokens, toxicity


def words(text):
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (text or "").lower()).split()


def grams(w, n=5):
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def first_of_each(rows):
    """Positions of the rows that stay: of similar ones the least id."""
    sets, top = [grams(words(r.text)) for r in rows], list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0, rows[i].text or ""))
    by_gram = {}
    for i in order:
        for g in sets[i]:
            by_gram.setdefault(g, []).append(i)

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    place = {i: k for k, i in enumerate(order)}
    for pair in {(a, b) for ids in by_gram.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}:
        a, b = pair
        o = len(sets[a] & sets[b])
        if o >= 0.4 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)), key=place.get)
            top[y] = x
    return [i for i in order if root(i) == i]


def leaks(text, items):
    w = words(text)
    for it in items:
        if v := words(it):
            k = min(5, len(v))
            own = grams(v, k)
            if len(own & ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})) >= 0.5 * len(own):
                return True
    return False


def mixed(rows):
    size, own, out = {}, {}, []
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(r.text or "")
        own.setdefault(r.source, []).append(r.doc_id)
    weight = {s: round(math.sqrt(n) * 1000) for s, n in size.items() if n}
    for s in weight:
        rate = (weight[s] * mixing.UNIT // sum(weight.values())) * sum(size.values()) // size[s]
        start = int(hashlib.md5(f"{mixing.SEED}:{chr(0) if s is None else s}".encode()).hexdigest()[:8], 16) * mixing.UNIT >> 32
        for k, i in enumerate(sorted(own[s], key=lambda i: hashlib.md5(f"{mixing.SEED}/{'' if i is None else i}".encode()).hexdigest())):
            out += [i] * ((start + (k + 1) * rate) // mixing.UNIT - (start + k * rate) // mixing.UNIT)
    return out


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


def run_stages(spark, docs, sf):
    seen = {"": docs.collect()}
    now = docs
    for name, stage in P.STAGES:
        before, now = now, stage(spark, now, sf).persist()
        seen[name] = now.collect()
        if name != "token_binary":
            assert now.columns == before.columns
    return seen


def compare(spark, docs, sf, seen):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    toxic = {r.doc_id for r in toxicity.scored(spark, docs, spark.read.parquet(f"{sf}/labels.parquet")).where("toxic = 1").collect()}
    assert ids(seen["toxicity"]) == ids(r for r in seen[""] if r.doc_id not in toxic)
    rows = seen["toxicity"]
    assert ids(seen["ngram_jaccard"]) == sorted((rows[i].doc_id for i in first_of_each(rows)), key=str)
    assert ids(seen["decontamination"]) == ids(r for r in seen["ngram_jaccard"] if not leaks(r.text, items))
    assert ids(seen["mixing"]) == sorted(mixed(seen["decontamination"]), key=str)
    last = seen["token_binary"]
    known = next((r.dictionary for r in last if r.dictionary), None)
    have = sorted((str(r.doc_id), tokens.text_of(r.frame, known if r.dict_hash else None)) for r in last)
    assert have == sorted((str(r.doc_id), r.text or "") for r in seen["mixing"])


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = run_stages(spark, docs, sf)
    compare(spark, docs, sf, seen)
    labelled = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    there = {r.doc_id for r in seen[""]} & labelled
    assert len(there - {r.doc_id for r in seen["toxicity"]}) >= 0.8 * len(there)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the operators' own names."""
    at = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"long{i}" for i in range(20_000))
    texts = ["", None, "!!!", long, long + " end", "a b c d e f g h", "a b c d e f g i", "holds item one two three four five six seven now", "holds another thing altogether and is clean as such"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, i, 1, "n", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[5], rows[8], (None, "null id here and some more words for it", "en", "s", 1, 1, "n", 2, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int, norm string, copies int, id long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, None, None), (None, 1, 1), (3, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "item one two three four five six seven"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_pipeline_of_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    compare(spark, docs, odd, run_stages(spark, docs, odd))


def test_pipeline_of_an_empty_table(spark, odd):
    seen = run_stages(spark, spark.read.parquet(f"{odd}/documents.parquet").limit(0), odd)
    assert not any(seen.values())
