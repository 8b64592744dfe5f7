"""The composite commands: compare, corpus, pairs, calibrate, variants."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LshConfig, PairConfig, TextConfig
from ..functions.grams import weighted
from ..functions.similarity import fingerprint_hex, hamming, jaccard, signature_similarity
from ..functions.text import hybrid_features, once, prepare, word_ngrams
from ..operators import lsh, tfidf, tiles
from ..operators.metrics import candidate_metrics, classification_metrics
from ..operators.tfidf import fingerprints
from ..sources.store import stored


def simhash_features(config: PairConfig, tokens: str = "tokens") -> Column:
    t = F.col(tokens)
    return hybrid_features(t, config.simhash_ngram_size) if config.simhash_mode == "hybrid" else word_ngrams(t, config.simhash_ngram_size)


def corpus(docs: DataFrame, text: TextConfig = TextConfig(), index: LshConfig = LshConfig(), rule: PairConfig = PairConfig(), id: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(candidate report, summary) of one table of documents (id, text). The prepared
    documents are stored once, and then with their signatures and fingerprints as an index."""
    docs = docs.withColumn(id, F.col(id).cast("string"))
    own = once(prepare(docs, text), {"_features": simhash_features(rule)})
    own = stored(own.select(id, "shingles", weighted(F.col("_features"), index.profile).alias("weighted")), "prepared")
    lsh.check_unique(own, id)
    model = tfidf.weight_counts(own.select("weighted"), own.count())
    found = lsh.index(own.withColumn("fingerprint", tfidf.fingerprint(F.col("weighted"), model)), index, id, ("set", "fingerprint"))
    both = tiles.pairs(found, bands=index.bands, measures=("shared", "equal", "distance"))
    exact, distance = lsh.shared_jaccard(), F.col("distance")
    report = both.select(
        "document_a", "document_b", F.bround(exact, 6).alias("exact_jaccard"),
        F.bround(F.col("equal") / index.num_perm, 6).alias("minhash_similarity"),
        distance.alias("simhash_hamming"), F.bround(1 - distance / 64, 6).alias("simhash_similarity"),
        (exact >= rule.jaccard_threshold).cast("int").alias("passes_jaccard_threshold"),
        # a document of the index has shingles, so it has words
        (distance <= rule.simhash_max_distance).cast("int").alias("passes_simhash_threshold"),
        F.lit(None).cast("double").alias("ensemble_score"), F.lit(None).cast("int").alias("passes_ensemble_threshold"),
    )
    total = own.agg(F.count("*").alias("documents"))
    counts = report.agg(F.count("*").alias("lsh_candidate_pairs"), F.coalesce(F.sum("passes_jaccard_threshold"), F.lit(0)).alias("accepted_by_jaccard"))
    pairs = F.expr("documents * (documents - 1) div 2")
    summary = total.crossJoin(counts).select("documents", pairs.alias("all_possible_pairs"), "lsh_candidate_pairs", F.bround(F.coalesce(1 - F.try_divide("lsh_candidate_pairs", pairs), F.lit(0.0)), 6).alias("reduction_ratio"), "accepted_by_jaccard", F.lit(round(index.approximate_threshold, 6)).alias("lsh_approximate_threshold"))
    return report, summary


def pair_frame(pairs: DataFrame, text: TextConfig = TextConfig()) -> DataFrame:
    """Both sides prepared, suffixed ``_a`` and ``_b``."""
    for s in "ab":
        pairs = prepare(pairs, text, f"text_{s}", f"_{s}")
    return pairs


#: The n-grams of words and of characters that the cosine method weighs.
COSINE = (1, 2), (3, 4, 5)


def score_pairs(pairs: DataFrame, text: TextConfig = TextConfig(), index: LshConfig = LshConfig(), rule: PairConfig = PairConfig(), key: str = "pair_id", methods: tuple[str, ...] = ("lsh", "simhash", "cosine"), ready: bool = False) -> DataFrame:
    """Every pair with the measures, predictions and errors of each of ``methods``
    (cosine only with a threshold). The pairs are prepared once and stored, or are ``ready``
    as :func:`pair_frame` gives them. Scores are made beside the pairs, with no join."""
    own = pairs if ready else pair_frame(pairs, text)
    rest = [c for c in own.columns if not c.startswith(("norm_", "shingles_"))]
    if "lsh" in methods:
        for s in "ab":
            own = lsh.signed(own, index, f"shingles_{s}", f"signature_{s}")
        some = (F.size("shingles_a") > 0) & (F.size("shingles_b") > 0)
        own = own.withColumns({
            "lsh_candidate": (some & lsh.is_candidate(F.col("signature_a"), F.col("signature_b"), index)).cast("int"),
            "jaccard": jaccard(F.col("shingles_a"), F.col("shingles_b")),
            "minhash_similarity": signature_similarity(F.col("signature_a"), F.col("signature_b")),
        })
        own = own.withColumn("lsh_prediction", (F.col("lsh_candidate") * (F.col("jaccard") >= rule.jaccard_threshold).cast("int")))
        rest += ["lsh_candidate", "jaccard", "minhash_similarity", "lsh_prediction"]
    more = [m for m in methods if m == "simhash" or m == "cosine" and rule.cosine_threshold is not None]
    own = own.select(*rest)
    if more:
        own = own.withColumn("_words", (F.size("tokens_a") > 0) & (F.size("tokens_b") > 0))
        if "simhash" in more:
            own = once(own, {f"_features_{s}": simhash_features(rule, f"tokens_{s}") for s in "ab"})
            own = own.withColumns({f"_weighted_{s}": weighted(F.col(f"_features_{s}"), index.profile) for s in "ab"}).drop("_features_a", "_features_b")
        own = stored(own, "pairs")
    if "simhash" in more:
        both = own.select("_weighted_a", "_weighted_b")
        model = tfidf.weight_counts(both, 2 * own.count())
        own = own.withColumns({f"fingerprint_{s}": tfidf.fingerprint(F.col(f"_weighted_{s}"), model) for s in "ab"}).drop(*both.columns)
        own = own.withColumn("simhash_hamming", hamming(F.col("fingerprint_a"), F.col("fingerprint_b")))
        own = own.withColumn("simhash_similarity", 1 - F.col("simhash_hamming") / 64).withColumn("simhash_prediction", (F.col("_words") & (F.col("simhash_hamming") <= rule.simhash_max_distance)).cast("int"))
    if "cosine" in more:
        model = tfidf.gram_counts(own, *COSINE)
        own = own.withColumn("cosine_similarity", tfidf.cosine(F.col("tokens_a"), F.col("tokens_b"), *COSINE, model))
        own = own.withColumn("cosine_prediction", (F.col("_words") & (F.col("cosine_similarity") >= rule.cosine_threshold)).cast("int"))
    done = [m for m in ("lsh", *more) if f"{m}_prediction" in own.columns]
    return own.drop("_words").withColumns({f"error_{m}": (F.col(f"{m}_prediction") != F.col("label")).cast("int") for m in done if "label" in own.columns})


def evaluate_pairs(scored: DataFrame, index: LshConfig = LshConfig(), rule: PairConfig = PairConfig()) -> DataFrame:
    """A row of metrics for each method of :func:`score_pairs`."""
    name = "Hybrid TF-IDF SimHash" if rule.simhash_mode == "hybrid" else "TF-IDF SimHash"
    out = None
    for method, c in (("MinHash+LSH+exact-Jaccard", "lsh"), (name, "simhash"), ("TF-IDF cosine", "cosine")):
        if f"{c}_prediction" not in scored.columns:
            continue
        row = classification_metrics(scored, "label", f"{c}_prediction").crossJoin(candidate_metrics(scored.withColumn("candidate", F.col("lsh_candidate") if c == "lsh" else F.lit(1))))
        own = lambda key, v, kind: F.lit(v if c == key else None).cast(kind)  # noqa: B023, E731
        row = row.select(
            F.lit(method).alias("method"), *(F.bround(x, 6).alias(x) for x in ("precision", "recall", "f1", "accuracy")), "tp", "fp", "tn", "fn", "pairs_evaluated", "candidate_pairs",
            F.when(F.lit(c == "lsh"), F.bround("candidate_recall", 6)).alias("candidate_recall"), F.bround("comparison_reduction", 6).alias("comparison_reduction"),
            own("lsh", rule.jaccard_threshold, "double").alias("jaccard_threshold"), own("simhash", rule.simhash_max_distance, "int").alias("simhash_max_distance"), own("cosine", rule.cosine_threshold, "double").alias("cosine_threshold"),
            own("lsh", index.num_perm, "int").alias("num_perm"), own("lsh", index.bands, "int").alias("bands"),
        )
        out = row if out is None else out.union(row)
    return out


def variants(pairs: DataFrame, text: TextConfig = TextConfig(), index: LshConfig = LshConfig(), rule: PairConfig = PairConfig()) -> DataFrame:
    """(pipeline, precision, recall, f1) of static and adaptive bands, plain and hybrid SimHash."""
    bands, _ = lsh.adaptive_params(index.num_perm, rule.jaccard_threshold)
    plain = replace(rule, simhash_mode="standard", simhash_ngram_size=1, cosine_threshold=None)
    runs = (
        ("Static MinHash+LSH", "lsh", index, plain), ("Adaptive MinHash+LSH", "lsh", replace(index, bands=bands), plain),
        ("Standard SimHash", "simhash", index, plain), ("Hybrid SimHash", "simhash", index, replace(plain, simhash_mode="hybrid")),
    )
    out, own = None, stored(pair_frame(pairs, text).select("pair_id", "label", *(f"{c}_{s}" for c in ("tokens", "shingles") for s in "ab")), "prepared")
    for name, c, i, r in runs:
        m = classification_metrics(score_pairs(own, text, i, r, methods=(c,), ready=True), "label", f"{c}_prediction")
        row = m.select(F.lit(name).alias("pipeline"), *(F.bround(x, 6).alias(x) for x in ("precision", "recall", "f1")))
        out = row if out is None else out.union(row)
    return out


def compare(left: DataFrame, right: DataFrame, background: DataFrame | None = None, text: TextConfig = TextConfig(), index: LshConfig = LshConfig(), rule: PairConfig = PairConfig()) -> dict:
    """The report on two one-row tables (document_id, text); the IDF is fitted on them and ``background``."""
    both = left.select(F.lit("0").alias("id"), "text").union(right.select(F.lit("1").alias("id"), "text"))
    rest = [] if background is None else [background.select(F.concat(F.lit("2"), F.monotonically_increasing_id().cast("string")).alias("id"), "text")]
    docs = prepare(both.union(rest[0]) if rest else both, text).persist()
    prints = fingerprints(docs, simhash_features(rule), "id", profile=index.profile)
    a, b = lsh.signed(docs.where("id in ('0', '1')"), index).join(prints, "id").orderBy("id").collect()
    size = lambda x: len(x)
    sa, sb = set(a.shingles), set(b.shingles)
    exact = len(sa & sb) / len(sa | sb) if sa and sb else 0.0
    rows = index.rows
    candidate = bool(sa and sb) and any(a.signature[i : i + rows] == b.signature[i : i + rows] for i in range(0, index.num_perm, rows))
    distance = ((a.fingerprint ^ b.fingerprint) & (1 << 64) - 1).bit_count()
    return {
        "parameters": {"shingle_size": text.shingle_size, "num_perm": index.num_perm, "bands": index.bands, "jaccard_threshold": rule.jaccard_threshold, "simhash_max_distance": rule.simhash_max_distance, "simhash_ngram_size": rule.simhash_ngram_size, "simhash_mode": rule.simhash_mode, "adaptive_short_text": text.adaptive_short_text},
        "preprocessing": {f"{k}_{s}": v for k, f in (("tokens", lambda r: size(r.tokens)), ("shingles", lambda r: size(r.shingles)), ("language", lambda r: r.language)) for s, v in (("a", f(a)), ("b", f(b)))},
        "minhash_lsh": {"lsh_candidate": candidate, "exact_jaccard": round(exact, 6), "minhash_similarity": round(sum(x == y for x, y in zip(a.signature, b.signature, strict=True)) / index.num_perm, 6), "is_similar": candidate and exact >= rule.jaccard_threshold},
        "simhash": {"fingerprint_a_hex": f"{a.fingerprint & (1 << 64) - 1:016x}", "fingerprint_b_hex": f"{b.fingerprint & (1 << 64) - 1:016x}", "hamming_distance": distance, "similarity": round(1 - distance / 64, 6), "is_similar": bool(a.tokens and b.tokens) and distance <= rule.simhash_max_distance},
    }


__all__ = ["compare", "corpus", "evaluate_pairs", "fingerprint_hex", "pair_frame", "score_pairs", "variants"]
