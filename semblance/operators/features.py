"""The 15 features of a pair, and their expansion to 39."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaccard
from ..functions.text import SEP
from .tfidf import cosine, gram_counts

QUESTIONS = "are can could did do does how is should what when where which who why will would".split()
NEGATIONS = "cannot cant couldnt didnt doesnt dont don't never no none not shouldnt wont wouldnt".split()
BASE = "word_tfidf_cosine word_bigram_tfidf_cosine char_tfidf_cosine token_jaccard overlap_coefficient length_ratio question_word_same question_word_mismatch negation_mismatch sequence_ratio sorted_token_ratio bigram_jaccard first_token_same common_prefix_ratio exact_match".split()
SQUARED = [i for i in range(14) if i not in (6, 7, 8, 12)]
PRODUCTS = [(i, 4) for i in (0, 2, 3, 9, 10)] + [(i, 5) for i in (0, 2, 3, 9)] + [(0, 2), *((i, 9) for i in (0, 2, 3, 4))]
EXPANDED = BASE + [f"{BASE[i]}^2" for i in SQUARED] + [f"{BASE[i]}*{BASE[j]}" for i, j in PRODUCTS]


def matcher_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio, as of these sides in this order; two empty texts give 1."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return of(a, b)


def _bigrams(t: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, 2), SEP))
    return F.when(F.size(t) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def set_features(a: Column, b: Column, norm_a: Column, norm_b: Column) -> dict[str, Column]:
    """The native features of two token arrays and normalised texts."""
    da, db = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(da, db))
    questions, negations = (F.array(*map(F.lit, w)) for w in (QUESTIONS, NEGATIONS))
    qa, qb = (F.get(F.filter(t, lambda w: F.array_contains(questions, w)), 0) for t in (a, b))
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    ints = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    equal = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: x == y)
    first = F.array_position(equal, False)
    prefix = F.when(first > 0, first - 1).otherwise(least)
    return {
        "token_jaccard": jaccard(da, db),
        "overlap_coefficient": F.coalesce(F.try_divide(both, F.least(F.size(da), F.size(db))), F.lit(0.0)),
        "length_ratio": F.coalesce(F.try_divide(least, most), F.lit(0.0)),
        "question_word_same": ints(qa == qb),
        "question_word_mismatch": ints(qa != qb),
        "negation_mismatch": ints(F.arrays_overlap(a, negations) != F.arrays_overlap(b, negations)),
        "bigram_jaccard": jaccard(_bigrams(a), _bigrams(b)),
        "first_token_same": ints(F.get(a, 0) == F.get(b, 0)),
        "common_prefix_ratio": F.coalesce(F.try_divide(prefix, least), F.lit(0.0)),
        "exact_match": ints((norm_a == norm_b) & (norm_a != "")),
    }


def base_features(pairs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """``pairs`` (with norm and tokens of both sides) and the 15 features, with no join.

    ``train``: the pairs the IDF is fitted on, by default all. Give it stored tables.
    The matcher reads whole texts; its time grows with the product of the lengths, so it
    belongs on pairs of short texts or on candidates.
    """
    a, b = F.col("tokens_a"), F.col("tokens_b")
    out = {}
    for name, words, chars in ((BASE[0], (1,), ()), (BASE[1], (1, 2), ()), (BASE[2], (), (3, 4, 5))):
        model = gram_counts(pairs if train is None else train, words, chars, 1 if train is not None else 2)
        out[name] = cosine(a, b, words, chars, model)
    joined = (F.array_join(F.sort_array(t), " ") for t in (a, b))
    return pairs.withColumns(out | set_features(a, b, F.col("norm_a"), F.col("norm_b")) | {BASE[9]: matcher_ratio(F.col("norm_a"), F.col("norm_b")), BASE[10]: matcher_ratio(*joined)})


def expand(base: list[Column] | None = None) -> Column:
    """array<double> of the 39 features."""
    c = [F.col(x) for x in BASE] if base is None else base
    if len(c) != len(BASE):
        raise ValueError(f"{len(BASE)} base features, not {len(c)}")
    return F.array(*c, *(c[i] * c[i] for i in SQUARED), *(c[i] * c[j] for i, j in PRODUCTS)).cast("array<double>")
