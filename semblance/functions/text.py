"""Normalisation, tokens and shingles as native expressions.

Every step stays in the JVM but for texts with characters whose NFKC form, full
case folding or combining class Spark doesn't know: these texts, and no others,
are normalised by an Arrow UDF. :func:`normalize` is thus exact for any text.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TextConfig

SEP = "\x1f"
STOP_EN = "a about an and at by for in of or the to with".split()
STOP_FA = "از با برای به تا در را که و یا یک".split()
#: Arabic forms to Persian ones; joiners to blanks; the last, tatweel, goes.
MAP_FROM = "يىئكۀةؤإأٱ‌‍﻿ـ"
MAP_TO = "یییکههواا" + "ا" + "   "
URL = r"(?:www\.|https?://)\S+"
MAIL = r"[+.\w-]+@[.\w-]+[.](?i:[a-z]){2,}\b"


def normalize_native(text: Column) -> Column:
    """The chain in the JVM, exact where :func:`needs_python` is false. The two
    searches of URLs and addresses run on texts only that may hold one."""
    c = F.replace(F.lower(F.translate(F.coalesce(text, F.lit("")), MAP_FROM, MAP_TO)), F.lit("ß"), F.lit("ss"))
    c = _let(c, lambda x: F.when(F.contains(x, F.lit("http")) | F.contains(x, F.lit("www.")), F.regexp_replace(x, "(?iU)" + URL, " ")).otherwise(x))
    c = _let(c, lambda x: F.when(F.contains(x, F.lit("@")), F.regexp_replace(x, r"(?U)\b" + MAIL, " ")).otherwise(x))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{Mn}", ""), r"[^\p{L}\p{N}]+", " "))


@functools.cache
def _native_ranges() -> str:
    """Ranges of characters beyond ASCII, for a Java pattern, on which both chains
    agree in any context: stable under NFKC and never the latter half of a
    composition, folded as lowered, no marks, and known since Unicode 3.2."""
    second = {chr(int(d[1], 16)) for d in (unicodedata.decomposition(chr(c)).split() for c in range(0x110000)) if len(d) == 2 and d[0][0] != "<"}
    old = unicodedata.ucd_3_2_0.category

    def same(c: str) -> bool:
        kind = unicodedata.category(c)
        fixed = kind[0] in "LSZ" or kind in ("Nd", "Cf", "Cc") or kind[0] == "P" and kind != "Pc"
        blank = c.isspace() == (kind[0] == "Z" or c == "\x85")
        return fixed and blank and old(c) == kind and c not in second and c != "Σ" and not "ᄀ" <= c <= "ᇿ" and unicodedata.normalize("NFKC", c) == c and (c.casefold() == c.lower() or c == "ß")

    ranges: list[list[int]] = []
    for c in range(0x80, 0x10000):
        if same(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges if b - a >= 7 or b < 0x700)


def needs_python(text: Column) -> Column:
    """Whether a text holds a character that the native chain may treat otherwise."""
    odd = F.regexp_replace(text, r"[\x00-\x1b\x20-\x7e]+", "")
    return F.when(text.rlike(r"[^\x00-\x1b\x20-\x7e]"), odd.rlike(f"[^{_native_ranges()}]")).otherwise(False)


def normalize(text: Column) -> Column:
    return F.coalesce(exact_part(text), normalize_native(text))


def normalize_text(text: str | None) -> str:
    """The exact chain, on one string."""
    s = unicodedata.normalize("NFKC", text or "").translate(dict(zip(map(ord, MAP_FROM), [*MAP_TO, ""], strict=True))).casefold()
    s = re.sub(r"\b" + MAIL, " ", re.sub("(?i)" + URL, " ", s))
    kept = (c if unicodedata.category(c)[0] in "LN" else " " for c in s if not unicodedata.combining(c))
    return " ".join("".join(kept).split())


def exact_part(text: Column) -> Column:
    """The normalised text where Python is needed, else null (and nothing is sent)."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(normalize_text, na_action="ignore")

    return of(F.when(needs_python(text), text))


def detect_language(norm: Column) -> Column:
    persian, latin = (F.regexp_count(norm, F.lit(p)) for p in (r"[؀-ۿ]", "[A-Za-z]"))
    return F.when(norm.rlike(r"[؀-ۿ]") & (persian > latin), "fa").otherwise("en")


def split_words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def _strings(words) -> Column:
    return F.array(*(F.lit(w) for w in words)).cast("array<string>")


def _let(c: Column, of) -> Column:
    """``of(c)`` with c evaluated once, however often ``of`` and its lambdas
    use it: the optimizer would put c's expression in every place instead."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def tokens(norm: Column, lang: Column, config: TextConfig = TextConfig()) -> Column:
    own = [normalize_text(w) for w in config.custom_stopwords]

    def without(words: Column, stop: list[str]) -> Column:
        listed = _strings(sorted({*stop, *own} - {""}))
        return F.filter(words, lambda t: ~F.array_contains(listed, t))

    def of(words: Column) -> Column:
        kept = F.when(lang == "fa", without(words, STOP_FA)).otherwise(without(words, STOP_EN))
        return F.when(F.size(words) <= config.short_text_token_limit, words).otherwise(kept) if config.adaptive_short_text else kept

    return _let(split_words(norm), of) if config.remove_stopwords else split_words(norm)


def _runs(toks: Column, n: int, sep: str = SEP) -> Column:
    """Runs of n tokens, with repeats; none where there are fewer. ``toks`` is a bound variable."""
    runs = F.transform(F.slice(toks, 1, F.greatest(F.size(toks) - n + 1, F.lit(0))), lambda t, i: F.concat_ws(sep, t, *(F.get(toks, i + k) for k in range(1, n))))
    return F.when(F.size(toks) >= n, runs).otherwise(_strings([]))


def _ngrams(toks: Column, n: int) -> Column:
    whole = F.array(F.array_join(toks, SEP))
    return F.when(F.size(toks) == 0, _strings([])).when(F.size(toks) < n, whole).otherwise(_runs(toks, n))


def word_ngrams(toks: Column, n: int = 1) -> Column:
    """With repeats; fewer than n tokens make one gram of them all."""
    if n < 1:
        raise ValueError("n-grams have at least one word")
    if n == 1:
        return toks
    return _let(toks, lambda t: _ngrams(t, n))


def shingles(toks: Column, k: int = 3, policy: str = "single") -> Column:
    whole = policy == "single"
    return _let(toks, lambda t: F.array_distinct(_ngrams(t, k) if whole else _runs(t, k)))


def shingles_adaptive(toks: Column, k: int = 3) -> Column:
    def of(t: Column) -> Column:
        n = F.size(t)
        few, some = F.array_union(_ngrams(t, 1), _ngrams(t, 2)), F.array_union(_ngrams(t, 2), _ngrams(t, 3))
        return F.when(n == 0, _strings([])).when(n <= 6, few).when(n <= 12, some).otherwise(F.array_distinct(_ngrams(t, k)))

    return _let(toks, of)


def char_trigrams(toks: Column) -> Column:
    """``char:`` grams of three letters within each token."""

    def of(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.concat(F.lit("char:"), F.substring(t, i, F.lit(3))))
        return F.when(F.length(t) < 3, F.array(F.concat(F.lit("char:"), t))).otherwise(grams)

    return F.flatten(F.transform(toks, of))


def hybrid_features(toks: Column, n: int = 1, chars: bool = True) -> Column:
    return F.concat(word_ngrams(toks, n), char_trigrams(toks)) if chars else word_ngrams(toks, n)


def _prefixed(grams: Column, prefix: str) -> Column:
    return F.transform(grams, lambda g: F.concat(F.lit(prefix), g))


def _chars(joined: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(joined) - n + 1, F.lit(1)))
    return F.when(F.length(joined) >= n, F.transform(at, lambda i: F.substring(joined, i, F.lit(n)))).otherwise(_strings([]))


def cosine_features(toks: Column, words: tuple[int, ...] = (1, 2), chars: tuple[int, ...] = (3, 4, 5)) -> Column:
    """``word-n:`` and ``char-n:`` grams, the latter across words."""
    if not words and not chars or any(n < 1 for n in (*words, *chars)):
        raise ValueError("at least one kind of feature, of sizes above 0")

    # the functions of transform may take one argument only: a second would be the index
    def of_words(n: int) -> Column:
        return _let(toks, lambda t: _prefixed(_runs(t, n), f"word-{n}:"))

    def of_chars(n: int) -> Column:
        return _let(F.array_join(toks, " "), lambda j: _prefixed(_chars(j, n), f"char-{n}:"))

    return F.concat(*map(of_words, words), *map(of_chars, chars))


def lemmatize_fa(toks: Column) -> Column:
    """Without the verb prefix as a token, plural endings or joiners at the ends."""
    edge = "[‌‍﻿]+"
    cut = F.transform(F.filter(toks, lambda t: t != "می"), lambda t: F.when(F.length(t) > 2, F.regexp_replace(t, "(?:ها|ان|ات)$", "")).otherwise(t))
    return F.filter(F.transform(cut, lambda t: F.regexp_replace(t, f"^{edge}|{edge}$", "")), lambda t: t != "")


def prepare(df: DataFrame, config: TextConfig = TextConfig(), text: str = "text", suffix: str = "") -> DataFrame:
    """``df`` with ``norm``, ``language``, ``tokens`` and ``shingles`` (each with the suffix)."""
    norm, lang, toks, sh = (f"{c}{suffix}" for c in ("norm", "language", "tokens", "shingles"))
    if config.exact_unicode:  # a stage of its own, as a generator takes no Python
        df = once(df.withColumn("_exact", exact_part(F.col(text))), {norm: F.coalesce("_exact", normalize_native(F.col(text)))}).drop("_exact")
    else:
        df = once(df, {norm: normalize_native(F.col(text))})
    df = df.withColumn(lang, detect_language(F.col(norm)) if config.language == "auto" else F.lit(config.language))
    df = once(df, {toks: tokens(F.col(norm), F.col(lang), config)})
    made = shingles_adaptive(F.col(toks), config.shingle_size) if config.adaptive_short_text else shingles(F.col(toks), config.shingle_size, config.short_text_policy)
    return df.withColumn(sh, made)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns that later stages read instead of evaluating them anew: the
    optimizer doesn't merge projections across a generator."""
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*rest, one).select(*rest, *(F.col("_once")[n].alias(n) for n in columns))
