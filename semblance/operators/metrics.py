"""Classification metrics, threshold tuning and splits as aggregations."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(label: str | Column, predicted: str | Column) -> dict[str, Column]:
    y, p = (F.col(c) if isinstance(c, str) else c for c in (label, predicted))
    return {n: F.coalesce(F.count_if((p == a) & (y == b)), F.lit(0)).cast("long") for n, a, b in (("tp", 1, 1), ("fp", 1, 0), ("tn", 0, 0), ("fn", 0, 1))}


def rates(df: DataFrame) -> DataFrame:
    """tp, fp, tn, fn to precision, recall, f1, accuracy; 0 over nothing is 0."""
    div = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0)).cast("double")
    return df.withColumns({"precision": div("tp", "tp + fp"), "recall": div("tp", "tp + fn"), "f1": div("2 * tp", "2 * tp + fp + fn"), "accuracy": div("tp + tn", "tp + fp + tn + fn")})


def classification_metrics(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row; no rows to judge are an error, when it is computed."""
    c = confusion(label, predicted)
    out = df.agg(F.count("*").alias("n"), *(v.alias(k) for k, v in c.items()))
    checked = F.when(F.col("n") > 0, F.col("tp")).otherwise(F.raise_error(F.lit("no pairs to evaluate")).cast("long"))
    return rates(out.withColumn("tp", checked).drop("n"))


def candidate_metrics(df: DataFrame, label: str = "label", candidate: str = "candidate") -> DataFrame:
    """(pairs_evaluated, candidate_pairs, candidate_recall, comparison_reduction)."""
    c, y = F.col(candidate) == 1, F.col(label) == 1
    return df.agg(
        F.count("*").alias("pairs_evaluated"), F.count_if(c).alias("candidate_pairs"),
        F.coalesce(F.try_divide(F.count_if(c & y), F.count_if(y)), F.lit(0.0)).alias("candidate_recall"),
        F.coalesce(1 - F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0)).alias("comparison_reduction"),
    )


def tune_f1_threshold(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, f1, accuracy): best F1, then accuracy, then the highest
    threshold; predicting nothing (threshold 1) competes. Only distinct scores
    meet in one window, after aggregation."""
    each = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    cut = each.select("threshold", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("neg"), F.lit(1).alias("k"))
    none = df.agg(F.lit(1.0).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"), F.lit(0).alias("k"))
    every_cut = rates(cut.union(none).select("threshold", "k", "tp", "fp", (F.col("neg") - F.col("fp")).alias("tn"), (F.col("pos") - F.col("tp")).alias("fn")))
    return every_cut.orderBy(F.desc("f1"), F.desc("accuracy"), F.desc("threshold"), "k").select("threshold", "f1", "accuracy").limit(1)


def split_hash(text: Column, profile: str = "blake2b") -> Column:
    if profile == "md5":
        return F.md5(text)

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: hashlib.blake2b(x.encode(), digest_size=8, person=b"plag-split").hexdigest())

    return of(text)


def stratified_split(pairs: DataFrame, train: float = 0.6, validation: float = 0.2, seed: int = 42, profile: str = "blake2b", key: str = "pair_id", index: str = "index") -> DataFrame:
    """``pairs`` with ``split``: of each label the first floor(n * ratio) rows in hash order."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("train and validation ratios lie between 0 and 1, and so does their sum")
    h = split_hash(F.concat_ws(":", F.lit(seed), F.col("label"), F.col(key), F.col(index)), profile)
    own = Window.partitionBy("label")
    a, b = (F.floor(F.col("_n") * F.lit(r)) for r in (train, validation))
    ranked = pairs.withColumn("_h", h).withColumn("_k", F.row_number().over(own.orderBy("_h", index))).withColumn("_n", F.count("*").over(own))
    return ranked.withColumn("split", F.when(F.col("_k") <= a, "train").when(F.col("_k") <= a + b, "validation").otherwise("test")).drop("_h", "_k", "_n")
