"""The calibrated ensemble: logistic regression by Newton steps over
distributed sums, and its application as native expressions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TextConfig
from ..sources.store import stored
from . import features as X
from .metrics import classification_metrics, stratified_split, tune_f1_threshold

L2 = 10 / 3


@dataclass
class Classifier:
    l2: float = L2
    threshold: float = 0.5
    means: list[float] = field(default_factory=list)
    scales: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    iterations: int = 0

    def probability(self, x: Column) -> Column:
        """Of array<double> features."""
        if not self.weights:
            raise RuntimeError("the classifier has not been fitted")
        w = np.array(self.weights[1:]) / np.array(self.scales)
        base = self.weights[0] - float(w @ np.array(self.means))
        z = sum((x[i] * F.lit(float(v)) for i, v in enumerate(w)), F.lit(base))
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-35.0)), F.lit(35.0))))

    def save(self, path: str, config: TextConfig = TextConfig()) -> None:
        """The classifier and its preprocessing as JSON, without custom stop words and IDF tables."""
        kept = {k: v for k, v in asdict(config).items() if k not in ("custom_stopwords", "exact_unicode")}
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"version": 1, "model_type": "calibrated_ensemble", "preprocessing": kept, "features": X.EXPANDED, "classifier": asdict(self)}, f, separators=(",", ":"))

    @classmethod
    def load(cls, path: str) -> tuple[Classifier, TextConfig]:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        try:
            if raw["model_type"] != "calibrated_ensemble":
                raise ValueError(f"not an ensemble model: {raw['model_type']!r}")
            return cls(**raw["classifier"]), TextConfig(**raw["preprocessing"])
        except (KeyError, TypeError) as x:
            raise ValueError(f"incomplete model: {x}") from x


def _sums(df: DataFrame, width: int, of) -> np.ndarray:
    """The sum over partitions of a function of (features, labels)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                got = of(x.astype(np.float64), b.column(1).to_numpy().astype(np.float64))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    rows = df.mapInArrow(part, "i long, v double").groupBy("i").agg(F.array_sort(F.collect_list("v")).alias("v")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r.i] = np.sum(r.v)
    return out


def fit(df: DataFrame, x: str = "x", label: str = "label", l2: float = L2, max_iter: int = 25, tolerance: float = 1e-7, balanced: bool = True) -> Classifier:
    """Newton's method: each step is one pass of small sums; give it a stored frame."""
    if l2 < 0:
        raise ValueError("l2 must not be negative")
    df = df.select(x, F.col(label).cast("int").alias("y"))
    head = df.head()
    if head is None:
        raise ValueError("no rows to fit on")
    k = len(head[0])
    first = _sums(df, 2 + k, lambda m, y: np.concatenate([[len(y), y.sum()], m.sum(0)]))
    n, pos = first[:2]
    means = first[2:] / n
    scales = np.sqrt(_sums(df, k, lambda m, y: ((m - means) ** 2).sum(0)) / n)
    scales[scales < 1e-12] = 1
    wp, wn = (n / 2 / pos, n / 2 / (n - pos)) if balanced and 0 < pos < n else (1.0, 1.0)
    w, ridge, it = np.zeros(k + 1), np.diag([0.0] + [l2] * k), 0
    for it in range(1, max_iter + 1):

        def step(m: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            d = np.hstack([np.ones((len(m), 1)), (m - means) / scales])
            p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
            s = np.where(y == 1, wp, wn)
            return np.concatenate([d.T @ (s * (y - p)), ((d.T * (s * p * (1 - p))) @ d).ravel()])

        got = _sums(df, (k + 1) * (k + 2), step)
        g, h = got[: k + 1] - ridge @ w, got[k + 1 :].reshape(k + 1, k + 1) + ridge
        try:
            delta = np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            delta = np.linalg.lstsq(h, g, rcond=None)[0]
        w = w + delta
        if np.abs(delta).max() < tolerance:
            break
    return Classifier(l2, 0.5, means.tolist(), scales.tolist(), w.tolist(), it)


def calibrate(pairs: DataFrame, train: float = 0.6, validation: float = 0.2, seed: int = 42, l2: float = L2, max_iter: int = 25, profile: str = "blake2b", key: str = "pair_id") -> tuple[Classifier, DataFrame, DataFrame]:
    """(classifier, metrics, test predictions) of prepared pairs (norm, tokens
    of both sides, label, index): split, IDF on the training texts, fit,
    threshold on the validation pairs, and two baselines tuned alike."""
    own = stored(pairs, "pairs")
    # of the narrow columns only, as one task sorts all pairs of a label
    split = stratified_split(own.select(key, "label", "index"), train, validation, seed, profile, key)
    own = stored(own.join(split.select(key, "index", "split"), [key, "index"]), "split")
    size = {r["split"]: r["count"] for r in own.groupBy("split").count().collect()}
    if sum(size.values()) < 10 or len(size) < 3:
        raise ValueError("calibration needs 10 pairs at least, and some in every split")
    x = stored(stored(X.base_features(own, own.where("split = 'train'")), "features").withColumn("x", X.expand()), "expanded")
    model = fit(x.where("split = 'train'"), l2=l2, max_iter=max_iter)
    scored = x.withColumn("ensemble_score", model.probability(F.col("x")))
    rows = []
    for method, score in (("Character TF-IDF cosine", X.BASE[2]), ("Token Jaccard", X.BASE[3]), ("Calibrated ensemble", "ensemble_score")):
        cut = tune_f1_threshold(scored.where("split = 'validation'"), score).first().threshold
        if score == "ensemble_score":
            model.threshold = cut
        for name in ("validation", "test"):
            one = classification_metrics(scored.where(F.col("split") == name).withColumn("prediction", (F.col(score) >= cut).cast("int")))
            rows.append(one.select(F.lit(method).alias("method"), F.lit(name).alias("split"), "precision", "recall", "f1", "accuracy", "tp", "fp", "tn", "fn", F.lit(float(cut)).alias("threshold"), *(F.lit(size[s]).alias(f"{s}_pairs") for s in ("train", "validation", "test")), F.lit(len(X.EXPANDED)).alias("feature_count"), F.lit(float(l2)).alias("l2")))
    metrics = rows[0]
    for r in rows[1:]:
        metrics = metrics.union(r)
    hit = (F.col("ensemble_score") >= model.threshold).cast("int")
    test = scored.where("split = 'test'").withColumn("ensemble_prediction", hit).withColumn("error_ensemble", (F.col("ensemble_prediction") != F.col("label")).cast("int"))
    return model, metrics, test
