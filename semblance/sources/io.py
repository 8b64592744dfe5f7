"""Text folders, labelled-pair CSV files and single-file sinks."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIVE = "1 duplicate plagiarized positive true yes".split()
NEGATIVE = "0 false negative no non-duplicate original".split()


def _decoded(content: Column, path: Column, encoding: str) -> Column:
    @F.pandas_udf("string")
    def of(raw: pd.Series, at: pd.Series) -> pd.Series:
        def one(b: bytes, p: str) -> str:
            try:
                return bytes(b).decode(encoding)
            except UnicodeDecodeError as x:
                raise ValueError(f"{p} is not {encoding}: {x}") from x

        return pd.Series([one(b, p) for b, p in zip(raw, at, strict=True)])

    return of(content, path)


def read_text_folder(spark: SparkSession, folder: str, pattern: str = "*.txt", encoding: str = "utf-8") -> DataFrame:
    """(document_id, path, text), an id being the file's stem; wrong bytes are an error."""
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    if raw.isEmpty():
        raise ValueError(f"no file {pattern} in {folder}")
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    return raw.select(F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))).alias("document_id"), "path", _decoded(F.col("content"), F.col("path"), encoding).alias("text"))


def read_text_file(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    raw = spark.read.format("binaryFile").load(path)
    stem = os.path.splitext(os.path.basename(path))[0]
    return raw.select(F.lit(stem).alias("document_id"), "path", _decoded(F.col("content"), F.col("path"), encoding).alias("text"))


def parse_label(raw: Column) -> Column:
    """0 or 1; numbers are truncated, anything else is an error."""
    t = F.lower(F.trim(F.coalesce(raw.cast("string"), F.lit(""))))
    number = t.try_cast("double")
    whole = F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 2), number.cast("int"))
    wrong = F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(raw.cast("string"), F.lit("")))).cast("int")
    return F.when(t.isin(*POSITIVE), 1).when(t.isin(*NEGATIVE), 0).when(whole.isin(0, 1), whole).otherwise(wrong)


def read_labeled_pairs(spark: SparkSession, path: str, text_a: str = "text_a", text_b: str = "text_b", label: str = "label", id: str | None = None, limit: int | None = None) -> DataFrame:
    """(pair_id, text_a, text_b, label, index): ids fall back to the row's number from 1."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be above 0")
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="utf-8")
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    if missing := [c for c in (text_a, text_b, label) if c not in raw.columns]:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    # a multi-line CSV file is one split, so this counts rows in file order
    at = F.monotonically_increasing_id()
    name = F.coalesce(F.col(id), (at + 1).cast("string")) if id and id in raw.columns else (at + 1).cast("string")
    out = raw.select(name.alias("pair_id"), F.coalesce(text_a, F.lit("")).alias("text_a"), F.coalesce(text_b, F.lit("")).alias("text_b"), parse_label(F.col(label)).alias("label"), at.alias("index"))
    out = out if limit is None else out.where(F.col("index") < limit)
    if out.isEmpty():
        raise ValueError(f"no pairs in {path}")
    return out


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One file; columns that are missing are empty. For reports of driver size."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    df.toPandas().reindex(columns=columns).to_csv(path, index=False, na_rep="")


def write_json(value: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
