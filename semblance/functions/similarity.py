"""Similarities of sets, signatures and fingerprints, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions; signatures of unequal length are an error."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    wrong = F.raise_error(F.lit("signatures must have the same length, above 0")).cast("double")
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(wrong)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64


def fingerprint_hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")
