"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

1. Length. Documents are grouped by length in bytes and by the hash of a short
   prefix, on rows of 24 bytes; a group of one is done. The first scan never
   hashes more than the prefix.
2. The surviving (length, prefix) groups go into a bitmap of hashed keys, built
   by aggregation. Its size is fixed by ``bitmap_bits`` at most, whatever the
   number of survivors: a fuller bitmap lets more documents through to step 3
   and never loses one.
3. Only documents that pass the bitmap have their whole content hashed (SHA-256)
   and are grouped by (length, hash). The text itself is never shuffled. Copies
   are counted by document, then by group, and joined back; a hot group is split
   by adaptive execution, and no window or list ever holds it.

Defined results: a row per redundant copy, naming the copy that stays, which is
the one of lowest ``doc_id`` (nulls first). Null texts are not copies of
anything; empty texts are copies of each other; a repeated row is a copy of its
first occurrence, so that ``doc_id`` may equal ``duplicate_of``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PREFIX = 64
#: At most 2^27 bits (16 MB) are sent to the executors; 16 bits for a surviving group until then.
BITMAP_BITS = 27
_WORD = 1 << 15  # bits in one bitmap of Spark's bitmap functions


def _bitmap(groups: DataFrame) -> DataFrame:
    return groups.groupBy(F.expr(f"slot div {_WORD}").alias("word")).agg(F.bitmap_construct_agg(F.col("slot") % _WORD).alias("bitmap"))


def _slot(bits: int):
    return F.xxhash64("len", "prefix").bitwiseAND(F.lit((1 << bits) - 1))


def duplicates(spark: SparkSession, docs: DataFrame, prefix: int = PREFIX, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """(doc_id, duplicate_of, copies): every copy but the one that stays."""
    keyed = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length("text").alias("len"), F.xxhash64(F.substring("text", 1, prefix)).alias("prefix"))
    groups = C.written(spark, keyed.groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("len", "prefix"), "exact-groups")
    bits = min(bitmap_bits, max(15, (16 * groups.count()).bit_length()))
    bitmap = _bitmap(groups.withColumn("slot", _slot(bits)))
    at = F.col("slot") % _WORD
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    passed = keyed.withColumn("slot", _slot(bits)).withColumn("word", F.expr(f"slot div {_WORD}")).join(F.broadcast(bitmap), "word").where(hit)
    full = passed.select("doc_id", "len", F.unhex(F.sha2("text", 256)).alias("hash"))
    # counted by document first, so that no group of copies meets in one task
    each = full.groupBy("len", "hash", "doc_id").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")  # nulls first
    groups = each.groupBy("len", "hash").agg(F.sum("n").cast("int").alias("copies"), F.min(rank).alias("first")).where("copies > 1")
    both = each.join(groups, ["len", "hash"])
    n = F.col("n") - F.when(rank == F.col("first"), 1).otherwise(0)
    run = 1024  # repeated rows of one id are unfolded in two steps
    out = both.select("doc_id", F.col("first.doc_id").alias("duplicate_of"), "copies", n.alias("n")).where("n > 0")
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {run}"))))
    out = out.withColumn("one", F.explode(F.sequence(F.lit(1), F.least(F.lit(run), F.col("n") - F.col("part") * run))))
    return out.select("doc_id", "duplicate_of", "copies")


SQL = """
SELECT doc_id, duplicate_of, copies FROM (
  SELECT doc_id, row_number() OVER w AS rank, first_value(doc_id) OVER w AS duplicate_of, (count(*) OVER (PARTITION BY text))::INT AS copies
  FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS FIRST))
WHERE rank > 1
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark, C.table(spark, sf_dir, "documents"))
