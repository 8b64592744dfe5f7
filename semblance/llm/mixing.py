"""Mixing sources to target weights by systematic sampling.

A source of weight w is to give w of all characters, so each of its documents
has ``w * total / own`` expected copies. Within the source these are
prefix-summed in an order of hashed ids, one random offset in [0, 1) is added,
and a document is emitted once per integer boundary its interval crosses: floor
or ceiling of what is expected, and the source's total is off by less than one
copy.

The prefix sum is taken in two levels, so that a hot source is no hot task: the
order is by hash, a document's bucket is the leading hex digits of it, sums are
taken by (source, bucket), those few rows are prefix-summed by source, and
within buckets the documents are. All sums are integers (billionths of a copy),
so any order of execution gives the same copies.

Defined results: a null source is a source of its own; an empty or null text
counts as no characters, but is copied at its source's rate; a source without
characters, with a weight below a billionth of all weights, or not named in ``weights`` is not emitted; repeated
rows each take their own place, equal rows being interchangeable; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

UNIT = 10**9
#: Rows of a bucket of a source, at most on average; buckets are leading hex digits of the order.
BUCKET_ROWS = 100_000
#: Weights where none are given: a source's characters to this power, which lifts small sources.
TEMPERATURE = 0.5
SEED = 7


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate, start), a row a source: billionths of a copy that each of
    its documents adds, and its random offset, in the same unit."""
    own = docs.groupBy("source").agg(F.sum(F.length(F.coalesce(F.col("text"), F.lit("")))).alias("size")).where("size > 0")
    if weights is None:
        own = own.withColumn("weight", F.round(F.pow(F.col("size").cast("double"), F.lit(temperature)) * 1000).cast("long"))
    else:
        most = max(weights.values(), default=0) or 1  # relative to the largest, so that small weights keep their digits
        pairs = own.sparkSession.createDataFrame([(k, round(v / most * 1e12)) for k, v in weights.items()], "named string, weight long").where("weight > 0")
        own = own.join(pairs, own.source.eqNullSafe(pairs.named)).drop("named")
    every = Window.partitionBy()  # a row a source
    own = own.withColumn("total", F.sum("size").over(every)).withColumn("weights", F.sum("weight").over(every))
    own = own.withColumn("share", F.expr(f"cast(weight as decimal(28,0)) * {UNIT} div weights"))
    random = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\0")))), 1, 8), 16, 10).cast("long")
    return own.select("source", F.expr("cast(share as decimal(18,0)) * total div size").alias("rate"), F.shiftright(random * UNIT, 32).alias("start"))


def copies(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> tuple[DataFrame, str]:
    """The rows of ``docs`` that are emitted, with all their columns, and the
    name of one more column: how often."""
    source, order, bucket, at, rate, count = (C.fresh(docs, f"mix_{x}") for x in ("source", "order", "bucket", "at", "rate", "copies"))

    def named(c: str):  # a key without nulls, so that join and window share one exchange
        return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))

    placed = docs.withColumn(source, named("source")).withColumn(order, F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = docs.count()
    digits = next(d for d in range(1, 32) if rows <= BUCKET_ROWS * 16**d)
    placed = placed.withColumn(bucket, F.substring(order, 1, digits))
    sizes = placed.groupBy(source, bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = rates(docs, weights, seed, temperature).withColumn(source, named("source")).drop("source")
    offsets = sizes.join(own, source).select(source, bucket, F.expr("start + cast(before as decimal(19,0)) * cast(rate as decimal(18,0))").alias(at), F.col("rate").alias(rate))
    within = Window.partitionBy(source, bucket).orderBy(order, F.xxhash64("text"))
    placed = placed.join(offsets, [source, bucket]).withColumn(order, F.row_number().over(within).cast("decimal(19,0)"))
    to, step = f"(`{at}` + `{order}` * cast(`{rate}` as decimal(18,0)))", f"`{rate}`"
    placed = placed.withColumn(count, F.expr(f"cast({to} div {UNIT} - ({to} - {step}) div {UNIT} as int)"))
    return placed.where(F.col(count) > 0).select(*(f"`{c}`" for c in docs.columns), count), count


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` mixed: every row as often as it is emitted, with its columns."""
    out, count = copies(docs, weights, seed, temperature)
    each = C.fresh(out, "mix_copy")
    return out.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(count)))).select(*(f"`{c}`" for c in docs.columns))


SQL = f"""
WITH d AS (SELECT doc_id, source, md5(concat('{SEED}/', coalesce(doc_id::VARCHAR, ''))) AS o, coalesce('=' || source, 'null') AS named, length(coalesce(text, '')) AS size FROM documents),
s AS (SELECT source, named, sum(size)::HUGEINT AS size, round(pow(sum(size)::DOUBLE, {TEMPERATURE}) * 1000)::HUGEINT AS weight FROM d GROUP BY source, named HAVING sum(size) > 0),
r AS (SELECT named, ((weight * {UNIT} // (SELECT sum(weight) FROM s)::HUGEINT) * (SELECT sum(size) FROM s)::HUGEINT // size)::HUGEINT AS rate,
  ((('0x' || substr(md5(concat('{SEED}:', coalesce(source, chr(0)))), 1, 8))::UBIGINT::HUGEINT * {UNIT}) // 4294967296)::HUGEINT AS start FROM s),
k AS (SELECT doc_id, source, start, rate, row_number() OVER (PARTITION BY source ORDER BY o)::HUGEINT AS n FROM d JOIN r USING (named)),
c AS (SELECT doc_id, source, ((start + n * rate) // {UNIT} - (start + (n - 1) * rate) // {UNIT})::INT AS copies FROM k)
SELECT doc_id, source, unnest(range(1, copies + 1))::INT AS copy FROM c WHERE copies > 0
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, count = copies(C.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col(count))).alias("copy"))
