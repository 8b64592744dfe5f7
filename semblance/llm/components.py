"""Connected components of an edge list by alternating large and small stars.

Each round is two shuffles of the edges; their number is logarithmic in
practice, and no vertex ever gathers more than its own neighbours. Edges are
written to the shared folder between rounds. Up to ``LOCAL`` edges (16 bytes
each) one round on the driver gives the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LOCAL = 500_000


def _local(edges: pa.Table) -> pa.Table:
    """(node, component) by least labels and pointer jumping."""
    u, v = edges["u"].to_numpy(), edges["v"].to_numpy()
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(node))
    while (top[a] != top[b]).any():
        least = np.minimum(top[a], top[b])
        np.minimum.at(top, top[a], least)
        np.minimum.at(top, top[b], least)
        while (top[top] != top).any():
            top = top[top]
    return pa.table({"node": node, "component": node[top]})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each vertex's greater neighbours are tied to the least vertex
    around it. Small: its lesser neighbours and itself are."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # v holds the lesser end
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("least")).withColumn("m", F.least("u", "least")).select("u", "m")
    tied = near.join(least, "u")
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()


def components(spark: SparkSession, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, component) of every vertex of the edges (u, v), both long; a
    component is named by its least vertex. Loops are ignored."""
    state = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).alias("s")
    now = C.written(spark, edges.where("u <> v").select("u", "v").distinct(), "edges")
    if 0 < now.count() <= local:
        return spark.createDataFrame(_local(now.toArrow()))
    before = None
    while True:
        after = tuple(now.agg(state).first()[0])
        if after == before or not after[0]:
            break
        before = after
        now = C.written(spark, _star(_star(now, large=True), large=False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
