"""Connected components of an edge table, by alternating large-star and small-star steps
(Kiveris et al. 2014). Every step is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._common import discard, materialize


def _with_least(e: DataFrame) -> DataFrame:
    """``e`` plus m, the least v of each u: aggregated before it is shuffled, then joined, which can split a u with many
    edges over tasks as no window could."""
    return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    pair = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return _with_least(e).select(pair.alias("p")).select("p.u", "p.v").where("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of ``edges`` (u, v) that is not a root itself; root is the
    smallest id of the component. Self-loops and repeated edges are ignored; no edges, no rows."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(spark, e)
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now
        before, e = e, materialize(spark, _small_star(_large_star(e)))
        discard(before)
