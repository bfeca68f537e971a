"""Connected components over an edge table, by alternating star contractions.

Each round is two minimum aggregations (combined before the shuffle), staged with the
degrees, and two joins in which the edges of a hub are salted by its degree, so a hub
of any degree is never gathered in one task. Rounds are cut by staged tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import join_split, release, stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs to ``(node, root)``, root the smallest node reachable.

    Nodes without an edge are absent. Self-loops and repeated edges are allowed; an
    empty table gives an empty one.
    """
    step = stage(
        spark,
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = _signature(step)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = step.select("u", "v").unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(spark, both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0").select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n"), "low")
        large = join_split(both.where("v > u"), ["u"], low, ["k"], "n", ["v"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stage(spark, large.distinct(), "large")
        least = stage(spark, large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("a", "k"), "least")
        joined = join_split(large, ["a"], least, ["k"], "n", ["b"])
        small = joined.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("b").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after_step = stage(spark, small.where("u <> v").distinct(), "edges")
        release(step, large, low, least)
        step, after = after_step, _signature(after_step)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return step.select(F.col("u").alias("node"), F.col("v").alias("root"))
