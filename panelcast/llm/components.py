"""Connected components of a graph given as edges, by repeated large-star and small-star steps (Kiveris and others 2014).

Both steps are group-by-minimum and a join. The minimum of a node with very many edges is summed up where its edges lie;
for the join its edges are dealt over ``SALTS`` tasks, each of which gets the minimum. Each round is written to the shared folder, which bounds the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import new_path


#: Tasks that share the edges of one node.
SALTS = 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the least node around: larger neighbours (large star), or smaller ones and the node itself."""
    if large:
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    dealt = around.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    joined = dealt.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["a", "salt"]).drop("salt")
    if large:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another: ``component`` is the least node it can reach.

    Edges may repeat, in either direction; an edge from a node to itself, or with a null end, says nothing.
    """
    spark = edges.sparkSession
    current = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    current, before = _kept(current, spark)
    while True:
        current, now = _kept(_star(_star(current, True), False).distinct(), spark)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _kept(edges: DataFrame, spark) -> tuple[DataFrame, tuple]:
    """The edges written and read again, and what tells whether a round has changed them."""
    path = new_path(spark, "edges")
    edges.write.parquet(path)
    written = spark.read.parquet(path)
    sums = written.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)))).first()
    return written, tuple(sums)
