"""Connected components of an edge list by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame, functions as F

from docgraph.plans.durable import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _rehang(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Hang the neighbours ``b`` of each ``a`` below the least of them and ``a``.

    The minimum is pre-aggregated map-side and joined back, so that a hub's rows can be split among tasks.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    joined = pairs.join(least, "a")
    if larger_only:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the least node that is reachable.

    Null ends and self loops are ignored; repeated and reversed edges count once; no edges give no rows.
    Nodes may be of any ordered type. Rounds grow with the logarithm of the longest path.
    """
    now = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    now = cut(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        large = _rehang(_both(now), True).filter("a <> b").distinct()
        now = cut(_rehang(large, False).filter("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
