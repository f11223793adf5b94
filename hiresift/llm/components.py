"""Connected components of a distributed edge table; nothing but row counts reaches the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    Alternating large-star and small-star rounds: each links a node's neighbours to the smallest of them, so a
    round's edges are no more than the last one's.  Every round is written to the shared folder.
    """
    now = written(edges.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where("low < high").distinct(), "edges")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy("low").agg(F.min("high").alias("m")).select("low", F.least("m", "low").alias("m"))
        large = both.join(least, "low").where("high > low").select(F.col("m").alias("low"), "high").where("low < high").distinct()
        smallest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(smallest, "high").select(F.col("m").alias("low"), F.col("low").alias("other"), "high")
        now = written(small.select("low", "high").unionByName(small.select("low", F.col("other").alias("high"))).where("low < high").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")), F.count_distinct("low")).first()
        if seen == last:
            break
        last = seen
    roots = now.select(F.col("low").alias("node")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
