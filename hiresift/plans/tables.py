"""The driver's tables as views, registered only when a query names them."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
_NAMED = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


# tables whose rows are costly to process: text, or the rows texts are composed from
TEXT_TABLES = {"documents", "pages", "conversations", "part", "customer", "benchmark"}


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a table has fewer splits than the cluster has slots; a large table already has
    more splits than that and is read as it is."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df

    def sql(self, query: str) -> DataFrame:
        for name in sorted(set(_NAMED.findall(query))):
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(query)
