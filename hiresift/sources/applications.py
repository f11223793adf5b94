"""The application log as files: scan, export, schema growth."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift import vocab as V

LOG_SCHEMA = {
    "app_id": "bigint", "applied_date": "date", "company": "string", "role": "string", "resume_version": "string",
    "jd_text": "string", "ats_score": "double", "recruiter_score": "double", "manager_score": "double",
    "days_after_posting": "int", "outcome": "string", "outcome_date": "date", "notes": "string",
    "visibility_score": "double", "components": "string",
}
LISTED = [c for c in LOG_SCHEMA if c != "jd_text"]


def scan_applications(apps: DataFrame, *, limit: int | None = 50) -> DataFrame:
    """Newest first without the posting text; `limit` plans as a distributed top-k."""
    rows = apps.select(*[c for c in LISTED if c in apps.columns]).orderBy(F.desc("applied_date"), F.desc("app_id"))
    return rows if limit is None else rows.limit(limit)


def export_frame(apps: DataFrame) -> DataFrame:
    blank = F.lit("")
    return apps.select(
        F.col("app_id").alias("id"), "applied_date", "company", "role", "resume_version", "ats_score", "recruiter_score",
        "manager_score", "days_after_posting", "outcome", "outcome_date",
        F.col("outcome").isin(*V.POSITIVE_OUTCOMES).cast("int").alias("reached_human"), "notes", "visibility_score",
        F.coalesce("components", blank).alias("components_json"))


def export_applications_csv(apps: DataFrame, folder: str) -> None:
    """CSV parts with a header, range-partitioned by date so the parts read in order."""
    export_frame(apps).repartitionByRange("applied_date", "id").sortWithinPartitions("applied_date", "id").write.mode(
        "overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)


def evolve(old: DataFrame) -> DataFrame:
    """An older log in the current schema: missing columns appear as nulls, applying it twice changes nothing."""
    have = set(old.columns)
    return old.select(*[
        (F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in LOG_SCHEMA.items()])


def union_logs(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return evolve(out)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return evolve(spark.read.option("mergeSchema", True).parquet(folder))
