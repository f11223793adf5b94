"""Text folders, labelled corpora, report documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hiresift.functions import arrays as ar
from hiresift.functions import text as tx

SCALAR_FIELDS = ("title", "seniority", "min_years", "min_degree", "degree_mandatory", "sponsorship_unavailable", "salary")
SET_FIELDS = ("certifications", "work_modes", "countries")
TERM_FIELDS = ("required_terms", "other_terms")
LABEL_FIELDS = SCALAR_FIELDS + SET_FIELDS + TERM_FIELDS
# `expected` keeps raw JSON per field, so an absent key (unscored) and a null (none stated) stay apart
CORPUS_SCHEMA = "id string, domain string, jd string, expected map<string,string>"


def scan_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """One row per .txt/.md file, its name as id; unreadable files are skipped."""
    files = (spark.read.option("pathGlobFilter", "*.{txt,md}").option("recursiveFileLookup", True)
             .option("ignoreCorruptFiles", True).text(folder, wholetext=True))
    return files.select(F.col("_metadata.file_name").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def load_labelled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled postings from JSON lines; rows without an id take the file's name."""
    rows = spark.read.schema(CORPUS_SCHEMA).json(folder)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return shape_corpus(rows.select("*", stem.alias("_stem")))


def shape_corpus(rows: DataFrame) -> DataFrame:
    blank = F.lit("")
    return rows.select(
        F.coalesce(F.nullif("id", blank), "_stem").alias("id"), F.coalesce("domain", blank).alias("domain"),
        F.coalesce("jd", blank).alias("jd"), F.coalesce("expected", F.create_map().cast("map<string,string>")).alias("expected"))


def corpus_problems() -> Column:
    keys = F.map_keys("expected")
    unknown = F.transform(F.filter(keys, lambda k: ~k.isin(*LABEL_FIELDS)), lambda k: F.concat(F.lit("unknown expected key "), k))
    salary = F.try_element_at(F.col("expected"), F.lit("salary"))
    triple = F.size(F.from_json(salary, "array<string>"))
    stated = salary.isNotNull() & (salary != "null")
    required = F.from_json(F.try_element_at(F.col("expected"), F.lit("required_terms")), "array<string>")
    others = F.array_compact(F.array(
        F.when(stated & (F.coalesce(triple, F.lit(0)) != 3), "salary must be [min, max, currency] or null"),
        F.when(F.coalesce(F.size(required), F.lit(0)) <= 0, "required_terms must list at least one term")))
    empty = F.array_compact(F.array(F.when(tx.strip(F.col("jd")) == "", "empty jd")))
    return F.concat(empty, unknown, others)


def validate_corpus(corpus: DataFrame) -> DataFrame:
    """(id, problem), one row per schema problem."""
    return ar.unnest(corpus, ["id"], corpus_problems(), "problem")


def report_documents(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("document"))


def write_reports(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").json(folder)
