"""Evidence banks: nested rows in, flat bullets out."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.functions import arrays as ar
from hiresift.functions import dates as dt
from hiresift.functions import text as tx
from hiresift.sources.profiles import YES

UNKNOWN_START = 1900 * 12 + 1


def clean_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(tx.strip(t))), lambda t: t != "")


def _reviewed(flag: Column, default: bool) -> Column:
    return F.when(flag.isNull(), F.lit(default)).otherwise(F.lower(tx.strip(flag.cast("string"))).isin(*YES))


def clean_roles(roles: Column, default_reviewed: bool = True) -> Column:
    """Roles with trimmed fields, cleaned bullets and their place: current first, then newest start."""
    def bullet(b: Column) -> Column:
        return F.struct(tx.strip(F.coalesce(b["text"], F.lit(""))).alias("text"), clean_tags(b["skills"]).alias("skills"),
                        _reviewed(b["reviewed"], default_reviewed).alias("reviewed"))

    def role(r: Column, i: Column) -> Column:
        start = F.coalesce(dt.parse_month(r["start"]), F.lit(UNKNOWN_START))
        return F.struct(
            (~dt.is_open(r["end"])).alias("past"), (-start).alias("newest"), (i + 1).alias("role_no"),
            tx.strip(F.coalesce(r["company"], F.lit(""))).alias("company"), tx.strip(F.coalesce(r["title"], F.lit(""))).alias("title"),
            dt.parse_month(r["start"]).alias("start_month"), dt.parse_month(r["end"]).alias("end_month"),
            F.filter(F.transform(r["bullets"], bullet), lambda b: b["text"] != "").alias("bullets"))

    kept = F.filter(F.transform(roles, role), lambda r: (r["company"] != "") | (F.size(r["bullets"]) > 0))
    return F.array_sort(kept)


def flatten_evidence_bank(banks: DataFrame, *, key: str = "candidate_id", default_reviewed: bool = True) -> DataFrame:
    """One row per bullet; `role_rank` orders roles current first, then newest."""
    ranked = F.transform(clean_roles(F.col("roles"), default_reviewed), lambda r, i: F.struct(
        (i + 1).alias("role_rank"), r["role_no"].alias("role_no"), r["company"].alias("company"), r["title"].alias("title"),
        (~r["past"]).alias("is_current"), r["start_month"].alias("start_month"), r["end_month"].alias("end_month"), r["bullets"].alias("bullets")))
    rows = F.flatten(F.transform(ranked, lambda r: F.transform(r["bullets"], lambda b, i: F.struct(
        r["role_rank"].alias("role_rank"), r["role_no"].alias("role_no"), (i + 1).alias("bullet_no"), r["company"].alias("company"),
        r["title"].alias("title"), r["is_current"].alias("is_current"), r["start_month"].alias("start_month"),
        b["text"].alias("text"), b["skills"].alias("skills"), b["reviewed"].alias("reviewed")))))
    return ar.unpack(banks, [key], rows, "text")


def validate_bank(banks: DataFrame, *, key: str = "candidate_id") -> DataFrame:
    """(key, fatal, problem), one row per problem."""
    def problems(roles: Column) -> Column:
        bullets = F.aggregate(roles, F.lit(0), lambda n, r: n + F.size(r["bullets"]))
        fatal = F.when(F.size(roles) == 0, "no roles").when(bullets == 0, "no bullets")
        missing = lambda c: tx.strip(F.coalesce(c, F.lit(""))) == ""
        warn = F.array_compact(F.array(
            F.when(missing(F.col("contact.email")), "no email"), F.when(missing(F.col("contact.phone")), "no phone"),
            F.when(missing(F.col("headline")), "no headline")))
        bare = F.transform(F.filter(roles, lambda r: ~r["past"] & (F.size(r["bullets"]) == 0)),
                           lambda r: F.concat(F.lit("current role has no bullets: "), r["company"]))
        entry = lambda is_fatal: lambda p: F.struct(F.lit(is_fatal).alias("fatal"), p.alias("problem"))
        return F.when(fatal.isNotNull(), F.array(entry(True)(fatal))).otherwise(F.transform(F.concat(warn, bare), entry(False)))

    return ar.unpack(banks, [key], ar.let(clean_roles(F.col("roles")), problems), "problem")
