"""Candidate profiles: loose input to typed columns, and the rules they must meet."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import text as tx

# Accepted spellings of yes and no.
YES = ("true", "yes", "y", "1", "on")
NO = ("false", "no", "n", "0", "off")
TEXT_FIELDS = ("current_title", "education_level", "location", "work_authorization", "salary_currency")
LIST_FIELDS = ("certifications", "acceptable_work_modes", "work_authorized_in")
NUMBER_FIELDS = ("years_experience", "expected_salary_min", "expected_salary_max")


def loose_number(c: Column) -> Column:
    return F.nullif(tx.strip(c), F.lit("")).try_cast("double")


def loose_bool(c: Column) -> Column:
    s = F.lower(tx.strip(c))
    return F.when(s.isin(*YES), True).when(s.isin(*NO), False)


def loose_list(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[\n,;]+", -1), lambda p: tx.strip(p))
    return F.filter(parts, lambda p: p != "")


def coerce_profiles(raw: DataFrame, key: str = "candidate_id") -> DataFrame:
    """All-text profiles to typed ones; unreadable numbers become null, never a guess."""
    columns = {n: loose_number(F.col(n)) for n in NUMBER_FIELDS}
    columns |= {n: tx.strip(F.coalesce(n, F.lit(""))) for n in TEXT_FIELDS}
    columns |= {n: loose_list(F.col(n)) for n in LIST_FIELDS}
    columns["acceptable_work_modes"] = F.transform(columns["acceptable_work_modes"], F.lower)
    columns["open_to_relocation"] = loose_bool(F.col("open_to_relocation"))
    whole = loose_number(F.col("notice_period_days"))
    columns["notice_period_days"] = F.when(whole >= 0, F.floor(whole)).otherwise(F.ceil(whole)).try_cast("int")
    return raw.select(key, *[c.alias(n) for n, c in columns.items()])


def validate_profiles(profiles: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, problem), one row per broken rule; blank fields break none."""
    level, lo, hi = F.lower("education_level"), F.col("expected_salary_min"), F.col("expected_salary_max")
    bad_modes = F.exists("acceptable_work_modes", lambda m: ~m.isin(*V.WORK_MODES))
    negative = F.coalesce(lo < 0, F.lit(False)) | F.coalesce(hi < 0, F.lit(False))
    rules = F.array_compact(F.array(
        F.when((level != "") & ~level.isin(*V.EDUCATION_LEVELS), "education_level is not a known level"),
        F.when(bad_modes, "acceptable_work_modes holds an unknown mode"),
        F.when(~F.col("years_experience").between(0, 60), "years_experience must be between 0 and 60"),
        F.when(~F.col("notice_period_days").between(0, 365), "notice_period_days must be between 0 and 365"),
        F.when(negative, "expected salary can't be negative"), F.when(lo > hi, "expected_salary_min is above expected_salary_max")))
    return ar.unnest(profiles, [key], rules, "problem")
