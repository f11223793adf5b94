"""Application log and conversion statistics.

All statistics are hash aggregates over one scan; bands, layers and buckets are low-cardinality keys, so
partial aggregation leaves a handful of rows per task to shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import stats as st
from hiresift.functions import text as tx
from hiresift.session import materialize

LAYERS = {"visibility": "visibility_score", "ats": "ats_score", "recruiter": "recruiter_score", "manager": "manager_score"}
MIN_RESOLVED = 20
STALE_DAYS = 45
CLOSE_RATIO = 0.75


def reached(outcome: str = "outcome") -> Column:
    return F.col(outcome).isin(*V.POSITIVE_OUTCOMES)


def resolved(apps: DataFrame) -> DataFrame:
    return apps.where(F.col("outcome") != "pending")


# ------------------------------------------------------------------ log

def append_application(scored: DataFrame, path: str, *, applied_date: Column) -> None:
    """Append scored applications with a pending outcome."""
    rows = scored.withColumn("applied_date", applied_date).withColumn("outcome", F.lit("pending")).withColumn(
        "outcome_date", F.lit(None).cast("date"))
    rows.write.mode("append").parquet(path)


def valid_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("outcome").isin(*V.OUTCOMES))


def latest_outcome(events: DataFrame, key: str = "app_id", *, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Last valid outcome per application, and the last note that was not null.  Both are max-style
    aggregates, so a key with a third of all events still reduces to one row per task before the shuffle."""
    order = F.struct(ts, tie)
    return valid_events(events).groupBy(key).agg(
        F.max_by("outcome", order).alias("outcome"), F.max(ts).alias("outcome_ts"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), order)).alias("notes"))


def apply_outcomes(apps: DataFrame, latest: DataFrame, key: str = "app_id") -> DataFrame:
    new = latest.select(key, F.col("outcome").alias("_o"), F.to_date("outcome_ts").alias("_d"), F.col("notes").alias("_n"))
    return apps.join(new, key, "left").withColumn("outcome", F.coalesce("_o", "outcome")).withColumn(
        "outcome_date", F.coalesce("_d", "outcome_date")).withColumn("notes", F.coalesce("_n", "notes")).drop("_o", "_d", "_n")


def last_application(apps: DataFrame, key: str = "app_id") -> DataFrame:
    return apps.agg(F.max(key).alias("last_id"), F.max_by("company", key).alias("company"))


def close_ratio(a: Column, b: Column) -> Column:
    """Similarity 1 - distance / longer length; a Levenshtein ratio stands in for a matching-block ratio."""
    longer = F.greatest(F.length(a), F.length(b))
    return 1 - F.levenshtein(a, b) / longer.cast("double")


def grams(names: DataFrame, name: str, sizes: tuple[int, ...]) -> DataFrame:
    """(name, size, pos, gram): every run of 1, 2, ... letters of each name, with its place."""
    def cut(size: int) -> Column:
        n = F.length(name) - size + 1
        starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("pos"), F.substring(F.col(name), i, F.lit(size)).alias("gram")))

    return ar.unpack(names, [name], F.concat(*[cut(n) for n in sizes]), "gram")


def find_company(needles: DataFrame, names: DataFrame, *, cutoff: float = CLOSE_RATIO, top: int = 5) -> DataFrame:
    """(needle, company, how, ratio): substring hits, else up to five close spellings.

    Names are matched once per distinct name.  Both searches are prefix filters on an index of short grams: a needle
    looks up only its rarest grams, so a gram that many names share is looked up when a needle has no better one.
    """
    q = needles.select(F.lower(tx.strip(F.col("needle"))).alias("needle")).where("needle <> ''").distinct()
    n = names.select(F.lower(tx.strip(F.col("company"))).alias("company")).where("company <> ''").distinct()
    index = materialize(grams(n, "company", (1, 2, 3)).select("company", "size", "pos", "gram", F.length("company").alias("letters")), "grams")
    common = materialize(index.groupBy("gram").agg(F.count("*").alias("times")), "gram-counts")
    hits = materialize(substrings(q, index, common), "company-hits")
    rest = q.join(hits.select("needle").distinct(), "needle", "left_anti")
    close = close_spellings(rest, index, common, cutoff=cutoff)
    order = W.partitionBy("needle").orderBy(F.col("ratio").desc(), "company")
    best = close.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")
    whole = hits.select("needle", "company", F.lit("substring").alias("how"), F.lit(1.0).alias("ratio"))
    return whole.unionByName(best.withColumn("how", F.lit("close")))


def substrings(needles: DataFrame, index: DataFrame, common: DataFrame) -> DataFrame:
    """(needle, company) where the needle stands in the name: met at the needle's rarest gram, then held against the name.

    A needle with a gram that no name has is in none of them.
    """
    longest = F.least(F.lit(3), F.length("needle"))
    own = grams(needles, "needle", (1, 2, 3)).where(F.col("size") == longest)
    counted = own.join(common, "gram", "left").groupBy("needle").agg(
        F.min_by("gram", F.struct(F.col("times"), F.col("gram"))).alias("gram"), F.count_if(F.col("times").isNull()).alias("unknown")).where("unknown = 0")
    return counted.select("needle", "gram").join(index.select("gram", "company").distinct(), "gram").where(F.contains("company", F.col("needle"))).select("needle", "company")


def close_spellings(needles: DataFrame, index: DataFrame, common: DataFrame, *, cutoff: float) -> DataFrame:
    """(needle, company, ratio) with ratio >= cutoff.

    A ratio >= c allows at most (1 - c) * longer edits, and the longer has at most len(needle) / c letters: d edits.
    An edit spoils at most q grams of q letters, so of any q * d + 1 of the needle's grams one stands unspoilt in the
    name, no more than d places off.  The rarest q * d + 1 are looked up: pairs of letters where the needle has that
    many, else single letters, of which there are always d + 1.  Names of other lengths than d allows are left out.
    """
    letters = F.length("needle")
    d = F.floor((1 - cutoff) * letters / F.lit(cutoff) + F.lit(1e-9)).cast("int")
    size = F.when(letters - 1 >= 2 * d + 1, 2).otherwise(1)
    own = grams(needles, "needle", (1, 2)).withColumns({"d": d, "wanted": size}).where("size = wanted")
    rare = W.partitionBy("needle").orderBy(F.coalesce("times", F.lit(0)), "gram", "pos")
    probe = own.join(common, "gram", "left").withColumn("_r", F.row_number().over(rare)).where(F.col("_r") <= F.col("size") * F.col("d") + 1)
    met = probe.select("needle", "gram", "size", "d", F.col("pos").alias("at")).join(index, ["gram", "size"]).where(
        (F.abs(F.col("pos") - F.col("at")) <= F.col("d")) & (F.abs(F.col("letters") - F.length("needle")) <= F.col("d")))
    pairs = met.select("needle", "company").distinct()
    return pairs.withColumn("ratio", close_ratio(F.col("needle"), F.col("company"))).where(F.col("ratio") >= cutoff)


def resolve_targets(matches: DataFrame) -> DataFrame:
    """(needle, app_id, n_matches, ambiguous) from (needle, app_id, outcome): a single pending match wins."""
    pending = F.col("outcome") == "pending"
    return matches.groupBy("needle").agg(
        F.count("*").alias("n_matches"), F.count_if(pending).alias("n_pending"),
        F.min("app_id").alias("_one"), F.min(F.when(pending, F.col("app_id"))).alias("_pending")).select(
        "needle", "n_matches", "n_pending",
        F.when(F.col("n_matches") == 1, F.col("_one")).when(F.col("n_pending") == 1, F.col("_pending")).alias("app_id"),
        ((F.col("n_matches") > 1) & (F.col("n_pending") != 1)).alias("ambiguous"))


def is_stale(as_of: Column, days: int = STALE_DAYS) -> Column:
    return (F.col("outcome") == "pending") & (F.date_diff(as_of, F.col("applied_date")) >= days)


def stale_pending(apps: DataFrame, as_of: Column, days: int = STALE_DAYS) -> DataFrame:
    return apps.agg(F.count_if(is_stale(as_of, days)).alias("stale"))


def reap_ghosts(apps: DataFrame, as_of: Column, days: int = STALE_DAYS) -> DataFrame:
    stale = is_stale(as_of, days)
    return apps.withColumn("outcome_date", F.when(stale, as_of).otherwise(F.col("outcome_date"))).withColumn(
        "outcome", F.when(stale, "ghosted").otherwise(F.col("outcome")))


# ------------------------------------------------------------------ rates

def with_rate(counts: DataFrame) -> DataFrame:
    """Adds conversion_pct, ci_low, ci_high (percent) and a printable rate to n, reached_human."""
    low, high = st.wilson(F.col("reached_human"), F.col("n"))
    return counts.withColumn("conversion_pct", tx.ratio_pct(F.col("reached_human"), F.col("n"))).withColumn(
        "ci_low", F.bround(low * 100, 1)).withColumn("ci_high", F.bround(high * 100, 1)).withColumn(
        "rate", F.when(F.col("n") > 0, st.rate_text(F.col("reached_human"), F.col("n"))))


def counts(by: DataFrame, *keys: str) -> DataFrame:
    return by.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(reached()).alias("reached_human"))


def overall_conversion(apps: DataFrame, *, min_resolved: int = MIN_RESOLVED) -> DataFrame:
    totals = apps.agg(
        F.count("*").alias("total_logged"), F.count_if(F.col("outcome") != "pending").alias("n"),
        F.count_if(reached()).alias("reached_human"))
    rated, enough = with_rate(totals), F.col("n") >= min_resolved
    rates = {c: F.when(enough, F.col(c)) for c in ("conversion_pct", "ci_low", "ci_high", "rate")}
    return rated.withColumns(rates).withColumn("calibrated", enough)


def calibrated(result: DataFrame, apps: DataFrame, min_resolved: int = MIN_RESOLVED) -> DataFrame:
    """`result` once enough outcomes are resolved to mean anything, no rows before: one scalar aggregate of the log."""
    n = apps.agg(F.count_if(F.col("outcome") != "pending").alias("n")).scalar()
    return result.where(n >= min_resolved)


def layer_scores(apps: DataFrame, *keep: str) -> DataFrame:
    return apps.unpivot(list(keep), list(LAYERS.values()), "_column", "score").select(
        *keep, tx.lookup({c: n for n, c in LAYERS.items()}, F.col("_column")).alias("layer"), "score").where("score is not null")


def conversion_by_band(apps: DataFrame, *, min_resolved: int = MIN_RESOLVED) -> DataFrame:
    banded = layer_scores(resolved(apps), "outcome").withColumn("band", tx.log_band(F.col("score")))
    return calibrated(with_rate(counts(banded, "layer", "band")), apps, min_resolved)


def summarize_correlation(grouped) -> DataFrame:
    """Pearson r of `score` with reaching a human, Fisher bounds and a reading, per group."""
    y = F.when(reached(), 1.0).otherwise(0.0)
    rows = grouped.agg(F.count("*").alias("n"), st.correlation(F.col("score"), y).alias("r")).where("r is not null")
    low, high = st.fisher(F.col("r"), F.col("n"))
    rows = rows.withColumn("low", low).withColumn("high", high)
    return (rows.withColumn("correlation", F.bround("r", 3)).withColumn("ci_low", F.bround("low", 3)).withColumn("ci_high", F.bround("high", 3))
            .withColumn("distinguishable", st.distinguishable(F.col("low"), F.col("high")))
            .withColumn("strength", st.strength(F.col("r"), F.col("low"), F.col("high"), F.col("n")))
            .withColumn("reading", st.reading(F.col("r"), F.col("low"), F.col("high"), F.col("n"))).drop("r", "low", "high"))


def score_outcome_correlation(apps: DataFrame, *, min_resolved: int = MIN_RESOLVED) -> DataFrame:
    return calibrated(summarize_correlation(layer_scores(resolved(apps), "outcome").groupBy("layer")), apps, min_resolved)


COMPONENT_SCHEMA = ("visibility struct<searches_matched:double,searches_total:double,parse_safe:boolean>, "
                    "recruiter_checks map<string,string>, manager_dimensions map<string,double>, "
                    "semantic_score double, keyword_score double")


def numeric_components(components: Column) -> Column:
    """array<struct<component, score>> of a stored components document; unreadable documents give none."""
    row = lambda name, value: F.struct(name.alias("component"), value.cast("double").alias("score"))
    parsed = F.from_json(components, COMPONENT_SCHEMA)

    def flatten(c: Column) -> Column:
        vis = c["visibility"]
        credit = lambda s: F.when(s == "pass", 1.0).when(s == "warn", 0.5).when(s == "fail", 0.0)
        entries = lambda m: F.coalesce(F.map_entries(m), F.array())
        fixed = F.array(
            row(F.lit("visibility: searches matched %"), F.when(vis["searches_total"] != 0, 100 * F.coalesce(vis["searches_matched"], F.lit(0.0)) / vis["searches_total"])),
            row(F.lit("visibility: parse gate passed"), vis["parse_safe"].cast("double")),
            row(F.lit("llm fit (semantic)"), c["semantic_score"]), row(F.lit("keyword match"), c["keyword_score"]))
        checks = F.transform(entries(c["recruiter_checks"]), lambda e: row(F.concat(F.lit("recruiter: "), e["key"]), credit(e["value"])))
        dims = F.transform(entries(c["manager_dimensions"]), lambda e: row(F.concat(F.lit("manager: "), e["key"]), e["value"]))
        return F.filter(F.concat(fixed, checks, dims), lambda r: r["score"].isNotNull())

    return ar.let(parsed, flatten)


def flatten_components(apps: DataFrame, *keep: str) -> DataFrame:
    return ar.unpack(apps, list(keep), numeric_components(F.col("components")), "component")


def component_ranking(apps: DataFrame, *, min_resolved: int = MIN_RESOLVED) -> DataFrame:
    """One row per component: evidence first, then size, then name.  Components are a bounded label set, so
    the single-partition rank sorts a handful of rows."""
    summary = summarize_correlation(flatten_components(resolved(apps), "outcome").groupBy("component"))
    order = W.orderBy((~F.col("distinguishable")).cast("int"), -F.abs(F.col("correlation")), "component")
    return calibrated(summary.withColumn("rank", F.row_number().over(order)), apps, min_resolved)


def timing_bucket(days: Column) -> Column:
    return F.when(days <= 2, "0-2 days").when(days <= 7, "3-7 days").when(days <= 14, "8-14 days").when(days.isNotNull(), "15+ days")


def apply_timing(apps: DataFrame, *, min_resolved: int = MIN_RESOLVED) -> DataFrame:
    bucketed = resolved(apps).where("days_after_posting is not null").withColumn("bucket", timing_bucket(F.col("days_after_posting")))
    order = tx.lookup({"0-2 days": 1, "3-7 days": 2, "8-14 days": 3, "15+ days": 4}, F.col("bucket"))
    return calibrated(with_rate(counts(bucketed, "bucket")).withColumn("bucket_no", order), apps, min_resolved)


def components_from_report(report: DataFrame, checks: Column, dimensions: Column | None = None) -> DataFrame:
    """Adds `components`: the JSON stored with an application, from report columns and a check array."""
    visibility = F.when(F.col("visibility_score").isNotNull(), F.struct(
        F.col("searches_matched"), F.col("n_searches").alias("searches_total"), F.col("parse_safe")))
    states = F.map_from_entries(F.transform(checks, lambda c: F.struct(c["name"], c["status"])))
    body = F.struct(
        visibility.alias("visibility"), states.alias("recruiter_checks"),
        (dimensions if dimensions is not None else F.lit(None).cast("map<string,int>")).alias("manager_dimensions"),
        F.col("fit_score").alias("semantic_score"), F.col("keyword_score"), F.lit("rules").alias("jd_source"))
    return report.withColumn("components", F.to_json(body))
