"""Application log and funnel statistics over `orders`, `lineitem` and `events`."""
from __future__ import annotations

from pyspark.sql import functions as F

from hiresift.functions import arrays as ar
from hiresift.functions import sqlfuncs
from hiresift.functions import stats as st
from hiresift.functions import text as tx
from hiresift.operators import funnel as fn
from hiresift.operators import match as mt
from hiresift.operators import screen as sc
from hiresift.plans import common as c
from hiresift.plans import derived as D
from hiresift.plans.q_text import BAND, alias_case, scratch, TAGS, raw_tags
from hiresift.functions import terms as tm

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn_):
        QUERIES[name] = fn_
        if oracle:
            ORACLES[name] = oracle
        return fn_
    return add


POS = "('recruiter_call', 'interview', 'offer')"
APP = f"""app AS (SELECT a.*, date_diff('day', CAST(o.o_orderdate AS DATE), CAST(s AS DATE)) AS days_after_posting, CASE WHEN outcome IN {POS} THEN 1.0 ELSE 0.0 END AS y FROM ({D.APPLICATION}) a
 JOIN orders o ON o.o_orderkey = a.app_id LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1) l ON l.l_orderkey = a.app_id)"""
AS_OF = f"DATE '{c.AS_OF_DATE}'"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, d = f"({k} / {n}::DOUBLE)", f"(1 + 3.8416 / {n})"
    centre, half = f"(({p} + 3.8416 / (2 * {n})) / {d})", f"(1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / {d})"
    return f"CASE WHEN {n} <= 0 THEN 0.0 ELSE greatest(0.0, {centre} - {half}) END", f"CASE WHEN {n} <= 0 THEN 1.0 ELSE least(1.0, {centre} + {half}) END"


LO, HI = wilson_sql("reached_human", "n")
RATE = f"round_even(reached_human / n::DOUBLE * 100, 1) AS conversion_pct, round_even(({LO}) * 100, 1) AS ci_low, round_even(({HI}) * 100, 1) AS ci_high"


@query("append_application", f"SELECT app_id, company, ats_score, 'pending' AS outcome, '{c.AS_OF_DATE}' AS applied_date FROM ({D.APPLICATION})")
def append_application(t):
    folder = scratch(t, "log")
    fn.append_application(t.sql(D.APPLICATION).select("app_id", "company", "ats_score"), folder, applied_date=F.lit(c.AS_OF_DATE).cast("date"))
    return t.spark.read.parquet(folder).select("app_id", "company", "ats_score", "outcome", F.col("applied_date").cast("string").alias("applied_date"))


KIND = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'recruiter_call' WHEN 'signup' THEN 'interview' WHEN 'purchase' THEN 'offer' WHEN 'error' THEN 'rejected_auto' ELSE event_type END"
EVENT = f"ev AS (SELECT event_id, ts, user_id AS app_id, {KIND} AS outcome, CASE WHEN event_id % 3 = 0 THEN 'n' || CAST(event_id AS VARCHAR) END AS notes FROM events)"
LATEST = f"""WITH {EVENT} SELECT app_id, arg_max(outcome, (ts, event_id)) AS outcome, arg_max(notes, (ts, event_id)) FILTER (notes IS NOT NULL) AS notes FROM ev
 WHERE outcome IN ('pending','ghosted','rejected_auto','rejected_screen','recruiter_call','interview','offer') GROUP BY app_id"""


@query("latest_outcome", LATEST)
def latest_outcome(t):
    return fn.latest_outcome(c.outcome_events(t)).drop("outcome_ts")


@query("last_application", f"SELECT max(app_id) AS last_id, arg_max(company, app_id) AS company FROM ({D.APPLICATION})")
def last_application(t):
    return fn.last_application(t.sql(D.APPLICATION))


NEEDLE = "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name[2:] WHEN 2 THEN replace(p_name, 'e', 'a') ELSE p_name || 'x' END AS needle FROM part"


def needles(t):
    part = t.part.select("p_partkey", "p_name")
    pick = F.col("p_partkey") % 4
    return part.select(F.when(pick == 0, F.col("p_name")).when(pick == 1, F.expr("substring(p_name, 2)")).when(
        pick == 2, F.replace("p_name", F.lit("e"), F.lit("a"))).otherwise(F.concat("p_name", F.lit("x"))).alias("needle")).distinct()


FIND = f"""q AS ({NEEDLE}), nm AS (SELECT DISTINCT p_name AS company FROM part), sub AS (SELECT needle, company FROM q JOIN nm ON contains(company, needle)),
 cl AS (SELECT needle, company, 1 - levenshtein(needle, company) / greatest(length(needle), length(company))::DOUBLE AS ratio FROM q, nm WHERE needle NOT IN (SELECT needle FROM sub)),
 f AS (SELECT needle, company, 'substring' AS how, 1.0 AS ratio FROM sub UNION ALL SELECT needle, company, 'close', ratio FROM (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY ratio DESC, company) AS r FROM cl WHERE ratio >= 0.75) WHERE r <= 5)"""


@query("find_company", f"WITH {FIND} SELECT needle, company, how, ratio FROM f")
def find_company(t):
    return fn.find_company(needles(t), t.part.select(F.col("p_name").alias("company")))


@query("stale_pending", f"SELECT count(*) AS stale FROM ({D.APPLICATION}) WHERE outcome = 'pending' AND date_diff('day', applied_date, {AS_OF}) >= 45")
def stale_pending(t):
    return fn.stale_pending(t.sql(D.APPLICATION), F.lit(c.AS_OF_DATE).cast("date"))


@query("reap_ghosts", f"""SELECT app_id, CASE WHEN s THEN 'ghosted' ELSE outcome END AS outcome, CASE WHEN s THEN '{c.AS_OF_DATE}' END AS outcome_date FROM (
 SELECT app_id, outcome, outcome = 'pending' AND date_diff('day', applied_date, {AS_OF}) >= 45 AS s FROM ({D.APPLICATION}))""")
def reap_ghosts(t):
    reaped = fn.reap_ghosts(t.sql(D.APPLICATION), F.lit(c.AS_OF_DATE).cast("date"))
    return reaped.select("app_id", "outcome", F.col("outcome_date").cast("string").alias("outcome_date"))


@query("overall_conversion", f"""SELECT *, {RATE}, n >= 20 AS calibrated FROM (SELECT count(*) AS total_logged, count(*) FILTER (outcome <> 'pending') AS n, count(*) FILTER (outcome IN {POS}) AS reached_human FROM ({D.APPLICATION}))""")
def overall_conversion(t):
    return fn.overall_conversion(t.sql(D.APPLICATION)).drop("rate")


#: no rate, band or correlation before so many outcomes are resolved
GATE = f"(SELECT count(*) FROM app WHERE outcome <> 'pending') >= {fn.MIN_RESOLVED}"
LAYERS = "ly AS (SELECT app_id, outcome, y, unnest(['visibility', 'ats', 'recruiter', 'manager']) AS layer, unnest([visibility_score, ats_score, recruiter_score, manager_score]) AS score FROM app WHERE outcome <> 'pending')"
LOGBAND = "CASE WHEN score >= 80 THEN '80-100 (Strong)' WHEN score >= 60 THEN '60-79 (Workable)' WHEN score >= 40 THEN '40-59 (Weak)' ELSE '0-39 (Very weak)' END"


@query("conversion_by_band", f"""WITH {APP}, {LAYERS} SELECT *, {RATE} FROM (SELECT layer, {LOGBAND} AS band, count(*) AS n, count(*) FILTER (y = 1) AS reached_human FROM ly WHERE score IS NOT NULL GROUP BY 1, 2) WHERE {GATE}""")
def conversion_by_band(t):
    return fn.conversion_by_band(t.sql(D.APPLICATION)).drop("rate")


@query("wilson_interval", f"""SELECT o_custkey, n, reached_human, round(({LO}), 6) AS low, round(({HI}), 6) AS high FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS reached_human FROM orders GROUP BY 1)""")
def wilson_interval(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("reached_human"))
    low, high = st.wilson(F.col("reached_human"), F.col("n"))
    return n.withColumn("low", F.round(low, 6)).withColumn("high", F.round(high, 6))


FISHER = "CASE WHEN n <= 3 THEN {e} ELSE tanh(atanh(greatest(-0.999999, least(0.999999, r))) {s} 1.96 / sqrt(greatest(n - 3, 1))) END"
FLO, FHI = FISHER.format(e="-1.0", s="-"), FISHER.format(e="1.0", s="+")
CORR = "CASE WHEN count(*) >= 3 AND var_pop(score) > 0 AND var_pop(y) > 0 THEN corr(score, y) END"
STRENGTH = "CASE WHEN NOT d THEN 'not distinguishable from zero' WHEN n < 30 THEN CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END || ' (too few to grade, n<30)' WHEN abs(r) >= 0.5 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END"


def corr_sql(group: str, src: str) -> str:
    return f"""SELECT {group}, n, round(r, 3) AS correlation, round(lo, 3) AS ci_low, round(hi, 3) AS ci_high, d AS distinguishable, {STRENGTH} AS strength FROM (
 SELECT *, lo > 0 OR hi < 0 AS d FROM (SELECT *, {FLO} AS lo, {FHI} AS hi FROM (SELECT {group}, count(*) AS n, {CORR} AS r FROM {src} WHERE score IS NOT NULL GROUP BY 1) WHERE r IS NOT NULL))"""


@query("score_outcome_correlation", f"WITH {APP}, {LAYERS} SELECT layer, n, correlation FROM ({corr_sql('layer', 'ly')}) WHERE {GATE}")
def score_outcome_correlation(t):
    return fn.score_outcome_correlation(t.sql(D.APPLICATION)).select("layer", "n", "correlation")


PER_USER = "pu AS (SELECT user_id, CAST(value AS DOUBLE) AS score, CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN 1.0 ELSE 0.0 END AS y FROM events)"


def per_user(t):
    ev = c.outcome_events(t).join(t.events.select("event_id", F.col("value").alias("score"), "user_id"), "event_id")
    return fn.summarize_correlation(ev.groupBy("user_id"))


@query("fisher_interval", f"WITH {PER_USER} SELECT user_id, n, ci_low, ci_high FROM ({corr_sql('user_id', 'pu')})")
def fisher_interval(t):
    return per_user(t).select("user_id", "n", "ci_low", "ci_high")


@query("correlation_reading", f"WITH {PER_USER} SELECT user_id, distinguishable, strength FROM ({corr_sql('user_id', 'pu')})")
def correlation_reading(t):
    return per_user(t).select("user_id", "distinguishable", "strength")


COMPONENTS = f"""js AS (SELECT app_id, outcome, y, TRY_CAST(CASE WHEN components LIKE '{{%' THEN components END AS JSON) AS j FROM app),
 cp AS (SELECT app_id, outcome, y, 'visibility: searches matched %' AS component, 100.0 * CAST(j->'visibility'->>'searches_matched' AS DOUBLE) / CAST(j->'visibility'->>'searches_total' AS DOUBLE) AS score FROM js
  UNION ALL SELECT app_id, outcome, y, 'visibility: parse gate passed', CASE j->'visibility'->>'parse_safe' WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0 END FROM js
  UNION ALL SELECT app_id, outcome, y, 'recruiter: ' || k, CASE j->'recruiter_checks'->>k WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 WHEN 'fail' THEN 0.0 END FROM js, (SELECT unnest(['Salary', 'Education']) AS k)
  UNION ALL SELECT app_id, outcome, y, 'manager: credibility', CAST(j->'manager_dimensions'->>'credibility' AS DOUBLE) FROM js
  UNION ALL SELECT app_id, outcome, y, 'llm fit (semantic)', CAST(j->>'semantic_score' AS DOUBLE) FROM js UNION ALL SELECT app_id, outcome, y, 'keyword match', CAST(j->>'keyword_score' AS DOUBLE) FROM js)"""


@query("flatten_components", f"WITH {APP}, {COMPONENTS} SELECT app_id, component, round(score, 6) AS score FROM cp WHERE score IS NOT NULL")
def flatten_components(t):
    return fn.flatten_components(t.sql(D.APPLICATION), "app_id").withColumn("score", F.round("score", 6))


@query("component_ranking", f"""WITH {APP}, {COMPONENTS}, rc AS (SELECT * FROM cp WHERE outcome <> 'pending') SELECT component, n, correlation, distinguishable, strength,
 row_number() OVER (ORDER BY CASE WHEN distinguishable THEN 0 ELSE 1 END, -abs(correlation), component) AS rank FROM ({corr_sql('component', 'rc')}) WHERE {GATE}""")
def component_ranking(t):
    return fn.component_ranking(t.sql(D.APPLICATION)).select("component", "n", "correlation", "distinguishable", "strength", "rank")


BUCKET = "CASE WHEN days_after_posting <= 2 THEN '0-2 days' WHEN days_after_posting <= 7 THEN '3-7 days' WHEN days_after_posting <= 14 THEN '8-14 days' ELSE '15+ days' END"


@query("apply_timing", f"""WITH {APP} SELECT *, {RATE} FROM (SELECT {BUCKET} AS bucket, CASE {BUCKET} WHEN '0-2 days' THEN 1 WHEN '3-7 days' THEN 2 WHEN '8-14 days' THEN 3 ELSE 4 END AS bucket_no, count(*) AS n, count(*) FILTER (y = 1) AS reached_human
 FROM app WHERE outcome <> 'pending' AND days_after_posting IS NOT NULL GROUP BY 1, 2) WHERE {GATE}""")
def apply_timing(t):
    return fn.apply_timing(c.applications(t)).drop("rate")


@query("components_from_report", f"""SELECT app_id, CAST(o_custkey % 6 AS INT) AS searches_matched, CAST(recruiter_score AS DOUBLE) AS keyword_score, 'fail' AS salary FROM ({D.APPLICATION}) JOIN orders ON o_orderkey = app_id""")
def components_from_report(t):
    apps = t.sql(D.APPLICATION).join(t.orders.select(F.col("o_orderkey").alias("app_id"), "o_custkey"), "app_id")
    report = apps.select("app_id", "visibility_score", (F.col("o_custkey") % 6).cast("int").alias("searches_matched"), F.lit(6).alias("n_searches"), F.lit(True).alias("parse_safe"),
                         F.lit(None).cast("int").alias("fit_score"), F.col("recruiter_score").alias("keyword_score"))
    checks = F.array(F.struct(F.lit("Salary").alias("name"), F.lit("fail").alias("status")))
    j = lambda path: F.get_json_object("components", path)
    return fn.components_from_report(report, checks).select(
        "app_id", j("$.visibility.searches_matched").cast("int").alias("searches_matched"), j("$.keyword_score").cast("double").alias("keyword_score"), j("$.recruiter_checks.Salary").alias("salary"))


TARGET = """m AS (SELECT needle, p_partkey AS app_id, CASE WHEN p_size % 5 = 0 THEN 'pending' ELSE 'ghosted' END AS outcome FROM f JOIN part ON p_name = company)"""


@query("resolve_outcome_target", f"""WITH {FIND}, {TARGET} SELECT needle, count(*) AS n_matches, count(*) FILTER (outcome = 'pending') AS n_pending,
 CASE WHEN count(*) = 1 THEN min(app_id) WHEN count(*) FILTER (outcome = 'pending') = 1 THEN min(app_id) FILTER (outcome = 'pending') END AS app_id,
 count(*) > 1 AND count(*) FILTER (outcome = 'pending') <> 1 AS ambiguous FROM m GROUP BY needle""")
def resolve_outcome_target(t):
    found = fn.find_company(needles(t), t.part.select(F.col("p_name").alias("company")))
    apps = t.part.select(F.col("p_name").alias("company"), F.col("p_partkey").alias("app_id"), F.when(F.col("p_size") % 5 == 0, "pending").otherwise("ghosted").alias("outcome"))
    return fn.resolve_targets(found.join(apps, "company").select("needle", "app_id", "outcome"))


SLO, SHI = wilson_sql("k", "n")
SPELLED = "CASE candidate_id % 4 WHEN 0 THEN ' K8s ' WHEN 1 THEN 'PowerBI' WHEN 2 THEN 'node js' ELSE 'Excel' END"


@query("sql_functions", f"""SELECT candidate_id, k, n, round(({SLO}), 6) AS low, round(({SHI}), 6) AS high, {BAND.format(s='s')} AS band, {alias_case("lower(trim(" + SPELLED + "))")} AS term FROM (SELECT o_custkey AS candidate_id, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n, CAST(max(o_orderkey % 101) AS DOUBLE) AS s FROM orders GROUP BY 1)""")
def sql_functions(t):
    sqlfuncs.register(t.spark)
    return t.sql(f"""SELECT candidate_id, k, n, round(wilson_low(k, n), 6) AS low, round(wilson_high(k, n), 6) AS high, score_band(s) AS band, canonical_term({SPELLED}) AS term FROM (
        SELECT o_custkey AS candidate_id, count_if(o_orderstatus = 'F') AS k, count(*) AS n, CAST(max(o_orderkey % 101) AS DOUBLE) AS s FROM orders GROUP BY o_custkey)""")
