"""Profile checks and timelines."""
from __future__ import annotations

from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import dates as dt
from hiresift.functions import text as tx
from hiresift.operators import screen as sc
from hiresift.plans import common as c
from hiresift.plans import derived as D
from hiresift.plans.q_extract import OFFERS, WIDE_SQL
from hiresift.plans.q_text import EXACT_COUNTRY, PROFILE_TYPED, RESUME_LINES, country_sql
from hiresift.session import materialize

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def rank_sql(col: str, table: dict, default: int) -> str:
    return f"CASE lower({col}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


PAIRED = f"""{WIDE_SQL}, pf AS ({PROFILE_TYPED}), pr AS (SELECT pa.candidate_id, req.*, pf.* EXCLUDE (candidate_id, salary_currency, certifications), pf.salary_currency AS pcur, pf.certifications AS pcerts
 FROM ({D.PAIR}) pa JOIN req ON req.jd_id = pa.jd_id JOIN pf ON pf.candidate_id = pa.candidate_id)"""
IDS = "candidate_id, jd_id"


def rows(t):
    return sc.profile_rows(c.pairs(t), c.profiles(t), c.requirements(t))


def one(df, check):
    return df.select("candidate_id", "jd_id", check.alias("k")).select("candidate_id", "jd_id", "k.name", "k.status", "k.importance", "k.citation")


def many(df, checks, keep=("name", "status", "importance", "citation")):
    return ar.unpack(df, ["candidate_id", "jd_id"], checks, "name").select("candidate_id", "jd_id", *keep)


YEARS = "min_years IS NOT NULL AND years_experience IS NOT NULL"


@query("check_years", f"""WITH {PAIRED} SELECT {IDS}, 'Years of experience' AS name, CASE WHEN NOT ({YEARS}) THEN 'skipped' WHEN min_years - years_experience <= 0 THEN 'pass' WHEN min_years - years_experience <= 2 THEN 'warn' ELSE 'fail' END AS status,
 CASE WHEN {YEARS} THEN 3.0 ELSE 1.0 END AS importance, CASE WHEN {YEARS} THEN years_line ELSE '' END AS citation FROM pr""")
def check_years(t):
    return many(rows(t), F.slice(sc.years_checks(), 1, 1))


@query("check_overqualified", f"WITH {PAIRED} SELECT {IDS}, 'Overqualification' AS name, 'warn' AS status, 1.0 AS importance, years_line AS citation FROM pr WHERE years_experience > min_years + 6")
def check_overqualified(t):
    return many(rows(t), F.slice(sc.years_checks(), 2, 1))


NEED, HAVE = rank_sql("min_degree", V.EDUCATION_RANK, 0), rank_sql("education_level", V.EDUCATION_RANK, 0)
DEG = "min_degree IS NOT NULL AND education_level <> ''"


@query("check_degree", f"""WITH {PAIRED}, d AS (SELECT *, {NEED} AS need, {HAVE} AS have, {DEG} AS known FROM pr) SELECT {IDS}, 'Education' AS name,
 CASE WHEN NOT known THEN 'skipped' WHEN have >= need THEN 'pass' WHEN NOT degree_mandatory THEN 'warn' ELSE 'fail' END AS status,
 CASE WHEN NOT known THEN 1.0 WHEN have < need AND NOT degree_mandatory THEN 2.0 ELSE 3.0 END AS importance, CASE WHEN known THEN degree_line ELSE '' END AS citation FROM d""")
def check_degree(t):
    return one(rows(t), sc.degree_check())


@query("check_certifications", f"""WITH {PAIRED}, rt AS (SELECT candidate_id AS cid, lower(text) AS text FROM ({D.RESUME})),
 k AS (SELECT pr.candidate_id, pr.jd_id, cert.cert, cert.line, cert.mandatory, contains(lower(array_to_string(pcerts, ' ')) || ' ' || rt.text, lower(cert.cert)) AS has FROM pr JOIN cert ON cert.jd_id = pr.jd_id JOIN rt ON rt.cid = pr.candidate_id)
 SELECT {IDS}, 'Certification: ' || cert AS name, CASE WHEN has THEN 'pass' WHEN mandatory THEN 'fail' ELSE 'warn' END AS status, CASE WHEN has OR mandatory THEN 2.0 ELSE 1.0 END AS importance, line AS citation FROM k
 UNION ALL SELECT {IDS}, 'Certifications', 'skipped', 1.0, '' FROM pr WHERE certs IS NULL""")
def check_certifications(t):
    pairs, asked = materialize(c.pairs(t), "pairs"), c.requirements(t, "certs")
    held = sc.held_certificates(pairs, asked, c.profiles(t), c.resumes(t))
    return many(pairs.join(asked, "jd_id").join(held, "candidate_id").join(c.profiles(t).select("candidate_id"), "candidate_id"), sc.certification_checks())


MODES = "modes IS NOT NULL AND len(acceptable_work_modes) > 0"


@query("check_work_mode", f"""WITH {PAIRED} SELECT {IDS}, CASE WHEN NOT ({MODES}) THEN 'skipped' WHEN list_has_any(modes, acceptable_work_modes) THEN 'pass' ELSE 'fail' END AS status, CASE WHEN {MODES} THEN 3.0 ELSE 1.0 END AS importance FROM pr""")
def check_work_mode(t):
    return one(rows(t), sc.work_mode_check()).select("candidate_id", "jd_id", "status", "importance")


SAL = "((salary_min IS NOT NULL OR salary_max IS NOT NULL) AND (expected_salary_min IS NOT NULL OR expected_salary_max IS NOT NULL))"
MIS = "(coalesce(salary_currency, '') <> '' AND pcur <> '' AND salary_currency <> upper(pcur))"


@query("check_salary", f"""WITH {PAIRED}, s AS (SELECT *, {SAL} AS known, {MIS} AS mis, coalesce(expected_salary_min > salary_max, false) AS above, coalesce(expected_salary_max < salary_min, false) AS below, coalesce(expected_salary_min > salary_min, false) AS upper_half FROM pr)
 SELECT {IDS}, CASE WHEN NOT known OR mis THEN 'skipped' WHEN above THEN 'fail' WHEN below OR upper_half THEN 'warn' ELSE 'pass' END AS status,
 CASE WHEN NOT known OR mis THEN 1.0 WHEN above THEN 3.0 WHEN below THEN 2.0 ELSE 1.0 END AS importance, CASE WHEN known THEN salary_line ELSE '' END AS citation FROM s""")
def check_salary(t):
    asked = c.requirements(t, "salary_min", "salary_max", "salary_currency", "salary_line")
    people = c.profiles(t).select("candidate_id", "expected_salary_min", "expected_salary_max", F.col("salary_currency").alias("profile_currency"))
    return one(c.pairs(t).join(asked, "jd_id").join(people, "candidate_id"), sc.salary_check()).drop("name")


AUTH = f"list_transform(work_authorized_in, lambda x: coalesce({EXACT_COUNTRY.format(s='lower(x)')}, {country_sql('x')}[1], lower(x)))"
CWORDS = "[" + ", ".join(f"'{w}'" for w in sc.COUNTRY_WORDS) + "]"
PLACE = f"""{PAIRED}, pl0 AS (SELECT *, {AUTH} AS auth, list_transform(regexp_extract_all(location, '[A-Za-z]{{4,}}'), lambda w: lower(w)) AS pw, list_transform(regexp_extract_all(jd_location, '[A-Za-z]{{4,}}'), lambda w: lower(w)) AS jw FROM pr),
 pl AS (SELECT *, len(list_filter(list_intersect(pw, jw), lambda w: NOT list_contains({CWORDS}, w))) > 0 OR list_has_any(list_concat({country_sql('location')}, auth), countries) AS same,
  (jd_location <> '' OR len(countries) > 0) AND (location <> '' OR len(work_authorized_in) > 0) AS known FROM pl0),
 pd AS (SELECT *, known AND (same OR open_to_relocation IS NOT NULL) AS decided, coalesce(list_contains(modes, 'onsite'), false) AS onsite, coalesce(list_contains(modes, 'remote'), false) AS remote FROM pl)"""


@query("check_location", f"""WITH {PLACE} SELECT {IDS}, CASE WHEN NOT decided THEN 'skipped' WHEN same THEN 'pass' WHEN open_to_relocation THEN 'warn' WHEN onsite THEN 'fail' ELSE 'warn' END AS status,
 CASE WHEN NOT decided OR same OR open_to_relocation THEN 1.0 WHEN onsite THEN 3.0 WHEN remote THEN 1.0 ELSE 2.0 END AS importance FROM pd""")
def check_location(t):
    return one(rows(t), sc.location_check()).select("candidate_id", "jd_id", "status", "importance")


@query("check_work_authorisation", f"""WITH {PLACE}, b AS (SELECT *, list_has_any(countries, auth) AS ov, CASE WHEN len(countries) > 0 AND len(work_authorized_in) > 0 AND NOT list_has_any(countries, auth) THEN 'fail' WHEN list_has_any(countries, auth) THEN 'pass'
  WHEN contains(lower(work_authorization), 'sponsor') THEN 'fail' ELSE 'warn' END AS blocked FROM pl0)
 SELECT {IDS}, CASE WHEN no_sponsor_line IS NOT NULL THEN blocked WHEN work_auth_line IS NOT NULL THEN 'warn' ELSE 'skipped' END AS status,
 CASE WHEN no_sponsor_line IS NOT NULL THEN CASE WHEN blocked = 'warn' THEN 2.0 ELSE 3.0 END ELSE 1.0 END AS importance, coalesce(no_sponsor_line, work_auth_line, '') AS citation FROM b""")
def check_work_authorisation(t):
    return one(rows(t), sc.authorisation_check()).drop("name")


@query("check_notice_period", f"""WITH pf AS ({PROFILE_TYPED}) SELECT pa.candidate_id, jd_id, CASE WHEN notice_period_days IS NULL THEN 'skipped' WHEN notice_period_days > 60 THEN 'warn' ELSE 'pass' END AS status,
 CASE WHEN notice_period_days > 90 THEN 2.0 ELSE 1.0 END AS importance FROM ({D.PAIR}) pa JOIN pf ON pf.candidate_id = pa.candidate_id""")
def check_notice_period(t):
    return one(c.pairs(t).join(c.profiles(t), "candidate_id"), sc.notice_check()).select("candidate_id", "jd_id", "status", "importance")


@query("check_title_level", f"""WITH {PAIRED}, d AS (SELECT *, seniority <> '' AND current_title <> '' AS known, {rank_sql('seniority', V.SENIORITY_RANK, 3)} - CASE WHEN current_title LIKE 'Senior%' THEN 4 WHEN current_title LIKE 'Junior%' THEN 1 ELSE 3 END AS delta FROM pr)
 SELECT {IDS}, CASE WHEN NOT known THEN 'skipped' WHEN delta <= 0 THEN 'pass' ELSE 'warn' END AS status, CASE WHEN known AND delta <> 1 THEN 2.0 ELSE 1.0 END AS importance FROM d""")
def check_title_level(t):
    return one(rows(t), sc.title_level_check()).select("candidate_id", "jd_id", "status", "importance")


# ---------------------------------------------------------------- timelines

RNG, EDU = dt.RANGE.replace("'", "''"), dt.EDUCATION_LINE.replace("'", "''")
GROUPS = ", ".join(f"unnest(regexp_extract_all(line, '{RNG}', {i})) AS g{i}" for i in range(1, 10))
MONTH = "CASE lower({c}[1:3]) " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in V.MONTHS.items()) + " ELSE 1 END"
RANGES = f"""rg AS (SELECT candidate_id, {GROUPS} FROM ({RESUME_LINES}) WHERE NOT regexp_matches(line, '{EDU}')),
 dr AS (SELECT candidate_id, CASE WHEN g2 <> '' THEN CAST(g2 AS INT) * 12 + {MONTH.format(c='g1')} ELSE CAST(g4 AS INT) * 12 + CAST(g3 AS INT) END AS start_month,
  CASE WHEN lower(g5) IN ('present', 'current', 'now') THEN NULL WHEN g7 <> '' THEN CAST(g7 AS INT) * 12 + {MONTH.format(c='g6')} ELSE CAST(g9 AS INT) * 12 + CAST(g8 AS INT) END AS end_month FROM rg)"""


@query("date_ranges", f"WITH {RANGES} SELECT candidate_id, start_month, end_month FROM dr")
def date_ranges(t):
    return ar.unpack(c.resumes(t), ["candidate_id"], dt.date_ranges(F.col("text")), "start_month")


SPAN = """sp AS (SELECT o_custkey AS key, year(o_orderdate) * 12 + month(o_orderdate) AS start_month, year(s) * 12 + month(s) AS end_month FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def order_spans(t):
    ship = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    month = lambda col: F.year(col) * 12 + F.month(col)
    return t.orders.join(ship, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("key"), month("o_orderdate").alias("start_month"), month("s").alias("end_month"))


@query("employment_gaps", f"""WITH {SPAN}, g AS (SELECT key, start_month, max(end_month) AS e FROM sp GROUP BY 1, 2), f AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY start_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM g)
 SELECT key, furthest AS from_month, start_month AS to_month, start_month - furthest AS months FROM f WHERE start_month - furthest > 6""")
def employment_gaps(t):
    return sc.employment_gaps(order_spans(t), "key")


@query("average_tenure", f"WITH {SPAN} SELECT key, count(*) AS dated_roles, round_even(avg(greatest(0, end_month - start_month)), 1) AS average_tenure FROM sp GROUP BY key")
def average_tenure(t):
    return sc.average_tenure(order_spans(t), "key")


TIMELINE = f"""{RANGES}, cl AS (SELECT candidate_id, start_month, coalesce(end_month, {c.AS_OF_MONTH}) AS end_month FROM dr),
 gp AS (SELECT *, max(end_month) OVER (PARTITION BY candidate_id ORDER BY start_month, end_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM cl),
 tl AS (SELECT candidate_id, count(*) FILTER (start_month - furthest > 6) AS gaps, round_even(avg(greatest(0, end_month - start_month)), 1) AS tenure, count(*) AS roles FROM gp GROUP BY 1)"""


@query("check_gaps_tenure_dates", f"""WITH {TIMELINE}, a AS (SELECT c_custkey AS candidate_id, coalesce(gaps, 0) AS gaps, tenure, coalesce(roles, 0) AS roles FROM customer LEFT JOIN tl ON tl.candidate_id = c_custkey)
 SELECT candidate_id, 'Employment gaps' AS name, CASE WHEN gaps > 0 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN gaps > 0 THEN 2.0 ELSE 1.0 END AS importance FROM a
 UNION ALL SELECT candidate_id, 'Tenure pattern', CASE WHEN tenure IS NULL THEN 'skipped' WHEN tenure < 18 THEN 'warn' ELSE 'pass' END, CASE WHEN tenure < 18 THEN 2.0 ELSE 1.0 END FROM a
 UNION ALL SELECT candidate_id, 'Experience legibility', CASE roles WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END, 2.0 FROM a""")
def check_gaps_tenure_dates(t):
    facts = sc.resume_facts(c.resumes(t), c.AS_OF_MONTH)
    return ar.unpack(facts, ["candidate_id"], ar.let(F.col("timeline"), sc.timeline_checks), "name").select("candidate_id", "name", "status", "importance")


HEAD = r"list_filter(regexp_split_to_array(text, '[\s\x{a0}\x0b\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+'), lambda w: w <> '')"


RESUME_ALIASES = "replace(replace(replace(replace({x}, 'k8s', 'kubernetes'), 'a/b tests', 'a/b testing'), 'data engineer', 'data engineering'), 'bi analyst', 'business intelligence analyst')"
HEADS = f"""mh AS (SELECT jd_id, replace(term, '-', ' ') AS t FROM top WHERE rank <= 10), rw AS (SELECT candidate_id, {HEAD} AS w FROM ({D.RESUME})),
 hd AS (SELECT candidate_id, len(w) >= 30 AS long, ' ' || replace({RESUME_ALIASES.format(x="lower(array_to_string(w[1:greatest(30, len(w) // 3)], ' '))")}, '-', ' ') || ' ' AS head FROM rw),
 ht AS (SELECT candidate_id, t FROM hd, (SELECT DISTINCT t FROM mh) WHERE regexp_matches(head, '[^a-z0-9]' || regexp_escape(t) || CASE WHEN ends_with(t, 's') OR length(t) <= 2 THEN '' ELSE 's?' END || '[^a-z0-9]')),
 tc AS (SELECT pa.candidate_id, pa.jd_id, CASE WHEN any_value(long) AND count(mh.t) > 0 THEN round_even(count(ht.t) / count(mh.t)::DOUBLE * 100, 1) END AS coverage FROM ({D.PAIR}) pa JOIN hd ON hd.candidate_id = pa.candidate_id
  LEFT JOIN mh ON mh.jd_id = pa.jd_id LEFT JOIN ht ON ht.candidate_id = pa.candidate_id AND ht.t = mh.t GROUP BY 1, 2)"""


@query("top_third_coverage", f"WITH {OFFERS}, {HEADS} SELECT candidate_id, jd_id, coverage FROM tc")
def top_third_coverage(t):
    """How much of each posting's ten heaviest terms the top of each document shows; null where there is nothing to show."""
    must = c.must_have(t)
    heads = sc.head_terms(c.resumes(t), must)
    return c.pairs(t).join(must, "jd_id").join(heads, "candidate_id").select("candidate_id", "jd_id", sc.shown_share().alias("coverage"))


@query("check_title_visible", f"""WITH pf AS ({PROFILE_TYPED}), r AS (SELECT candidate_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM ({D.RESUME}))
 SELECT r.candidate_id, CASE WHEN current_title = '' THEN 'skipped' WHEN contains(lower(array_to_string(w[1:greatest(30, len(w) // 3)], ' ')), lower(current_title)) THEN 'pass' ELSE 'warn' END AS status FROM r JOIN pf ON pf.candidate_id = r.candidate_id""")
def check_title_visible(t):
    facts = sc.resume_facts(c.resumes(t), c.AS_OF_MONTH).join(c.profiles(t).select("candidate_id", "current_title"), "candidate_id")
    return facts.select("candidate_id", sc.title_visible_check(F.col("head"))["status"].alias("status"))


@query("screen_scores")
def screen_scores(t):
    return sc.screen_scores(c.screened(t))


@query("screen_blockers")
def screen_blockers(t):
    return sc.screen_blockers(c.screened(t)).select("candidate_id", "jd_id", c.joined("blockers").alias("blockers"), "no_apply")


@query("screen_expectations")
def screen_expectations(t):
    return sc.screen_expectations(c.screened(t))


# the three summaries read the single checks above through their own oracle SQL
def _status(key: str, name: str | None = None) -> str:
    sql = ORACLES[key]
    return f"SELECT candidate_id, jd_id, {'name' if name is None else repr(name)} AS name, status, importance, 'candidacy' AS category FROM ({sql})"


_PER_DOC = f"""SELECT pa.candidate_id, jd_id, name, status, importance, CASE WHEN name = 'Experience legibility' THEN 'resume' ELSE 'candidacy' END AS category
 FROM ({D.PAIR}) pa JOIN ({ORACLES['check_gaps_tenure_dates']}) g ON g.candidate_id = pa.candidate_id"""
_TITLE = f"""SELECT pa.candidate_id, jd_id, 'Title visibility' AS name, status, CASE WHEN status = 'skipped' THEN 1.0 ELSE 2.0 END AS importance, 'resume' AS category
 FROM ({D.PAIR}) pa JOIN ({ORACLES['check_title_visible']}) g ON g.candidate_id = pa.candidate_id"""
_TOP = f"""SELECT candidate_id, jd_id, 'Top-third visibility' AS name, CASE WHEN coverage IS NULL THEN 'skipped' WHEN coverage >= 60 THEN 'pass' WHEN coverage >= 35 THEN 'warn' ELSE 'fail' END AS status,
 CASE WHEN coverage IS NULL THEN 1.0 ELSE 3.0 END AS importance, 'resume' AS category FROM ({ORACLES['top_third_coverage']})"""
ALL_CHECKS = " UNION ALL ".join([
    _status("check_years"), _status("check_overqualified"), _status("check_degree"), _status("check_certifications"), _status("check_work_mode", "Work mode"),
    _status("check_salary", "Salary"), _status("check_location", "Location"), _status("check_work_authorisation", "Work authorisation"),
    _status("check_notice_period", "Notice period"), _status("check_title_level", "Title alignment"), _PER_DOC, _TITLE, _TOP])
CRED = "sum(CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 ELSE 0.0 END * importance) FILTER (status <> 'skipped'{f}) / sum(importance) FILTER (status <> 'skipped'{f}) * 100"
ORACLES["screen_scores"] = f"""SELECT candidate_id, jd_id, coalesce(round_even({CRED.format(f='')}, 1), 0.0) AS criteria_met_pct,
 round_even({CRED.format(f=" AND category = 'resume'")}, 1) AS resume_pct, round_even({CRED.format(f=" AND category = 'candidacy'")}, 1) AS candidacy_pct FROM ({ALL_CHECKS}) GROUP BY 1, 2"""
BLOCK_ORDER = "CASE name WHEN 'Years of experience' THEN 1 WHEN 'Education' THEN 2 WHEN 'Work mode' THEN 4 WHEN 'Salary' THEN 5 WHEN 'Location' THEN 6 WHEN 'Work authorisation' THEN 7 ELSE 9 END"
ORACLES["screen_blockers"] = f"""SELECT candidate_id, jd_id, string_agg(name, '|' ORDER BY {BLOCK_ORDER}) AS blockers, bool_or(category = 'candidacy') AS no_apply FROM ({ALL_CHECKS}) WHERE status = 'fail' AND importance >= 3 GROUP BY 1, 2"""
ORACLES["screen_expectations"] = f"""WITH k AS ({ALL_CHECKS}), lt AS (WITH {PLACE} SELECT {IDS}, CASE WHEN decided AND NOT same THEN CASE WHEN open_to_relocation THEN 'Relocation' WHEN onsite THEN 'Location' END END AS topic, location <> '' OR coalesce(len(modes), 0) > 0 AS asks FROM pd)
 SELECT {IDS}, CASE name WHEN 'Years of experience' THEN 'Experience level' WHEN 'Work mode' THEN 'Work arrangement' WHEN 'Salary' THEN 'Salary expectations' WHEN 'Title alignment' THEN 'Step up in level' WHEN 'Employment gaps' THEN 'Employment gap' WHEN 'Tenure pattern' THEN 'Short tenure' ELSE name END AS topic, 'derived' AS source
 FROM k WHERE (name IN ('Years of experience', 'Education', 'Overqualification', 'Employment gaps', 'Tenure pattern') AND status IN ('warn', 'fail')) OR (name IN ('Work mode', 'Work authorisation') AND status = 'fail') OR (name LIKE 'Certification: %' AND status = 'fail')
  OR (name = 'Salary' AND (status = 'fail' OR (status = 'warn' AND importance = 1.0))) OR (name = 'Notice period' AND importance = 2.0) OR (name = 'Title alignment' AND status = 'warn' AND importance = 2.0)
 UNION ALL SELECT {IDS}, topic, 'derived' FROM lt WHERE topic IS NOT NULL UNION ALL SELECT {IDS}, unnest([{', '.join("'" + x.replace("'", "''") + "'" for x in sc.STANDARD_TOPICS)}]), 'standard' FROM ({D.PAIR}) UNION ALL SELECT {IDS}, 'Location & relocation', 'standard' FROM lt WHERE asks"""
