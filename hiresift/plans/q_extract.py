"""Term extraction and hard filters over postings composed from `part`."""
from __future__ import annotations

from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import terms as tm
from hiresift.functions import text as tx
from hiresift.operators import extract as ex
from hiresift.operators import requirements as rq
from hiresift.plans import common as c
from hiresift.plans import derived as D
from hiresift.plans.q_text import CLAUSE_CTE, POSTING_LINES, SECTIONED, SHOUT, TAX, TITLE_LINES, TITLE_SQL, alias_case, country_sql

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


MULTI = "[" + ", ".join(f"'{t}'" for t in V.DEFAULT.multiword) + "]"
# the aliases with a space that the composed postings use
NORM = "replace(replace(replace(lower(clause), 'data modelling', 'data modeling'), 'data engineer', 'data engineering'), ' qa ', ' quality assurance ')"
SOFT = ex.SOFTENED.replace("'", "''")
BLOCKED = ", ".join(f"'{w}'" for w in (*V.STOPWORDS, *V.NON_SKILL_ACRONYMS))
FOLD = f"CASE WHEN length(lw) > 3 AND ends_with(lw, 's') AND lw[:-2] IN ({TAX}) THEN lw[:-2] ELSE lw END"
TOK = r"'[A-Za-z][A-Za-z0-9+.#/&-]{1,}'"
OFFERS = f"""{SECTIONED}, {CLAUSE_CTE},
 cs AS (SELECT *, CASE WHEN section IN ('hard', 'skills') AND regexp_matches(clause, '{SOFT}') THEN 'nice' ELSE section END AS eff, {SHOUT.format(l='line')} AS shout FROM cl),
 phrase AS (SELECT jd_id, line_no, clause_no, clause, eff, unnest(list_filter({MULTI}, lambda m: contains({NORM}, m))) AS phrase FROM cs),
 tk0 AS (SELECT jd_id, line_no, clause_no, eff, shout, generate_subscripts(regexp_extract_all(clause, {TOK}), 1) AS i, unnest(regexp_extract_all(clause, {TOK})) AS tok FROM cs),
 tk1 AS (SELECT *, rtrim(tok, '+.#/&-') AS clean, lower(rtrim(tok, '+.#/&-')) AS lw, lag(lower(tok)) OVER (PARTITION BY jd_id, line_no, clause_no ORDER BY i) AS prev FROM tk0),
 tk2 AS (SELECT *, {FOLD} AS low FROM tk1 WHERE clean <> ''),
 tk3 AS (SELECT *, {alias_case('low')} AS term, list_contains({MULTI}, coalesce(prev, '?') || ' ' || low) AS in_phrase,
   CASE WHEN low IN ({BLOCKED}) OR length(low) < 2 THEN NULL WHEN regexp_full_match(clean, '[A-Z]{{2,6}}') AND NOT shout THEN 'acronym'
    WHEN regexp_full_match(clean, '[A-Z]{{2}}-[0-9]{{3}}') THEN 'exam_code' WHEN low IN ({TAX}) OR {alias_case('low')} IN ({TAX}) THEN 'taxonomy' END AS kind FROM tk2),
 offer AS (SELECT jd_id, line_no, clause_no, 0 AS k, list_position({MULTI}, phrase) AS idx, {alias_case('phrase')} AS term, eff AS section, 1.0 AS bump FROM phrase
  UNION ALL SELECT jd_id, line_no, clause_no, 1, i, term, eff, CASE WHEN kind = 'taxonomy' THEN 1.0 ELSE 1.3 END FROM tk3 WHERE kind IS NOT NULL AND NOT in_phrase),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY line_no, clause_no, k, idx) - 1 AS pos,
  CASE section WHEN 'hard' THEN 3.0 WHEN 'skills' THEN 2.5 WHEN 'responsibilities' THEN 1.5 ELSE 1.0 END AS w FROM offer),
 weighed AS (SELECT jd_id, term, arg_max(section, (w, -pos)) AS section, max(w) AS w, max(bump) AS bump, min(pos) AS first_pos FROM ranked GROUP BY jd_id, term),
 kw AS (SELECT jd_id, term, section, CAST(w * bump AS DECIMAL(6,2)) AS weight, first_pos FROM weighed WHERE section <> 'about'),
 top AS (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY weight DESC, first_pos, term) AS rank FROM kw)"""


@query("multiword_terms", f"WITH {OFFERS} SELECT DISTINCT jd_id, line_no, clause_no, phrase FROM phrase")
def multiword_terms(t):
    rows = F.flatten(F.transform(tx.kept_lines(F.col("jd_text")), lambda s: F.flatten(F.transform(tx.clauses(s["line"]), lambda x, i: F.transform(
        ex.phrase_terms(x), lambda p: F.struct(s["line_no"].alias("line_no"), (i + 1).alias("clause_no"), p.alias("phrase")))))))
    return ar.unpack(c.postings(t), ["jd_id"], rows, "phrase")


TWO_WORDS = r"""tp AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark)))"""


@query("phrase_index", f"WITH {TWO_WORDS} SELECT DISTINCT doc_id, term FROM documents, tp WHERE contains(lower(text), term)")
def phrase_index(t):
    """Which pairs of neighbouring benchmark words stand in which documents, by the index for large vocabularies."""
    words = t.benchmark.select(tx.find_all(F.lower("text"), r"[\p{L}\p{N}]+").alias("w"))
    pairs = ar.unnest(words, [], F.transform(F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - 1)), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1))), "term").distinct()
    return tm.phrase_index(t.documents, ["doc_id"], F.lower("text"), pairs)


def token_rows(t):
    rows = F.flatten(F.transform(tx.kept_lines(F.col("jd_text")), lambda s: ar.let(tx.is_shouting(s["line"]), lambda sh: F.flatten(F.transform(
        tx.clauses(s["line"]), lambda x, i: F.transform(ex.token_terms(x, sh), lambda k: F.struct(
            s["line_no"].alias("line_no"), (i + 1).alias("clause_no"), k["token"].alias("token"), k["term"].alias("term"), k["kind"].alias("kind"), k["in_phrase"].alias("in_phrase"))))))))
    return ar.unpack(c.postings(t), ["jd_id"], rows, "kind")


@query("single_terms", f"WITH {OFFERS} SELECT jd_id, line_no, clause_no, clean AS token, term, kind FROM tk3 WHERE kind IS NOT NULL")
def single_terms(t):
    return token_rows(t).drop("in_phrase")


@query("drop_inside_phrase", f"WITH {OFFERS} SELECT jd_id, line_no, clause_no, clean AS token, term FROM tk3 WHERE kind IS NOT NULL AND NOT in_phrase")
def drop_inside_phrase(t):
    return token_rows(t).where("not in_phrase").drop("in_phrase", "kind")


@query("soften_clause", f"WITH {OFFERS} SELECT jd_id, line_no, clause_no, section, eff AS effective FROM cs")
def soften_clause(t):
    rows = F.flatten(F.transform(ex.sectioned_lines(F.col("jd_text")), lambda s: F.transform(tx.clauses(s["line"]), lambda x, i: F.struct(
        s["line_no"].alias("line_no"), (i + 1).alias("clause_no"), s["section"].alias("section"), ex.effective_section(x, s["section"]).alias("effective")))))
    return ar.unpack(c.postings(t), ["jd_id"], rows, "line_no")


@query("keyword_weights", f"WITH {OFFERS} SELECT jd_id, term, weight, section, first_pos FROM kw")
def keyword_weights(t):
    return ar.unpack(c.postings(t), ["jd_id"], ex.weigh(ex.offers(ex.sectioned_lines(F.col("jd_text")))), "term")


@query("keyword_top_n", f"WITH {OFFERS} SELECT jd_id, term, weight, section, rank FROM top WHERE rank <= 5")
def keyword_top_n(t):
    return ex.jd_keywords(c.postings(t), top_n=5, alternatives=False).select("jd_id", "term", "weight", "section", "rank")


def with_terms(t):
    return c.postings(t).select("jd_id", ar.let(ex.sectioned_lines(F.col("jd_text")), lambda ls: F.struct(
        ar.field(ex.weigh(ex.offers(ls)), "term").alias("terms"), F.transform(ls, lambda s: tm.searchable(s["line"])).alias("norm"))).alias("x"))


LINE_NORM = "replace(replace(" + NORM.replace("clause", "line") + ", 'k8s', 'kubernetes'), 'ms excel', 'excel')"
IN_SPAN = "regexp_matches(' ' || {s} || ' ', '[^a-z0-9]' || regexp_escape(kw.term) || CASE WHEN ends_with(kw.term, 's') OR length(kw.term) <= 2 THEN '' ELSE 's?' END || '[^a-z0-9]')"
LISTS = rf"""nl AS (SELECT jd_id, line_no, {LINE_NORM} AS x FROM ({POSTING_LINES})),
 kt AS (SELECT jd_id, string_agg(regexp_escape(term), '|' ORDER BY length(term) DESC, term) AS alt FROM kw GROUP BY 1),
 ki AS (SELECT jd_id, alt, '(?:(?:advanced|basic|strong)\s+)?(?:' || alt || ')s?' AS item FROM kt),
 sp0 AS (SELECT nl.jd_id, line_no, regexp_extract_all(x, item || '(?:\s*(?:,\s*or\b|,|/|\bor\b)\s*' || item || ')+') AS l FROM nl JOIN ki ON ki.jd_id = nl.jd_id),
 sp1 AS (SELECT jd_id, line_no, generate_subscripts(l, 1) AS i, unnest(l) AS span FROM sp0),
 ol AS (SELECT jd_id, span, row_number() OVER (PARTITION BY jd_id ORDER BY line_no, i) AS list_no FROM sp1 WHERE regexp_matches(span, '\bor\b|/')),
 om AS (SELECT ol.jd_id, list_no, kw.term FROM ol JOIN kw ON kw.jd_id = ol.jd_id AND {IN_SPAN.format(s='span')}),
 pp AS (SELECT nl.jd_id, line_no, regexp_extract_all(x, '(' || alt || ')s?(?:\s+\w+)?\s*\(([^)]*)\)', 1) AS h, regexp_extract_all(x, '(' || alt || ')s?(?:\s+\w+)?\s*\(([^)]*)\)', 2) AS b FROM nl JOIN ki ON ki.jd_id = nl.jd_id WHERE contains(x, '(')),
 pq AS (SELECT jd_id, line_no, unnest(h) AS head, unnest(b) AS body FROM pp),
 pm AS (SELECT pq.jd_id, line_no, head, kw.term FROM pq JOIN kw ON kw.jd_id = pq.jd_id AND kw.term <> head AND {IN_SPAN.format(s='body')}),
 pg AS (SELECT jd_id, line_no, head, list(term ORDER BY term) AS members FROM pm GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


@query("link_or_lists", f"WITH {OFFERS}, {LISTS} SELECT jd_id, list_no, string_agg(term, '|' ORDER BY term) AS members FROM om GROUP BY 1, 2")
def link_or_lists(t):
    groups = ar.let(F.col("x"), lambda x: F.when(F.size(x["terms"]) > 0, F.transform(ex.or_lists(x["terms"], x["norm"]), lambda g, i: F.struct(
        (i + 1).alias("list_no"), F.array_join(F.array_sort(g), "|").alias("members")))))
    return ar.unpack(with_terms(t), ["jd_id"], groups, "list_no")


@query("link_paren_examples", f"WITH {OFFERS}, {LISTS} SELECT jd_id, head, array_to_string(members, '|') AS members FROM pg")
def link_paren_examples(t):
    groups = ar.let(F.col("x"), lambda x: F.when(F.size(x["terms"]) > 0, F.transform(ex.paren_examples(x["terms"], x["norm"]), lambda g: F.struct(
        g["head"].alias("head"), F.array_join(F.array_sort(g["members"]), "|").alias("members")))))
    return ar.unpack(with_terms(t), ["jd_id"], groups, "head")


SKILL_RE = r"'[a-z][a-z0-9+.#/-]{1,}'"
SKILLS_SQL = f"""h AS (SELECT doc_id, text, lower(text) AS hay FROM documents),
 a AS (SELECT doc_id, unnest(list_filter({MULTI}, lambda m: contains(hay, m))) AS term FROM h),
 b AS (SELECT doc_id, {FOLD} AS term FROM (SELECT doc_id, unnest(regexp_extract_all(hay, {SKILL_RE})) AS lw FROM h)),
 w AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS tok FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+.#/-]{{1,}}') AS l FROM h)),
 x AS (SELECT doc_id, tok, lag(lower(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM w),
 d AS (SELECT doc_id, {alias_case('lower(tok)')} AS term FROM x WHERE regexp_full_match(tok, '[A-Z]{{2,6}}') AND NOT list_contains({MULTI}, coalesce(prev, '?') || ' ' || lower(tok))
  UNION ALL SELECT doc_id, lower(tok) FROM x WHERE regexp_full_match(tok, '[A-Z]{{2}}-[0-9]{{3}}')),
 s AS (SELECT doc_id, term FROM a UNION SELECT doc_id, term FROM b WHERE term IN ({TAX}) UNION SELECT doc_id, term FROM d)"""


@query("skill_tokens", f"WITH {SKILLS_SQL} SELECT doc_id, term FROM s")
def skill_tokens(t):
    return ar.unnest(t.documents, ["doc_id"], ex.skill_tokens(F.col("text")), "term")


BY_LINE = [t for t in ("sql", "python", "power bi", "tableau", "excel", "aws", "react", "docker", "salesforce", "airflow", "kpi", "etl")]


@query("terms_by_line", f"""WITH l AS (SELECT jd_id, line_no, ' ' || lower(line) || ' ' AS hay FROM ({POSTING_LINES})),
 m AS (SELECT jd_id, line_no, list_sort(list_filter({[t for t in BY_LINE]}, lambda m: regexp_matches(hay, '[^a-z0-9]' || m || CASE WHEN ends_with(m, 's') OR length(m) <= 2 THEN '' ELSE 's?' END || '[^a-z0-9]'))) AS f FROM l)
 SELECT jd_id, line_no, array_to_string(f, '|') AS found FROM m WHERE len(f) > 0""")
def terms_by_line(t):
    rows = c.postings(t).withColumn("terms", F.array(*map(F.lit, BY_LINE)))
    return ex.terms_by_line(rows, "terms").select("jd_id", "line_no", c.joined("found").alias("found"))


# ---------------------------------------------------------------- hard filters

YEARS_SOFT = rq.YEARS_SOFT
YP = [p.replace("'", "''") for p in rq.YEAR_PATTERNS]
YEARS_SQL = f"""yf AS (SELECT jd_id, line_no, line, section, unnest([{', '.join(f"CAST(nullif(regexp_extract(line, '{p}', 1), '') AS DOUBLE)" for p in YP)}]) AS v FROM sec WHERE NOT regexp_matches(line, '{YEARS_SOFT}')),
 yr AS (SELECT jd_id, coalesce(min(v) FILTER (section = 'hard'), min(v)) AS min_years,
  CASE WHEN count(v) FILTER (section = 'hard') > 0 THEN arg_min(line, (v, line_no)) FILTER (section = 'hard' AND v IS NOT NULL) ELSE arg_min(line, (v, line_no)) FILTER (v IS NOT NULL) END AS line
  FROM yf GROUP BY jd_id HAVING count(v) > 0)"""


@query("years_floor", f"WITH {SECTIONED}, {YEARS_SQL} SELECT jd_id, min_years, line FROM yr")
def years_floor(t):
    return rq.requirement_parts(c.postings(t)).where("years is not null").select("jd_id", F.col("years.value").alias("min_years"), "years.line")


# lookarounds written as plain RE2: office software after 'ms' is removed before the level test
DEGREE_SQL = rf"""dc AS (SELECT jd_id, line_no, line, generate_subscripts(regexp_split_to_array(line, ';|\.\s'), 1) AS cn, unnest(regexp_split_to_array(line, ';|\.\s')) AS raw FROM ({POSTING_LINES})),
 dx AS (SELECT *, regexp_replace(raw, '(?i)\bms\s*(excel|office|word|sql|access|teams|project|visio|power|azure|-|[0-9])', '', 'g') AS x FROM dc),
 dl AS (SELECT jd_id, line_no, line, cn, NOT regexp_matches(raw, '{rq.DEGREE_SOFT}') AS mandatory, CASE WHEN regexp_matches(x, '(?i)\bdiploma\b') THEN 'diploma'
  WHEN regexp_matches(x, '(?i)\bbachelor''?s?\b|\bb\.?tech\b|\bbs\s+(in|degree)\b|\bgraduate\b') THEN 'bachelors' WHEN regexp_matches(x, '(?i)\bmba\b') THEN 'mba'
  WHEN regexp_matches(x, '(?i)\bmaster''?s\b|\bmaster\s+(of|degree)\b|\bms\b') THEN 'masters' WHEN regexp_matches(x, '(?i)\bph\.?d\b') THEN 'phd' END AS level FROM dx),
 dr AS (SELECT *, CASE level WHEN 'diploma' THEN 2 WHEN 'bachelors' THEN 3 WHEN 'phd' THEN 5 ELSE 4 END AS rank FROM dl WHERE level IS NOT NULL),
 dg AS (SELECT jd_id, bool_or(mandatory) AS degree_mandatory, arg_min(level, (CASE WHEN mandatory THEN 0 ELSE 1 END, rank, line_no, cn)) AS min_degree,
  arg_min(line, (CASE WHEN mandatory THEN 0 ELSE 1 END, rank, line_no, cn)) AS line FROM dr GROUP BY jd_id)"""


@query("degree_floor", f"WITH {DEGREE_SQL} SELECT jd_id, min_degree, degree_mandatory, line FROM dg")
def degree_floor(t):
    return rq.requirement_parts(c.postings(t)).where("degree is not null").select(
        "jd_id", F.col("degree.level").alias("min_degree"), F.col("degree.mandatory").alias("degree_mandatory"), "degree.line")


CERT_RE = rq.CERTIFICATION.removesuffix("(?![A-Za-z0-9])")
CERT_SQL = f"""ce AS (SELECT jd_id, line_no, line, generate_subscripts(m, 1) AS i, trim(unnest(m)) AS cert FROM (SELECT jd_id, line_no, line, regexp_extract_all(line, '{CERT_RE}', 1) AS m FROM ({POSTING_LINES}))),
 cr AS (SELECT *, row_number() OVER (PARTITION BY jd_id, lower(cert) ORDER BY line_no, i) AS rn FROM ce),
 cert AS (SELECT jd_id, cert, line_no, i, line, NOT regexp_matches(line, '{rq.DEGREE_SOFT}') AS mandatory FROM cr WHERE rn = 1)"""


@query("certifications", f"WITH {CERT_SQL} SELECT jd_id, cert, line, mandatory FROM cert")
def certifications(t):
    return ar.unpack(rq.requirement_parts(c.postings(t)), ["jd_id"], F.col("certs"), "cert").drop("line_no")


MODE_SQL = f"""md AS (SELECT jd_id, line_no, line, unnest(list_filter([CASE WHEN regexp_matches(line, '{rq.MODE_PATTERNS['remote']}') THEN 'remote' END,
  CASE WHEN regexp_matches(line, '(?i)\\bhybrid\\b') THEN 'hybrid' END, CASE WHEN regexp_matches(line, '{rq.MODE_PATTERNS['onsite']}') AND NOT regexp_matches(line, '(?i)\\bhybrid\\b') THEN 'onsite' END], lambda x: x IS NOT NULL)) AS mode FROM ({POSTING_LINES})),
 mode AS (SELECT jd_id, mode, arg_min(line, line_no) AS line, min(line_no) AS line_no FROM md GROUP BY jd_id, mode)"""


@query("work_modes", f"WITH {MODE_SQL} SELECT jd_id, mode, line FROM mode")
def work_modes(t):
    return ar.unpack(rq.requirement_parts(c.postings(t)), ["jd_id"], F.col("modes"), "mode").drop("line_no")


NOSP = rq.NO_SPONSORSHIP.replace("'", "''")
SPON_SQL = f"""sp AS (SELECT jd_id, arg_min(line, line_no) FILTER (regexp_matches(line, '{NOSP}')) AS no_sponsor_line, arg_min(line, line_no) FILTER (regexp_matches(line, '{rq.WORK_AUTH}')) AS work_auth_line FROM ({POSTING_LINES}) GROUP BY jd_id)"""


@query("sponsorship_flags", f"WITH {SPON_SQL} SELECT jd_id, no_sponsor_line IS NOT NULL AS sponsorship_unavailable, work_auth_line IS NOT NULL AS work_auth_required, no_sponsor_line, work_auth_line FROM sp")
def sponsorship_flags(t):
    return rq.jd_requirements(c.postings(t)).select("jd_id", "sponsorship_unavailable", "work_auth_required", "no_sponsor_line", "work_auth_line")


# expected figures, stated per salary wording
SALARY_SQL = """sal AS (SELECT p_partkey AS jd_id,
 CASE (p_partkey + p_size) % 11 WHEN 0 THEN floor(p_retailprice / 10) * 1000 WHEN 1 THEN floor(p_retailprice / 100) * 100000 WHEN 2 THEN 18000 WHEN 3 THEN 120000 WHEN 5 THEN floor(p_retailprice * 50) WHEN 7 THEN 50000 WHEN 10 THEN 600000 END AS salary_min,
 CASE (p_partkey + p_size) % 11 WHEN 0 THEN floor(p_retailprice / 10 + 20) * 1000 WHEN 1 THEN floor(p_retailprice / 100 + 6) * 100000 WHEN 2 THEN 22000 WHEN 3 THEN 140000 WHEN 4 THEN floor(p_retailprice / 20) * 1000 WHEN 10 THEN 1000000 END AS salary_max,
 CASE (p_partkey + p_size) % 11 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' WHEN 2 THEN 'AED' WHEN 3 THEN 'CAD' WHEN 4 THEN 'GBP' WHEN 5 THEN 'EUR' WHEN 7 THEN 'INR' WHEN 10 THEN 'INR' END AS salary_currency FROM part)"""


@query("salary_range", f"WITH {SALARY_SQL} SELECT jd_id, salary_min, salary_max, salary_currency FROM sal WHERE salary_currency IS NOT NULL")
def salary_range(t):
    return rq.jd_requirements(c.postings(t)).where("salary_line is not null").select("jd_id", "salary_min", "salary_max", "salary_currency")


LOC = rq.LOCATION.replace("'", "''")
LOC_SQL = f"""lo AS (SELECT jd_id, trim(regexp_split_to_array(regexp_extract(line, '{LOC}', 1), '\\.\\s')[1], ' .,-') AS jd_location, line FROM (
 SELECT jd_id, arg_min(line, line_no) AS line FROM ({POSTING_LINES}) WHERE regexp_matches(line, '{LOC}') GROUP BY jd_id))"""


@query("jd_location", f"WITH {LOC_SQL} SELECT jd_id, jd_location, line FROM lo")
def jd_location(t):
    return rq.requirement_parts(c.postings(t)).where("location is not null").select("jd_id", F.col("location.place").alias("jd_location"), "location.line")


@query("detect_countries", f"SELECT jd_id, unnest({country_sql('jd_text')}) AS country FROM ({D.POSTING})")
def detect_countries(t):
    return ar.unnest(c.postings(t), ["jd_id"], tx.countries_in(F.col("jd_text")), "country")


LEVEL_SQL = r"rtrim(lower(regexp_extract(line, '(?i)\b(intern|trainee|junior|jr\.?|associate|senior|sr\.?|staff|principal|lead|head of|director|vp|manager)\b', 1)), '.')"
TITLES_SQL = f"""tl AS (SELECT jd_id, line AS title_line, {LEVEL_SQL} AS seniority FROM {TITLE_LINES}), ti AS ({TITLE_SQL.format(key='jd_id', src=TITLE_LINES)})"""


@query("title_and_seniority", f"WITH {TITLES_SQL} SELECT tl.jd_id, title_line, seniority, ti.title AS jd_title FROM tl JOIN ti ON ti.jd_id = tl.jd_id")
def title_and_seniority(t):
    return rq.jd_requirements(c.postings(t)).select("jd_id", "title_line", "seniority", "jd_title")


ALL_SQL = f"{SECTIONED}, {YEARS_SQL}, {DEGREE_SQL}, {CERT_SQL}, {MODE_SQL}, {SPON_SQL}, {SALARY_SQL}, {LOC_SQL}, {TITLES_SQL}, co AS (SELECT jd_id, {country_sql('jd_text')} AS countries, l_salary FROM ({D.POSTING}))"
MONEY = "coalesce(printf('%.2f', CAST({c} AS DOUBLE)), '')"
EVIDENCE_SQL = f"""{ALL_SQL}, ev AS (SELECT jd_id, 'min_years' AS kind, CAST(CAST(min_years AS BIGINT) AS VARCHAR) AS value, line AS source_line, true AS mandatory FROM yr
 UNION ALL SELECT jd_id, 'min_degree', min_degree, line, degree_mandatory FROM dg UNION ALL SELECT jd_id, 'certification', cert, line, mandatory FROM cert
 UNION ALL SELECT jd_id, 'work_mode', mode, line, true FROM mode UNION ALL SELECT jd_id, 'sponsorship_unavailable', 'true', no_sponsor_line, true FROM sp WHERE no_sponsor_line IS NOT NULL
 UNION ALL SELECT jd_id, 'work_auth_required', 'true', work_auth_line, true FROM sp WHERE work_auth_line IS NOT NULL
 UNION ALL SELECT sal.jd_id, 'salary', {MONEY.format(c='salary_min')} || '|' || {MONEY.format(c='salary_max')} || '|' || salary_currency, l_salary, false FROM sal JOIN co ON co.jd_id = sal.jd_id WHERE salary_currency IS NOT NULL
 UNION ALL SELECT jd_id, 'location', jd_location, line, false FROM lo
 UNION ALL SELECT co.jd_id, 'countries', array_to_string(countries, '|'), coalesce(jd_location, 'country mentioned in the JD'), false FROM co LEFT JOIN lo ON lo.jd_id = co.jd_id WHERE len(countries) > 0
 UNION ALL SELECT jd_id, 'seniority', seniority, title_line, true FROM tl WHERE seniority <> '')"""


@query("requirement_evidence", f"WITH {EVIDENCE_SQL} SELECT jd_id, kind, value, source_line, mandatory FROM ev")
def requirement_evidence(t):
    return rq.requirement_evidence(c.postings(t)).drop("item_no")


WIDE_SQL = f"""{ALL_SQL}, req AS (SELECT p.jd_id, yr.min_years, yr.line AS years_line, dg.min_degree, coalesce(dg.degree_mandatory, true) AS degree_mandatory, dg.line AS degree_line,
 (SELECT list(cert ORDER BY line_no, i) FROM cert WHERE cert.jd_id = p.jd_id) AS certs, (SELECT list(mode ORDER BY line_no, CASE mode WHEN 'remote' THEN 0 WHEN 'hybrid' THEN 1 ELSE 2 END) FROM mode WHERE mode.jd_id = p.jd_id) AS modes,
 sp.no_sponsor_line, sp.work_auth_line, tl.seniority, tl.title_line, ti.title AS jd_title, sal.salary_min, sal.salary_max, sal.salary_currency, p.l_salary AS salary_line, coalesce(lo.jd_location, '') AS jd_location, lo.line AS location_line, co.countries
 FROM ({D.POSTING}) p LEFT JOIN yr ON yr.jd_id = p.jd_id LEFT JOIN dg ON dg.jd_id = p.jd_id JOIN sp ON sp.jd_id = p.jd_id JOIN tl ON tl.jd_id = p.jd_id JOIN ti ON ti.jd_id = p.jd_id
 JOIN sal ON sal.jd_id = p.jd_id LEFT JOIN lo ON lo.jd_id = p.jd_id JOIN co ON co.jd_id = p.jd_id)"""


@query("jd_requirements", f"""WITH {WIDE_SQL} SELECT jd_id, min_years, min_degree, degree_mandatory, coalesce(array_to_string(certs, '|'), '') AS certifications, coalesce(array_to_string(modes, '|'), '') AS work_modes,
 no_sponsor_line IS NOT NULL AS sponsorship_unavailable, work_auth_line IS NOT NULL AS work_auth_required, seniority, salary_min, salary_max, salary_currency, jd_location, array_to_string(countries, '|') AS countries, jd_title FROM req""")
def jd_requirements(t):
    wide = rq.jd_requirements(c.postings(t))
    keep = ("min_years", "min_degree", "degree_mandatory", "sponsorship_unavailable", "work_auth_required", "seniority", "salary_min", "salary_max", "salary_currency", "jd_location", "jd_title")
    return wide.select("jd_id", *keep, *[c.joined(n).alias(n) for n in ("certifications", "work_modes", "countries")])
