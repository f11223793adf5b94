"""Model answers composed per posting, and rewrites composed per bullet."""
from __future__ import annotations

from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import text as tx
from hiresift.operators import extract as ex
from hiresift.operators import grounding as gr
from hiresift.operators import requirements as rq
from hiresift.operators import verify as vf
from hiresift.plans import common as c
from hiresift.plans import derived as D
from hiresift.plans.q_extract import BLOCKED, FOLD, MULTI, OFFERS, SKILL_RE, WIDE_SQL
from hiresift.plans.q_text import BULLET_ORACLE, TAX, alias_case
from hiresift.session import materialize

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


K = D.K
TITLE_VALUES = ("warehouse planning manager", "data analyst", "data analyst", "software engineer", "software engineer", "", "supply analyst",
                "data engineer", "accountant", "qa tester", "supply analyst", "marketing manager", "project manager")
LEVEL_VALUES = ("senior", "", "lead", "", "staff", "", "", "principal", "sr", "junior", "", "head of", "associate")
DEGREE_VALUES = ("bachelors", "masters", "bachelors", "mba", "bachelors", "masters", "graduate", "diploma", "phd", "bachelor", "masters")
A_TITLE = f"CASE WHEN {K} % 5 = 0 THEN 'astronaut' ELSE {D.pick(K, TITLE_VALUES)} END"
A_LEVEL = f"CASE WHEN {K} % 7 = 3 THEN 'wizard' ELSE {D.pick(K, LEVEL_VALUES)} END"
A_DEGREE = D.pick(K, DEGREE_VALUES)
Q = lambda name: f"'\"quote\": \"' || {D.P[name]} || '\"}}'"
BODY = " || ".join([
    f"'{{\"title\": {{\"value\": \"' || {A_TITLE} || '\", ' || {Q('title')}",
    f"', \"seniority\": {{\"value\": \"' || {A_LEVEL} || '\", ' || {Q('title')}",
    f"', \"min_years\": {{\"value\": ' || CAST({D.YEARS} AS STRING) || ', \"mandatory\": ' || CASE {K} % 2 WHEN 0 THEN 'true' ELSE 'false' END || ', ' || {Q('years')}",
    f"', \"degree\": {{\"value\": \"' || {A_DEGREE} || '\", \"mandatory\": ' || CASE {K} % 3 WHEN 0 THEN 'false' ELSE 'true' END || ', ' || {Q('degree')}",
    f"', \"certifications\": [{{\"name\": \"PMP\", ' || {Q('cert')} || ']'",
    f"', \"work_modes\": [{{\"value\": \"remote\", ' || {Q('mode')} || ', {{\"value\": \"On-site\", ' || {Q('mode')} || ', {{\"value\": \"lunar\", ' || {Q('mode')} || ']'",
    f"', \"sponsorship_unavailable\": {{\"value\": true, ' || {Q('visa')}",
    f"', \"salary\": {{\"min\": 50000, \"max\": \"60,000\", \"currency\": \"usd\", ' || {Q('salary')}",
    f"', \"countries\": [{{\"value\": \"Dubai\", ' || {Q('place')} || ', {{\"value\": \"EMEA\", ' || {Q('place')} || ']'",
    f"', \"skills\": [{{\"term\": \"SQL\", \"required\": true, ' || {Q('skill')} || ', {{\"term\": \"tableau\", \"required\": false, ' || {Q('skill')} || ', {{\"term\": \"team\", \"required\": true, ' || {Q('skill')}",
    f"', {{\"term\": \"gardening\", \"required\": true, \"quote\": \"we love gardening\"}}, {{\"term\": \"green belt\", \"required\": true, ' || {Q('cert')} || ']}}'",
])
ANSWER = f"""SELECT {K} AS jd_id, 'm' || CAST({K} % 3 AS STRING) AS model, {D.pick(K, ('', 'Sure, here it is: ', '```json' + chr(10), 'I cannot answer {sorry '))} || {BODY} || {D.pick(K, ('', ' Hope that helps {really}.', chr(10) + '```', ''))} AS raw FROM part"""
PARSED = f"{K} % 4 <> 3"


def answers(t):
    return t.sql(ANSWER)


def grounded(t):
    return gr.ground_fields(answers(t), c.postings(t))


@query("parse_answers_json", f"SELECT {K} AS jd_id, CASE WHEN {PARSED} THEN {D.YEARS} END AS years, CASE WHEN {PARSED} THEN {A_TITLE} END AS title FROM part")
def parse_answers_json(t):
    parsed = answers(t).select("jd_id", gr.parse_answer(F.col("raw")).alias("a"))
    return parsed.select("jd_id", F.try_variant_get("a", "$.min_years.value", "int").alias("years"), F.try_variant_get("a", "$.title.value", "string").alias("title"))


QUOTE = D.pick(K, (("sql", D.P["skill"]), ("sql", f"{D.P['degree']} || ' zz'"), "", ("sql", f"upper({D.P['place']})"), "x", ("sql", f"repeat({D.P['skill']}, 30)"), ("sql", D.JD_TEXT)))
NORMQ = r'''trim(regexp_replace(translate(lower({x}), '‘’“”"`–—−' || chr(39), '          '), '[^\p{{L}}\p{{Nd}}_+#&$₹£€%]+', ' ', 'g'))'''
QN, JN = NORMQ.format(x="quote"), NORMQ.format(x="jd_text")


@query("ground_quotes", f"""SELECT jd_id, quote, CASE WHEN trim(quote) = '' THEN 'no quote' WHEN length({QN}) < 2 THEN 'quote too short' WHEN length({QN}) > 300 THEN 'quote too long' WHEN NOT contains({JN}, {QN}) THEN 'quote not found' END AS reason
 FROM (SELECT {K} AS jd_id, {QUOTE} AS quote, {D.JD_TEXT} AS jd_text FROM part)""")
def ground_quotes(t):
    quotes = t.sql(f"SELECT {K} AS jd_id, {QUOTE} AS quote FROM part")
    return gr.ground_quotes(quotes, c.postings(t))


# what each composed statement must come to, stated per wording of the line it quotes
CASES = f"""it AS (SELECT {K} AS jd_id, {K} AS k, p_size AS z, * FROM part WHERE {PARSED}),
 gf AS (SELECT jd_id, 'title' AS field, {A_TITLE} AS value, CASE WHEN k % 5 = 0 THEN 'title words not in quote' END AS reason FROM it WHERE {A_TITLE} <> ''
 UNION ALL SELECT jd_id, 'seniority', replace({A_LEVEL}, 'sr', 'senior'), CASE WHEN k % 7 = 3 THEN 'unknown seniority level' END FROM it WHERE {A_LEVEL} <> ''
 UNION ALL SELECT jd_id, 'min_years', CAST({D.YEARS} AS VARCHAR), CASE WHEN k % 7 = 6 THEN 'number and years not in quote' END FROM it
 UNION ALL SELECT jd_id, 'min_degree', CASE {A_DEGREE} WHEN 'bachelor' THEN 'bachelors' ELSE {A_DEGREE} END, CASE k % 11 WHEN 6 THEN 'unknown degree level' END FROM it
 UNION ALL SELECT jd_id, 'certifications', 'PMP', CASE WHEN (k + z) % 7 NOT IN (0, 5) THEN 'name not in quote' END FROM it
 UNION ALL SELECT jd_id, 'work_modes', 'remote', CASE WHEN (k + z) % 5 NOT IN (0, 3) THEN 'mode word not in quote' END FROM it
 UNION ALL SELECT jd_id, 'work_modes', 'onsite', CASE WHEN (k + z) % 5 NOT IN (1, 2) THEN 'mode word not in quote' END FROM it
 UNION ALL SELECT jd_id, 'work_modes', 'lunar', 'unknown work mode' FROM it
 UNION ALL SELECT jd_id, 'sponsorship_unavailable', 'true', CASE WHEN (k + 5) % 7 = 6 THEN 'no sponsorship wording in quote' END FROM it
 UNION ALL SELECT jd_id, 'salary', '50000.00|60000.00|USD', CASE WHEN (k + z) % 11 = 9 THEN 'no amount in quote' END FROM it
 UNION ALL SELECT jd_id, 'countries', 'united arab emirates', CASE WHEN (k + 3) % 7 <> 0 THEN 'country not in quote' END FROM it
 UNION ALL SELECT jd_id, 'countries', 'emea', 'not a country' FROM it
 UNION ALL SELECT jd_id, 'skills', 'sql', CASE WHEN (k + 3 * z) % 11 NOT IN (2, 3) THEN 'term not in quote' END FROM it
 UNION ALL SELECT jd_id, 'skills', 'tableau', CASE WHEN (k + 3 * z) % 11 <> 0 THEN 'term not in quote' END FROM it
 UNION ALL SELECT jd_id, 'skills', 'team', 'boilerplate word' FROM it UNION ALL SELECT jd_id, 'skills', 'gardening', 'quote not found' FROM it
 UNION ALL SELECT jd_id, 'skills', 'green belt', CASE WHEN (k + z) % 7 <> 5 THEN 'term not in quote' END FROM it)"""


@query("ground_fields", f"WITH {CASES} SELECT jd_id, field, value, reason FROM gf")
def ground_fields(t):
    return grounded(t).select("jd_id", "field", "value", "reason")


@query("rejected_items", f"WITH {CASES} SELECT field, reason, count(*) AS n FROM gf WHERE reason IS NOT NULL GROUP BY 1, 2")
def rejected_items(t):
    return gr.rejected_items(grounded(t)).groupBy("field", "reason").agg(F.count("*").alias("n"))


MERGE = f"""{WIDE_SQL}, {CASES}, ru AS (SELECT jd_id, 'title' AS field, jd_title AS value FROM req WHERE jd_title <> '' UNION ALL SELECT jd_id, 'seniority', seniority FROM req WHERE seniority <> ''
 UNION ALL SELECT jd_id, 'min_years', CAST(CAST(min_years AS BIGINT) AS VARCHAR) FROM req WHERE min_years IS NOT NULL UNION ALL SELECT jd_id, 'min_degree', min_degree FROM req WHERE min_degree IS NOT NULL
 UNION ALL SELECT jd_id, 'sponsorship_unavailable', 'true' FROM req WHERE no_sponsor_line IS NOT NULL
 UNION ALL SELECT jd_id, 'degree_mandatory', CAST(degree_mandatory AS VARCHAR) FROM req WHERE min_degree IS NOT NULL UNION ALL SELECT jd_id, 'work_modes', array_to_string(list_sort(list_distinct(modes)), '|') FROM req WHERE len(modes) > 0
 UNION ALL SELECT jd_id, 'salary', coalesce(printf('%.2f', CAST(salary_min AS DOUBLE)), '') || '|' || coalesce(printf('%.2f', CAST(salary_max AS DOUBLE)), '') || '|' || coalesce(salary_currency, '') FROM req WHERE salary_currency IS NOT NULL),
 ve AS (SELECT jd_id, field, value FROM gf WHERE reason IS NULL AND field IN ('title', 'seniority', 'min_years', 'min_degree', 'sponsorship_unavailable', 'salary')
  UNION ALL SELECT jd_id, 'work_modes', string_agg(DISTINCT value, '|' ORDER BY value) FROM gf WHERE reason IS NULL AND field = 'work_modes' GROUP BY 1
  UNION ALL SELECT gf.jd_id, 'degree_mandatory', CASE gf.jd_id % 3 WHEN 0 THEN 'false' ELSE 'true' END FROM gf JOIN it ON it.jd_id = gf.jd_id WHERE reason IS NULL AND field = 'min_degree'),
 mf AS (SELECT coalesce(ru.jd_id, ve.jd_id) AS jd_id, coalesce(ru.field, ve.field) AS field, ru.value AS rule_value, ve.value AS llm_value FROM ru FULL JOIN ve ON ve.jd_id = ru.jd_id AND ve.field = ru.field)"""


def merged_fields(t, g):
    return gr.merge_hybrid_fields(gr.rule_values(rq.jd_requirements(c.postings(t))), gr.verified_scalars(g))


@query("merge_hybrid_fields", f"WITH {MERGE} SELECT jd_id, field, coalesce(llm_value, rule_value) AS value, CASE WHEN llm_value IS NOT NULL THEN 'llm' ELSE 'rules' END AS source FROM mf")
def merge_hybrid_fields(t):
    return merged_fields(t, materialize(grounded(t), "grounded")).select("jd_id", "field", "value", "source")


@query("merge_hybrid_lists", f"""WITH {WIDE_SQL}, {CASES} SELECT req.jd_id, array_to_string(CASE WHEN p.jd_id IS NULL OR len(list_filter(coalesce(certs, []), lambda x: contains(lower(x), 'pmp'))) > 0 THEN coalesce(certs, []) ELSE list_append(coalesce(certs, []), 'PMP') END, '|') AS certifications,
 array_to_string(CASE WHEN n.jd_id IS NULL OR list_contains(countries, 'united arab emirates') THEN countries ELSE list_append(countries, 'united arab emirates') END, '|') AS countries
 FROM req LEFT JOIN (SELECT jd_id FROM gf WHERE field = 'certifications' AND reason IS NULL) p ON p.jd_id = req.jd_id LEFT JOIN (SELECT jd_id FROM gf WHERE field = 'countries' AND reason IS NULL) n ON n.jd_id = req.jd_id""")
def merge_hybrid_lists(t):
    merged = gr.merge_hybrid_lists(rq.jd_requirements(c.postings(t)), grounded(t))
    return merged.select("jd_id", c.joined("certifications").alias("certifications"), c.joined("countries").alias("countries"))


SKILLS_MERGE = f"""{OFFERS}, {CASES}, vs AS (SELECT jd_id, value AS term, value <> 'tableau' AS required FROM gf WHERE field = 'skills' AND reason IS NULL),
 ms AS (SELECT coalesce(kw.jd_id, vs.jd_id) AS jd_id, coalesce(kw.term, vs.term) AS term, kw.weight, kw.section, vs.required, kw.section IN ('hard', 'skills') AS was FROM kw FULL JOIN vs ON vs.jd_id = kw.jd_id AND vs.term = kw.term),
 mk AS (SELECT *, CASE WHEN section IS NULL THEN 'added' WHEN required IS NOT NULL AND was <> required THEN 'moved' ELSE 'kept' END AS change, CASE WHEN required THEN 'hard' ELSE 'nice' END AS ns FROM ms WHERE section IS NOT NULL OR required),
 mr AS (SELECT jd_id, term, change, section AS rule_section, CASE WHEN change = 'kept' THEN section ELSE ns END AS section, CASE change WHEN 'added' THEN 3.0 WHEN 'moved' THEN round(CASE WHEN required THEN 3.0 ELSE 1.0 END * CAST(weight AS DOUBLE) / CASE section WHEN 'hard' THEN 3.0 WHEN 'skills' THEN 2.5 WHEN 'responsibilities' THEN 1.5 ELSE 1.0 END, 2) ELSE CAST(weight AS DOUBLE) END AS weight FROM mk)"""


def merged_skills(t, g):
    keywords = ex.jd_keywords(c.postings(t), top_n=None, alternatives=False)
    return gr.merge_hybrid_skills(keywords, gr.verified_skills(g))


@query("merge_hybrid_skills", f"WITH {SKILLS_MERGE} SELECT jd_id, term, section, weight, change FROM mr")
def merge_hybrid_skills(t):
    return merged_skills(t, grounded(t)).drop("rule_section")


@query("extraction_conflicts", f"""SELECT * FROM (WITH {MERGE} SELECT jd_id, field, llm_value AS llm, rule_value AS rules FROM mf WHERE llm_value <> rule_value AND field <> 'degree_mandatory')
 UNION ALL SELECT * FROM (WITH {SKILLS_MERGE} SELECT jd_id, 'skill:' || term, section, rule_section FROM mr WHERE change = 'moved')""")
def extraction_conflicts(t):
    g = materialize(grounded(t), "grounded")
    return gr.extraction_conflicts(merged_fields(t, g), merged_skills(t, g))


LEARN = f"""{OFFERS}, {CASES}, lc AS (SELECT value AS term, count(*) AS count, arg_min({D.P['cert']}, gf.jd_id)[1:200] AS example FROM gf JOIN it ON it.jd_id = gf.jd_id WHERE field = 'skills' AND reason IS NULL AND value NOT IN ({TAX})
 AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.jd_id = gf.jd_id AND kw.term = value) GROUP BY 1)"""


def learned(t):
    keywords = ex.jd_keywords(c.postings(t), top_n=None, alternatives=False)
    return gr.learned_candidates(gr.verified_skills(grounded(t)), keywords)


@query("learned_candidates", f"WITH {LEARN} SELECT term, count, example FROM lc")
def learned_candidates(t):
    return learned(t)


@query("promote_reject_terms", f"WITH {LEARN} SELECT term, count, 'approved' AS list FROM lc UNION ALL SELECT 'horeca', NULL, 'approved'")
def promote_reject_terms(t):
    found = materialize(learned(t), "learned")
    known = t.spark.createDataFrame([("horeca",)], "term string")
    grown, left = gr.promote_terms(found, known, found.select("term", F.lit("promote").alias("decision")))
    listed = grown.join(found.select("term", "count"), "term", "left").withColumn("list", F.lit("approved"))
    return listed.unionByName(left.select("term", "count", F.lit("candidate").alias("list")))


CACHE_KEY = "sha256('v1' || chr(0) || lang || chr(0) || 'h' || chr(0) || text || chr(0))"


@query("answer_cache_lookup", f"""WITH d AS (SELECT doc_id, source, {CACHE_KEY} AS cache_key FROM documents), ca AS (SELECT cache_key, min('answer of ' || source) AS answer FROM d WHERE source IN ('src1', 'src2', 'src3') GROUP BY 1)
 SELECT doc_id, d.cache_key, answer, answer IS NULL AS pending FROM d LEFT JOIN ca ON ca.cache_key = d.cache_key""")
def answer_cache_lookup(t):
    """Three sources have been answered; copies of their texts elsewhere are hits."""
    docs = t.documents.select("doc_id", "source", gr.cache_key(F.col("text"), F.col("lang"), F.lit("h"), F.lit("v1")).alias("cache_key"))
    cache = docs.where(F.col("source").isin("src1", "src2", "src3")).select("cache_key", F.concat(F.lit("answer of "), "source").alias("answer"))
    return gr.answer_cache_lookup(docs.drop("source"), cache)


ID = "md5('t' || CAST({k} AS STRING))"
REPLY = f"""SELECT CASE WHEN {K} % 4 = 3 THEN 'sorry' ELSE '{{"' || {ID.format(k=K)} || '": {{"a": 1}}, "' || {ID.format(k=f'(2 * {K} + 1)')} || '": {{"a": 2}}, "note": "x"}}' END AS raw FROM part"""


@query("match_pasted_answers", f"""WITH w AS (SELECT DISTINCT {ID.format(k=K)} AS task_id FROM part), g AS (SELECT {ID.format(k=K)} AS task_id FROM part WHERE {K} % 4 <> 3 UNION SELECT {ID.format(k=f'(2 * {K} + 1)')} FROM part WHERE {K} % 4 <> 3)
 SELECT coalesce(w.task_id, g.task_id) AS task_id, CASE WHEN w.task_id IS NULL THEN 'unknown' WHEN g.task_id IS NULL THEN 'missing' ELSE 'answered' END AS status FROM w FULL JOIN g ON g.task_id = w.task_id""")
def match_pasted_answers(t):
    return gr.match_pasted_answers(t.sql(f"SELECT {ID.format(k=K)} AS task_id FROM part"), t.sql(REPLY))


# ---------------------------------------------------------------- rewrites

VARIANT = "(candidate_id + 3 * role_no + bullet_no) % 9"
REWRITE = f"""CASE {VARIANT} WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN replace(replace(text, '25+', 'many'), '12', 'some') WHEN 3 THEN text || ' in 99 days' WHEN 4 THEN substr(text, 1, 8)
 WHEN 5 THEN text || ' ' || text || ' ' || text || ' ' || text WHEN 6 THEN replace(text, 'SQL', 'Tableau') WHEN 7 THEN 'Delivered: ' || text ELSE text || ' using Excel [99]' END"""
RW_SQL = f"""{BULLET_ORACLE}, rw AS (SELECT *, {REWRITE} AS rewrite FROM bullet)"""


def rewrites(t):
    c.bullets(t).createOrReplaceTempView("bullet_rows")
    return t.spark.sql(f"SELECT *, {REWRITE} AS rewrite FROM bullet_rows")


NUMS = r"list_distinct(list_transform(regexp_extract_all(regexp_replace({x}, '\[[^\]]*\]', '', 'g'), '[0-9][0-9,]*(?:\.[0-9]+)?[%+]?'), lambda n: replace(n, ',', '')))"
TEXT_SKILLS = f"""tx AS (SELECT DISTINCT text FROM (SELECT text FROM rw UNION ALL SELECT rewrite FROM rw)), h AS (SELECT text, replace(replace(lower(text), 'k8s', 'kubernetes'), 'a/b tests', 'a/b testing') AS hay FROM tx),
 a AS (SELECT text, unnest(list_filter({MULTI}, lambda m: contains(hay, m))) AS term FROM h), b AS (SELECT text, {FOLD} AS term FROM (SELECT text, unnest(regexp_extract_all(hay, {SKILL_RE})) AS lw FROM h)),
 w AS (SELECT text, generate_subscripts(l, 1) AS i, unnest(l) AS tok FROM (SELECT text, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+.#/-]{{1,}}') AS l FROM h)),
 x AS (SELECT text, tok, lag(lower(tok)) OVER (PARTITION BY text ORDER BY i) AS prev FROM w),
 d AS (SELECT text, {alias_case('lower(tok)')} AS term FROM x WHERE regexp_full_match(tok, '[A-Z]{{2,6}}') AND NOT list_contains({MULTI}, coalesce(prev, '?') || ' ' || lower(tok))),
 sk AS (SELECT text, list(DISTINCT term) AS skills FROM (SELECT text, term FROM a UNION SELECT text, term FROM b WHERE term IN ({TAX}) UNION SELECT text, term FROM d) WHERE term NOT IN ('us','uk','eu','am','pm','ok','no','id','go') GROUP BY text)"""
MINUS = "len(list_filter({a}, lambda i: NOT list_contains({b}, i))) > 0"


@query("verify_rewrite", f"""WITH {RW_SQL}, {TEXT_SKILLS}, j AS (SELECT rw.*, {NUMS.format(x='rw.text')} AS n0, {NUMS.format(x='rw.rewrite')} AS n1, coalesce(s0.skills, []) AS s0, coalesce(s1.skills, []) AS s1, list_transform(rw.skills, lambda t: {alias_case('t')}) AS allowed,
  length(trim(rewrite)) / greatest(1, length(rw.text))::DOUBLE AS ratio FROM rw LEFT JOIN sk s0 ON s0.text = rw.text LEFT JOIN sk s1 ON s1.text = rw.rewrite)
 SELECT candidate_id, role_no, bullet_no, CASE WHEN trim(rewrite) = '' THEN 'empty rewrite' WHEN lower(trim(rewrite)) = lower(text) THEN 'no change' WHEN ratio < 0.4 THEN 'truncates the bullet' WHEN ratio > 3.0 THEN 'balloons the bullet'
  WHEN {MINUS.format(a='n0', b='n1')} THEN 'lost number' WHEN {MINUS.format(a='n1', b='n0')} THEN 'added number' WHEN {MINUS.format(a='s0', b='s1')} THEN 'lost skill' WHEN {MINUS.format(a='s1', b='list_concat(s0, allowed)')} THEN 'introduced skill' END AS problem FROM j""")
def verify_rewrite(t):
    return rewrites(t).select("candidate_id", "role_no", "bullet_no", vf.rewrite_problem(F.col("text"), F.col("rewrite"), F.col("skills")).alias("problem"))


CLAIMED = ("bi", "sql", "data", "warehouse", "postgresql", "test")


@query("tag_claims", f"""WITH {BULLET_ORACLE}, k AS (SELECT candidate_id, role_no, bullet_no, list_transform(skills, lambda t: {alias_case('t')}) AS tags, unnest({list(CLAIMED)}) AS term FROM bullet)
 SELECT candidate_id, role_no, bullet_no, term FROM k WHERE len(list_filter(tags, lambda x: regexp_matches(' ' || x || ' ', '[^a-z0-9]' || term || CASE WHEN length(term) <= 2 THEN '' ELSE 's?' END || '[^a-z0-9]'))) > 0""")
def tag_claims(t):
    terms = ar.unnest(c.bullets(t), ["candidate_id", "role_no", "bullet_no", "skills"], F.array(*map(F.lit, CLAIMED)), "term")
    return terms.where(vf.tag_claims(F.col("skills"), F.col("term"))).drop("skills")


WANTED = ("sql", "excel", "power bi", "tableau", "spark", "jira", "forecasting", "data warehouse")


@query("truthful_rewording")
def truthful_rewording(t):
    terms = F.array(*map(F.lit, WANTED))
    return rewrites(t).select("candidate_id", "role_no", "bullet_no", vf.truthful_problem(F.col("text"), F.col("text"), F.col("rewrite"), F.col("skills"), terms).alias("problem"))


@query("plausible_targets")
def plausible_targets(t):
    rows = c.bullets(t).withColumn("missing", F.array(*map(F.lit, WANTED)))
    return vf.plausible_targets(rows, ["candidate_id", "role_no", "bullet_no"])


CITED = "CASE (candidate_id + bullet_no) % 4 WHEN 0 THEN upper(substr(text, 5, 30)) WHEN 1 THEN replace(text, 'e', 'a') WHEN 2 THEN 'never written' ELSE '\"' || text || '\"' END"


@query("match_quoted_bullet", f"""WITH {BULLET_ORACLE}, q AS (SELECT candidate_id, role_no, bullet_no AS quote_id, lower(trim({CITED})) AS q FROM bullet),
 p AS (SELECT q.candidate_id, q.role_no, quote_id, b.bullet_no, q.q, lower(b.text) AS t, lower(b.text)[1:length(q.q) + 60] AS h FROM q JOIN bullet b ON b.candidate_id = q.candidate_id AND b.role_no = q.role_no),
 s AS (SELECT *, CASE WHEN contains(t, q) OR contains(q, t) THEN 2.0 ELSE 1 - levenshtein(q, h) / greatest(length(q), length(h))::DOUBLE END AS ratio FROM p)
 SELECT candidate_id, role_no, quote_id, arg_max(bullet_no, (ratio, -bullet_no)) AS bullet_no, max(ratio) AS ratio FROM s WHERE ratio >= 0.75 GROUP BY 1, 2, 3""")
def match_quoted_bullet(t):
    c.bullets(t).createOrReplaceTempView("bullet_rows")
    quotes = t.spark.sql(f"SELECT candidate_id, role_no, bullet_no AS quote_id, {CITED} AS quote FROM bullet_rows")
    return vf.match_quoted_bullet(quotes, c.bullets(t), ["candidate_id", "role_no"])


@query("apply_accepted", f"""WITH {RW_SQL} SELECT candidate_id, role_no, bullet_no, CASE WHEN ok THEN rewrite ELSE text END AS final_text, ok AS rewritten FROM (
 SELECT *, coalesce(CASE candidate_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, bullet_no % 2 = 0) AND {VARIANT} IN (3, 7) AS ok FROM rw)""")
def apply_accepted(t):
    rows = rewrites(t)
    decided = F.when(F.col("candidate_id") % 3 == 0, True).when(F.col("candidate_id") % 3 == 1, False)
    ids = ["candidate_id", "role_no", "bullet_no"]
    offered = rows.where(F.expr(VARIANT).isin(3, 7)).select(*ids, "rewrite", F.lit(1).alias("proposal_id"), decided.alias("accepted"),
                                                          F.when(F.col("bullet_no") % 2 == 0, "gap-rewording").otherwise("manager-rewrite").alias("source"))
    return vf.apply_accepted(rows.drop("rewrite"), offered, ids, auto_accept=True).select(*ids, "final_text", "rewritten")
