"""Text scalars, sources and sinks over the driver's tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import dates as dt
from hiresift.functions import terms as tm
from hiresift.functions import text as tx
from hiresift.functions import arrays as ar
from hiresift.operators import extract as ex
from hiresift.operators import requirements as rq
from hiresift.plans import common as c
from hiresift.plans import derived as D
from hiresift.session import checkpoint_dir
from hiresift.sources import applications as ap
from hiresift.sources import bank as bk
from hiresift.sources import corpus as cp
from hiresift.sources import profiles as pf

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def scratch(t, name):
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


POSTING_LINES = c.oracle_lines(f"({D.POSTING})", "jd_id", "jd_text")
RESUME_LINES = c.oracle_lines(f"({D.RESUME})", "candidate_id", "text")
DOC_LINES = c.oracle_lines("documents", "doc_id", "text")

# ---------------------------------------------------------------- sources


@query("scan_text_corpus", "SELECT item_id AS id, text FROM benchmark")
def scan_text_corpus(t):
    """One .txt file per posting passage, read back whole."""
    folder = scratch(t, "corpus")
    t.benchmark.select("text", F.col("item_id").alias("d")).repartition("d").write.partitionBy("d").option("lineSep", "\x00").text(folder)
    read = cp.scan_text_corpus(t.spark, folder)
    return read.select(F.regexp_extract("path", "/d=([0-9]+)/", 1).cast("bigint").alias("id"), F.rtrim("text", F.lit("\x00")).alias("text"))


HTML_ORACLE = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<svg[^>]*>.*?</svg>', ' ', 'g') AS h FROM pages),
 b AS (SELECT page_id, regexp_replace(h, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/section)[^>]*>', chr(10), 'g') AS h FROM a),
 d AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]+>', ' ', 'g') AS h FROM b),
 e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS h FROM d),
 l AS (SELECT page_id, generate_subscripts(string_split(h, chr(10)), 1) AS n, unnest(string_split(h, chr(10))) AS x FROM e),
 k AS (SELECT page_id, n, trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(160)) AS x FROM l)
SELECT page_id, string_agg(x, chr(10) ORDER BY n) AS body FROM k WHERE x <> '' GROUP BY page_id"""


@query("html_to_text", HTML_ORACLE)
def html_to_text(t):
    return t.pages.select("page_id", tx.html_to_text(F.col("html")).alias("body"))


LABELLED = f"""SELECT CAST(p_partkey AS STRING) AS id, CASE p_partkey % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'software' ELSE '' END AS domain,
 CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE {D.P['title']} END AS jd,
 CASE p_partkey % 5 WHEN 0 THEN '["sql", "python"]' WHEN 1 THEN '[]' WHEN 2 THEN '["sql"]' WHEN 3 THEN '["power bi"]' ELSE '["dax", "excel", "r"]' END AS required,
 CASE p_partkey % 7 WHEN 0 THEN 'null' WHEN 1 THEN '[1, 2]' ELSE '[50000, 60000, "USD"]' END AS salary, p_partkey % 11 AS odd FROM part"""


def labelled(t):
    """Label rows written as JSON lines and loaded through the corpus reader."""
    body = F.concat(
        F.lit('{"id": "'), "id", F.lit('", "domain": "'), "domain", F.lit('", "jd": "'), "jd", F.lit('", "expected": {"required_terms": '), "required",
        F.lit(', "salary": '), "salary", F.when(F.col("odd") == 0, ', "colour": "red"').otherwise(""), F.lit("}}"))
    folder = scratch(t, "labels")
    t.sql(LABELLED).select(body.alias("value")).write.text(folder)
    return cp.load_labelled_corpus(t.spark, folder)


@query("load_labelled_corpus", f"""SELECT id, domain, jd, required AS required_terms, CASE WHEN odd = 0 THEN 3 ELSE 2 END AS n_fields FROM ({LABELLED})""")
def load_labelled_corpus(t):
    required = F.array_join(F.transform(F.from_json(F.try_element_at(F.col("expected"), F.lit("required_terms")), "array<string>"),
                                        lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    return labelled(t).select("id", "domain", "jd", F.concat(F.lit("["), required, F.lit("]")).alias("required_terms"), F.size("expected").alias("n_fields"))


@query("validate_corpus", f"""SELECT id, 'empty jd' AS problem FROM ({LABELLED}) WHERE trim(jd) = ''
 UNION ALL SELECT id, 'unknown expected key colour' FROM ({LABELLED}) WHERE odd = 0
 UNION ALL SELECT id, 'salary must be [min, max, currency] or null' FROM ({LABELLED}) WHERE salary = '[1, 2]'
 UNION ALL SELECT id, 'required_terms must list at least one term' FROM ({LABELLED}) WHERE required = '[]'""")
def validate_corpus(t):
    return cp.validate_corpus(labelled(t))


@query("scan_applications", f"""SELECT app_id, CAST(applied_date AS VARCHAR) AS applied_date, company, outcome, ats_score FROM ({D.APPLICATION}) ORDER BY applied_date DESC, app_id DESC LIMIT 50""")
def scan_applications(t):
    return ap.scan_applications(c.applications(t)).select("app_id", F.col("applied_date").cast("string").alias("applied_date"), "company", "outcome", "ats_score")


@query("export_applications_csv", f"""SELECT app_id AS id, CAST(applied_date AS VARCHAR) AS applied_date, company, outcome,
 CASE WHEN outcome IN ('recruiter_call', 'interview', 'offer') THEN 1 ELSE 0 END AS reached_human, nullif(components, '') AS components_json, visibility_score FROM ({D.APPLICATION})""")
def export_applications_csv(t):
    folder = scratch(t, "export")
    ap.export_applications_csv(c.applications(t), folder)
    schema = ("id bigint, applied_date string, company string, role string, resume_version string, ats_score double, recruiter_score double, "
              "manager_score double, days_after_posting int, outcome string, outcome_date string, reached_human int, notes string, visibility_score double, components_json string")
    back = t.spark.read.schema(schema).option("header", True).option("escape", '"').csv(folder)
    return back.select("id", "applied_date", "company", "outcome", "reached_human", F.nullif("components_json", F.lit("")).alias("components_json"), "visibility_score")


@query("report_json_sink")
def report_json_sink(t):
    folder = scratch(t, "reports")
    cp.write_reports(c.applications(t).select("app_id", F.struct("ats_score", "visibility_score").alias("scores"), F.struct("outcome", "applied_date").alias("log")), folder)
    back = t.spark.read.schema("app_id bigint, scores struct<ats_score:double,visibility_score:double>, log struct<outcome:string,applied_date:string>").json(folder)
    return back.select("app_id", "scores.ats_score", "scores.visibility_score", "log.outcome", "log.applied_date")


ORACLES["report_json_sink"] = f"SELECT app_id, ats_score, visibility_score, outcome, CAST(applied_date AS VARCHAR) AS applied_date FROM ({D.APPLICATION})"


@query("evolve_log_schema", f"""SELECT app_id, company, CAST(NULL AS DOUBLE) AS visibility_score, CAST(NULL AS VARCHAR) AS components, 'old' AS era FROM ({D.APPLICATION})
 UNION ALL SELECT app_id, company, visibility_score, components, 'new' FROM ({D.APPLICATION})""")
def evolve_log_schema(t):
    apps = c.applications(t)
    old = ap.evolve(ap.evolve(apps.drop("visibility_score", "components")))
    both = ap.union_logs(old.withColumn("jd_text", F.lit("old")), apps.withColumn("jd_text", F.lit("new")))
    return both.select("app_id", "company", "visibility_score", "components", F.col("jd_text").alias("era"))


PROFILE_TYPED = f"""SELECT candidate_id, TRY_CAST(nullif(trim(years_experience), '') AS DOUBLE) AS years_experience, trim(current_title) AS current_title,
 trim(education_level) AS education_level, location, work_authorization, salary_currency,
 CASE WHEN lower(open_to_relocation) IN ('true','yes','y','1','on') THEN true WHEN lower(open_to_relocation) IN ('false','no','n','0','off') THEN false END AS open_to_relocation,
 list_filter(list_transform(regexp_split_to_array(certifications, '[\\n,;]+'), lambda x: trim(x)), lambda x: x <> '') AS certifications,
 list_filter(list_transform(regexp_split_to_array(lower(acceptable_work_modes), '[\\n,;]+'), lambda x: trim(x)), lambda x: x <> '') AS acceptable_work_modes,
 list_filter(list_transform(regexp_split_to_array(work_authorized_in, '[\\n,;]+'), lambda x: trim(x)), lambda x: x <> '') AS work_authorized_in,
 CAST(trunc(TRY_CAST(nullif(trim(notice_period_days), '') AS DOUBLE)) AS INTEGER) AS notice_period_days,
 TRY_CAST(nullif(trim(expected_salary_min), '') AS DOUBLE) AS expected_salary_min, TRY_CAST(nullif(trim(expected_salary_max), '') AS DOUBLE) AS expected_salary_max
 FROM ({D.PROFILE_RAW})"""


@query("coerce_profiles", f"""SELECT candidate_id, years_experience, open_to_relocation, notice_period_days, expected_salary_min, expected_salary_max, education_level,
 array_to_string(certifications, '|') AS certifications, array_to_string(acceptable_work_modes, '|') AS acceptable_work_modes, array_to_string(work_authorized_in, '|') AS work_authorized_in FROM ({PROFILE_TYPED})""")
def coerce_profiles(t):
    lists = ("certifications", "acceptable_work_modes", "work_authorized_in")
    return c.profiles(t).select("candidate_id", "years_experience", "open_to_relocation", "notice_period_days", "expected_salary_min", "expected_salary_max", "education_level",
                                *[c.joined(n).alias(n) for n in lists])


@query("validate_profiles", f"""WITH p AS ({PROFILE_TYPED})
 SELECT candidate_id, 'education_level is not a known level' AS problem FROM p WHERE education_level <> '' AND lower(education_level) NOT IN ('high_school','diploma','bachelors','masters','mba','phd')
 UNION ALL SELECT candidate_id, 'acceptable_work_modes holds an unknown mode' FROM p WHERE len(list_filter(acceptable_work_modes, lambda m: m NOT IN ('remote','hybrid','onsite'))) > 0
 UNION ALL SELECT candidate_id, 'years_experience must be between 0 and 60' FROM p WHERE years_experience < 0 OR years_experience > 60
 UNION ALL SELECT candidate_id, 'notice_period_days must be between 0 and 365' FROM p WHERE notice_period_days < 0 OR notice_period_days > 365
 UNION ALL SELECT candidate_id, 'expected salary can''t be negative' FROM p WHERE expected_salary_min < 0 OR expected_salary_max < 0
 UNION ALL SELECT candidate_id, 'expected_salary_min is above expected_salary_max' FROM p WHERE expected_salary_min > expected_salary_max""")
def validate_profiles(t):
    return pf.validate_profiles(c.profiles(t))


START = """CASE WHEN regexp_full_match(start, '\\d{4}-\\d{2}') THEN CAST(start[1:4] AS INT) * 12 + CAST(start[6:7] AS INT)
 WHEN starts_with(start, 'Mar') THEN CAST(start[5:8] AS INT) * 12 + 3 ELSE CAST(start AS INT) * 12 + 1 END"""
BULLET_ORACLE = f"""bullet AS (SELECT candidate_id, role_no, company, title, lower("end") IN ('', 'present') AS is_current, {START} AS start_month,
 dense_rank() OVER (PARTITION BY candidate_id ORDER BY CASE WHEN lower("end") IN ('', 'present') THEN 0 ELSE 1 END, -({START}), role_no) AS role_rank,
 row_number() OVER (PARTITION BY candidate_id, role_no ORDER BY bullet_no) AS bullet_no, trim(text) AS text,
 list_filter(list_transform(string_split(tags, ';'), lambda x: lower(trim(x))), lambda x: x <> '') AS skills, lower(reviewed) IN ('true','yes','y','1','on') AS reviewed
 FROM ({D.BANK_FLAT_ORACLE}) WHERE trim(text) <> '')"""


@query("flatten_evidence_bank", f"""WITH {BULLET_ORACLE} SELECT candidate_id, role_rank, role_no, bullet_no, company, is_current, start_month, text, array_to_string(skills, '|') AS skills, reviewed FROM bullet""")
def flatten_evidence_bank(t):
    return c.bullets(t).select("candidate_id", "role_rank", "role_no", "bullet_no", "company", "is_current", "start_month", "text", c.joined("skills").alias("skills"), "reviewed")


@query("validate_bank", f"""WITH {BULLET_ORACLE}, b AS (SELECT {D.C} AS candidate_id, {D.BANK_CONTACT['email']} AS email, {D.BANK_CONTACT['phone']} AS phone, {D.BANK_CONTACT['headline']} AS headline FROM customer)
 SELECT candidate_id, false AS fatal, 'no email' AS problem FROM b WHERE email = '' UNION ALL SELECT candidate_id, false, 'no phone' FROM b WHERE phone = ''
 UNION ALL SELECT candidate_id, false, 'no headline' FROM b WHERE headline = ''""")
def validate_bank(t):
    return bk.validate_bank(c.banks(t))


@query("parse_month", f"""SELECT candidate_id, role_no, start, "end", {START} AS start_month,
 CASE WHEN contains("end", '/') THEN CAST("end"[1:4] AS INT) * 12 + CAST("end"[6:7] AS INT) END AS end_month FROM (SELECT DISTINCT candidate_id, role_no, start, "end" FROM ({D.BANK_FLAT_ORACLE}))""")
def parse_month(t):
    roles = F.transform("roles", lambda r, i: F.struct(
        (i + 1).alias("role_no"), r["start"].alias("start"), r["end"].alias("end"), dt.parse_month(r["start"]).alias("start_month"), dt.parse_month(r["end"]).alias("end_month")))
    return ar.unpack(c.banks(t), ["candidate_id"], roles, "role_no")


# ---------------------------------------------------------------- scalars


@query("explode_lines", f"SELECT doc_id, line_no, line FROM ({DOC_LINES})")
def explode_lines(t):
    kept = F.transform(tx.kept_lines(F.col("text")), lambda s: F.struct(s["line_no"].alias("line_no"), s["line"].alias("line")))
    return ar.unpack(t.documents, ["doc_id"], kept, "line")


def section_case(line: str) -> str:
    lower = f"trim(rtrim(lower({line}), ':'))"
    words = f"list_filter(regexp_extract_all({line}, '[A-Za-z'']+'), lambda w: length(w) >= 4)"
    head = (f"(length({lower}) < 40 AND (ends_with({line}, ':') OR (len({words}) > 0 AND ("
            f"({line} = upper({line}) AND {line} <> lower({line})) OR len(list_filter({words}, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0))))")
    arms = []
    for section, patterns in V.SECTION_HEADERS.items():
        alt = "|".join(patterns).replace("'", "''")
        arms.append(f"WHEN regexp_full_match({lower}, '(?:{alt})') OR ({head} AND regexp_matches({lower}, '(?:{alt})')) THEN '{section}'")
    bullet = ex.BULLET_START.replace("'", "''")
    return f"CASE WHEN regexp_matches({line}, '{bullet}') THEN NULL " + " ".join(arms) + " END"


SECTIONED = f"""sec AS (SELECT jd_id, line_no, line, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY jd_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'default') AS section
 FROM (SELECT jd_id, line_no, line, {section_case('line')} AS opens FROM ({POSTING_LINES})))"""


@query("classify_sections", f"WITH {SECTIONED} SELECT jd_id, line_no, line, section FROM sec")
def classify_sections(t):
    return ex.posting_lines(c.postings(t))


SHOUT = "(len(regexp_extract_all({l}, '[A-Za-z]{{2,}}')) >= 3 AND len(list_filter(regexp_extract_all({l}, '[A-Za-z]{{2,}}'), lambda w: w = upper(w))) * 10 >= len(regexp_extract_all({l}, '[A-Za-z]{{2,}}')) * 7)"


@query("detect_shouting", f"SELECT doc_id, line_no FROM ({DOC_LINES}) WHERE {SHOUT.format(l='line')}")
def detect_shouting(t):
    shouted = F.filter(tx.kept_lines(F.col("text")), lambda s: tx.is_shouting(s["line"]))
    return ar.unpack(t.documents, ["doc_id"], F.transform(shouted, lambda s: F.struct(s["line_no"].alias("line_no"))), "line_no")


# a lookahead has no RE2 form: the separator after the region code is captured and put back
CLAUSES = r"""regexp_split_to_array(regexp_replace(line, ',\s*[A-Z]{2}(\s*[-|(–—,]|\s*$)', '\1', 'g'), '[;()]|,\s|\s[-–—]\s')"""
CLAUSE_CTE = f"cl AS (SELECT jd_id, line_no, section, line, generate_subscripts({CLAUSES}, 1) AS clause_no, unnest({CLAUSES}) AS clause FROM sec)"


@query("split_clauses", f"WITH {SECTIONED}, {CLAUSE_CTE} SELECT jd_id, line_no, clause_no, clause FROM cl")
def split_clauses(t):
    rows = F.flatten(F.transform(tx.kept_lines(F.col("jd_text")), lambda s: F.transform(tx.clauses(s["line"]), lambda x, i: F.struct(
        s["line_no"].alias("line_no"), (i + 1).alias("clause_no"), x.alias("clause")))))
    return ar.unpack(c.postings(t), ["jd_id"], rows, "clause_no")


@query("tokenize", r"""SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, rtrim(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+.#/&-]{1,}')), '+.#/&-') AS token FROM documents) WHERE token <> '' GROUP BY ALL""")
def tokenize(t):
    return ar.unnest(t.documents, ["doc_id"], tx.tokens(F.col("text")), "token").groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("word_frequencies", r"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9+.#/-]{1,}')) AS token FROM documents) GROUP BY token""")
def word_frequencies(t):
    return ar.unnest(t.documents, [], tx.frequency_tokens(F.col("text")), "token").groupBy("token").agg(F.count("*").alias("n"))


def alias_case(term: str) -> str:
    return f"CASE {term} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.ALIASES.items()) + f" ELSE {term} END"


TAGS = f"SELECT candidate_id, role_no, bullet_no, unnest(string_split(tags, ';')) AS raw FROM ({D.BANK_FLAT_ORACLE})"


def raw_tags(t):
    rows = F.flatten(F.transform("roles", lambda r, i: F.flatten(F.transform(r["bullets"], lambda b, j: F.transform(b["skills"], lambda s: F.struct(
        (i + 1).alias("role_no"), (j + 1).alias("bullet_no"), s.alias("raw")))))))
    return ar.unpack(c.banks(t), ["candidate_id"], rows, "raw")


@query("canonical_term", f"SELECT candidate_id, role_no, bullet_no, raw, {alias_case('lower(trim(raw))')} AS term FROM ({TAGS})")
def canonical_term(t):
    return raw_tags(t).withColumn("term", tm.canonical(F.col("raw")))


@query("alias_normalize")
def alias_normalize(t):
    return c.resumes(t).select("candidate_id", tm.searchable(F.col("text")).alias("normalized"))


TAX = ", ".join(f"'{x}'" for x in V.STARTER_TAXONOMY)


@query("plural_fold", f"""WITH w AS (SELECT DISTINCT jd_id, unnest(regexp_extract_all(lower(jd_text), '[a-z][a-z0-9+.#/&-]+')) AS token FROM ({D.POSTING}))
 SELECT jd_id, token, CASE WHEN length(token) > 3 AND ends_with(token, 's') AND token[:-2] IN ({TAX}) THEN token[:-2] ELSE token END AS folded FROM w""")
def plural_fold(t):
    words = F.array_distinct(tx.find_all(F.lower("jd_text"), "[a-z][a-z0-9+.#/&-]+"))
    return ar.unnest(c.postings(t), ["jd_id"], words, "token").withColumn("folded", tm.plural_fold(F.col("token")))


@query("term_match", r"""WITH d AS (SELECT doc_id, ' ' || lower(text) || ' ' AS x FROM documents), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark)
 SELECT doc_id, term FROM d, w WHERE contains(x, term) AND regexp_matches(x, '[^a-z0-9]' || term || CASE WHEN ends_with(term, 's') THEN '' ELSE 's?' END || '[^a-z0-9]')""")
def term_match(t):
    words = ar.unnest(t.benchmark, [], tx.find_all(F.lower("text"), "[a-z]{6,}"), "term").distinct()
    return tm.term_index(t.documents, ["doc_id"], F.lower("text"), words, tm.PLAIN_WORDS)


@query("normalize_for_quote", r"""SELECT doc_id, trim(regexp_replace(translate(lower(text), '‘’“”"`–—−' || chr(39), '          '), '[^\p{L}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}+#&$₹£€%]+', ' ', 'g')) AS norm FROM documents""")
def normalize_for_quote(t):
    return t.documents.select("doc_id", tx.normalize_quote(F.col("text")).alias("norm"))


@query("ascii_safe", """SELECT doc_id, replace(translate(text, '‐‑‒–—―‘’“”' || chr(160) || '−', '------' || chr(39) || chr(39) || '"" -'), '…', '...') AS plain FROM documents""")
def ascii_safe(t):
    return t.documents.select("doc_id", tx.ascii_safe(F.col("text")).alias("plain"))


def display_sql(term: str) -> str:
    arms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.DISPLAY.items())
    titled = f"array_to_string(list_transform(list_filter(string_split({term}, ' '), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    return f"CASE {term} {arms} ELSE CASE WHEN length({term}) <= 3 AND regexp_matches({term}, '^[a-z]+$') THEN upper({term}) ELSE {titled} END END"


@query("display_case", f"WITH g AS (SELECT DISTINCT candidate_id, {alias_case('lower(trim(raw))')} AS term FROM ({TAGS})) SELECT candidate_id, term, {display_sql('term')} AS shown FROM g WHERE term <> ''")
def display_case(t):
    terms = raw_tags(t).select("candidate_id", tm.canonical(F.col("raw")).alias("term")).where("term <> ''").distinct()
    return terms.withColumn("shown", tx.display_case(F.col("term")))


BAND = "CASE WHEN {s} IS NULL THEN 'Not scored' WHEN {s} >= 80 THEN 'Strong' WHEN {s} >= 60 THEN 'Workable' WHEN {s} >= 40 THEN 'Weak' ELSE 'Very weak' END"


@query("score_band", f"SELECT app_id, ats_score, {BAND.format(s='ats_score')} AS band FROM ({D.APPLICATION})")
def score_band(t):
    return t.sql(D.APPLICATION).select("app_id", "ats_score", tx.score_band(F.col("ats_score")).alias("band"))


@query("extract_numbers", r"""SELECT doc_id, array_to_string(list_sort(list_transform(regexp_extract_all(regexp_replace(text, '\[[^\]]*\]', '', 'g'), '[0-9][0-9,]*(?:\.[0-9]+)?[%+]?'), lambda n: replace(n, ',', ''))), '|') AS numbers FROM documents""")
def extract_numbers(t):
    return t.documents.select("doc_id", F.array_join(tx.numbers(tx.without_placeholders(F.col("text"))), "|").alias("numbers"))


@query("lines_cost", r"""SELECT doc_id, greatest(1, CAST(ceil(len(list_filter(regexp_split_to_array(text, '[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}\x0b\x1c-\x1f\x{85}]+'), lambda w: w <> '')) / 12.0) AS INT)) AS cost FROM documents""")
def lines_cost(t):
    return t.documents.select("doc_id", tx.lines_cost(F.col("text")).alias("cost"))


# RE2 has no lookahead: 'staff' is a level only before an engineering word, 'lead' only as the first word before another word
LADDER = "(\\s+(?:\\w+\\s+)?(?:engineer|scientist|developer|architect|designer))"
TITLE_SQL = rf"""SELECT {{key}}, line, CASE WHEN t <> '' AND len(string_split(t, ' ')) <= 6 AND regexp_matches(t, '{tx.ROLE_NOUN}') THEN t ELSE '' END AS title FROM (
 SELECT {{key}}, line, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,
  '(?i)\bstaff\b{LADDER}', ' \1', 'g'), '(?i)^\s*lead(\s+\w)', ' \1', 'g'), '(?i)\b(?:senior|sr\.?|junior|jr\.?|principal|trainee|entry[\s-]level|mid[\s-]level|[iv]{{{{1,3}}}})\b\.?', ' ', 'g'),
  '[^A-Za-z0-9&/+.# ]', ' ', 'g'), '\s+', ' ', 'g'))) AS t FROM (
 SELECT {{key}}, line, regexp_split_to_array(regexp_replace(regexp_replace(line, '(?i)^\s*(?:job\s*title|role|position)\s*[:\-]\s*', ''), '\(.*?\)|\[.*?\]', ' ', 'g'), '\s[-–—|]\s|\s@\s|,')[1] AS h FROM {{src}}))"""
TITLE_LINES = f"(SELECT jd_id, l_title AS line FROM ({D.POSTING}))"


@query("clean_title", TITLE_SQL.format(key="jd_id", src=TITLE_LINES))
def clean_title(t):
    return c.postings(t).select("jd_id", F.col("l_title").alias("line"), tx.clean_title(F.col("l_title")).alias("title"))


def country_sql(text: str) -> str:
    """List of canonical countries found; the text is padded so that boundaries are plain characters."""
    arms = []
    for country, aliases in V.COUNTRY_ALIASES.items():
        alt = "|".join(a.replace(".", "\\.") for a in aliases)
        arms.append(f"CASE WHEN regexp_matches(' ' || lower({text}) || ' ', '(?:^|[^a-z])(?:{alt})(?:[^a-z]|$)') THEN '{country}' END")
    return f"list_filter([{', '.join(arms)}], lambda x: x IS NOT NULL)"


EXACT_COUNTRY = "CASE {s} " + " ".join(f"WHEN '{a}' THEN '{k}'" for k, al in V.COUNTRY_ALIASES.items() for a in al) + " END"
PLACES = f"SELECT candidate_id, unnest(list_append(string_split(work_authorized_in, ','), location)) AS place FROM ({D.PROFILE_RAW})"


@query("normalize_country", f"SELECT candidate_id, place, coalesce({EXACT_COUNTRY.format(s='lower(trim(place))')}, {country_sql('trim(place)')}[1], lower(trim(place))) AS country FROM ({PLACES})")
def normalize_country(t):
    places = F.concat(F.split("work_authorized_in", ","), F.array("location"))
    return ar.unnest(t.sql(D.PROFILE_RAW), ["candidate_id"], places, "place").withColumn("country", tx.normalize_country(F.col("place")))


URL_PARTS = r"""SELECT id, url, lower(regexp_extract(u, '^[^:]*://([^/?#:]+)', 1)) AS host, list_filter(string_split(regexp_extract(u, '^[^:]*://[^/?#]+([^?#;]*)', 1), '/'), lambda p: p <> '') AS seg
 FROM (SELECT id, url, CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END AS u FROM {src})"""
HOSTS = lambda hs: " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in hs)


def company_url_sql(src: str) -> str:
    generic = ", ".join(f"'{g}'" for g in V.GENERIC_HOST_LABELS)
    sub = " OR ".join(f"ends_with(host, '.{h}')" for h in V.SUBDOMAIN_SLUG_HOSTS)
    name = "array_to_string(list_transform(list_filter(regexp_split_to_array(s, '[-_]+'), lambda w: w <> ''), lambda w: CASE WHEN w = upper(w) AND w <> lower(w) THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ')"
    return f"""SELECT id, url, CASE WHEN host = '' OR {HOSTS(V.BOARD_HOSTS)} THEN NULL WHEN s = '' OR lower(s) IN ({generic}) OR regexp_full_match(s, '[0-9]+') THEN NULL ELSE nullif({name}, '') END AS company FROM (
 SELECT *, regexp_replace(CASE WHEN ({HOSTS(V.PATH_SLUG_HOSTS)}) AND len(seg) > 0 THEN seg[1] WHEN {sub} THEN lab[1]
  WHEN len(lab) >= 3 AND length(lab[-1]) = 2 AND length(lab[-2]) <= 3 THEN lab[-3] WHEN len(lab) >= 2 THEN lab[-2] ELSE lab[1] END, '[^A-Za-z0-9_-]', '', 'g') AS s
 FROM (SELECT *, string_split(host, '.') AS lab FROM ({URL_PARTS.format(src=src)})))"""


ALL_URLS = f"(SELECT page_id AS id, url FROM pages UNION ALL SELECT jd_id AS id, url FROM ({D.POSTING}))"


@query("company_from_url", company_url_sql(ALL_URLS))
def company_from_url(t):
    urls = t.pages.select(F.col("page_id").alias("id"), "url").unionByName(c.postings(t).select(F.col("jd_id").alias("id"), "url"))
    return urls.withColumn("company", tx.company_from_url(F.col("url")))


COMPANY_JD = f"""CASE p_partkey % 5 WHEN 0 THEN 'Acme Analytics' WHEN 1 THEN 'Northwind Retail' WHEN 3 THEN 'Fabrikam Ltd' ELSE NULL END"""


@query("company_from_jd", f"SELECT p_partkey AS jd_id, {COMPANY_JD} AS company FROM part")
def company_from_jd(t):
    return c.postings(t).select("jd_id", tx.company_from_posting(F.col("jd_text")).alias("company"))


@query("default_company_role", f"""SELECT p.p_partkey AS jd_id, coalesce({COMPANY_JD}, u.company) AS company, nullif(k.title, '') AS role FROM part p
 JOIN ({company_url_sql(f"(SELECT jd_id AS id, url FROM ({D.POSTING}))")}) u ON u.id = p.p_partkey JOIN ({TITLE_SQL.format(key='jd_id', src=TITLE_LINES)}) k ON k.jd_id = p.p_partkey""")
def default_company_role(t):
    company = F.coalesce(tx.company_from_posting(F.col("jd_text")), tx.company_from_url(F.col("url")))
    return c.postings(t).select("jd_id", company.alias("company"), F.nullif(tx.clean_title(F.col("l_title")), F.lit("")).alias("role"))


RANK_SQL = "CASE lower(education_level) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.EDUCATION_RANK.items()) + " ELSE 0 END"


@query("seniority_rank", f"""SELECT candidate_id, CASE WHEN current_title LIKE 'Senior%' THEN 4 WHEN current_title LIKE 'Junior%' THEN 1 ELSE 3 END AS seniority_rank FROM ({D.PROFILE_RAW})""")
def seniority_rank(t):
    first = F.regexp_extract("current_title", r"(?i)^(senior|junior)", 1)
    return t.sql(D.PROFILE_RAW).select("candidate_id", rq.seniority_rank(first).alias("seniority_rank"))


@query("education_rank", f"SELECT candidate_id, {RANK_SQL} AS education_rank FROM ({D.PROFILE_RAW})")
def education_rank(t):
    return t.sql(D.PROFILE_RAW).select("candidate_id", rq.education_rank(F.col("education_level")).alias("education_rank"))
