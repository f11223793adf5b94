"""Coverage, searches, ranks and reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import terms as tm
from hiresift.functions import text as tx
from hiresift.operators import extract as ex
from hiresift.operators import match as mt
from hiresift.operators import ranking as rk
from hiresift.plans import common as c
from hiresift.plans import derived as D
from hiresift.operators import screen as sc
from hiresift.plans.q_extract import LISTS, OFFERS
from hiresift.plans.q_screen import ORACLES as SCREEN_ORACLES
from hiresift.plans.q_text import BAND, TITLE_LINES, TITLE_SQL
from hiresift.session import materialize

QUERIES, ORACLES = {}, {}
SCREEN_SQL = SCREEN_ORACLES["screen_scores"]


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def bench_index(t, keywords):
    """(doc_id, term) over every term of the passages; a word of letters beside a-z is found by its parts and symbols."""
    return tm.term_index(t.documents, ["doc_id"], F.lower("text"), keywords.select("term").distinct())


def bench_documents(t, keywords):
    """(doc_id, terms) of every document, those that hold nothing too."""
    held = bench_index(t, keywords).groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    return t.documents.select("doc_id").distinct().join(held, "doc_id", "left")


@query("term_index", f"WITH {c.BENCH_KW}, {c.DOC_INDEX} SELECT doc_id, term FROM idx")
def term_index(t):
    return bench_index(t, c.bench_keywords(t))


COVER = """tot AS (SELECT jd_id, sum(weight) AS tw, count(*) AS n_terms FROM kw GROUP BY 1),
 hit AS (SELECT doc_id, jd_id, sum(weight) AS mw, count(*) AS n_matched FROM idx JOIN kw ON kw.term = idx.term GROUP BY 1, 2),
 cov AS (SELECT doc_id, hit.jd_id, n_matched, n_terms, CAST(mw AS DOUBLE) AS matched_weight, CAST(tw AS DOUBLE) AS total_weight,
  round_even(CAST(mw AS DOUBLE) / CAST(tw AS DOUBLE) * 100, 1) AS score FROM hit JOIN tot ON tot.jd_id = hit.jd_id)"""


@query("keyword_coverage", f"WITH {c.BENCH_KW}, {c.DOC_INDEX}, {COVER} SELECT * FROM cov")
def keyword_coverage(t):
    kw = materialize(mt.merged_keywords(c.bench_keywords(t)), "keywords")
    return rk.coverage_pairs(bench_documents(t, kw), kw, doc="doc_id")


BENCH_SEARCHES = """sg AS (SELECT jd_id, term, row_number() OVER (PARTITION BY jd_id ORDER BY weight DESC, length(term) DESC, term) AS g FROM kw WHERE NOT contains(term, ' ')),
 ng AS (SELECT item_id AS jd_id, coalesce(title, '') AS title, (SELECT count(*) FROM sg WHERE sg.jd_id = item_id AND g <= 6) AS n FROM benchmark LEFT JOIN bti ON bti.jd_id = item_id),
 bs AS (SELECT jd_id, title, unnest([true, true, false, false, true, false]) AS uses, unnest([0, 1, 2, 3, 3, n]) AS k, unnest([0, 1, 2, 3, 3, 4]) AS need, n FROM ng),
 sr AS (SELECT * FROM bs WHERE n >= need AND (title <> '' OR NOT uses)),
 first AS (SELECT doc_id, jd_id, coalesce(min(g) FILTER (idx.term IS NULL), 7) - 1 AS k FROM (SELECT doc_id, sg.* FROM documents, sg WHERE g <= 6) x LEFT JOIN idx USING (doc_id, term) GROUP BY 1, 2),
 vis AS (SELECT d.doc_id, ng.jd_id, count(sr.k) AS n_searches, count(*) FILTER (sr.k <= coalesce(f.k, 0) AND (NOT uses OR h.term IS NOT NULL)) AS n_matched
  FROM (SELECT DISTINCT doc_id FROM documents) d CROSS JOIN ng LEFT JOIN sr ON sr.jd_id = ng.jd_id LEFT JOIN first f ON f.doc_id = d.doc_id AND f.jd_id = ng.jd_id LEFT JOIN idx h ON h.doc_id = d.doc_id AND h.term = ng.title GROUP BY 1, 2)"""


@query("batch_rank", f"""WITH {c.BENCH_KW}, {c.DOC_INDEX}, {BENCH_SEARCHES}, s AS (SELECT *, round_even(n_matched / nullif(n_searches, 0)::DOUBLE * 100, 1) AS score FROM vis)
 SELECT doc_id, jd_id, n_searches, n_matched, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, jd_id) AS rank FROM s) WHERE rank <= 5""")
def batch_rank(t):
    """Flagship: every document against every posting's searches, the five that find it best, unscored postings last."""
    kw = materialize(c.bench_keywords(t), "keywords")
    asked = materialize(c.bench_searches(t, kw), "searches")
    wanted = mt.vocabulary_of_searches(asked)
    return rk.best_postings(bench_documents(t, wanted), asked, doc="doc_id", k=5)


@query("resume_features", r"""WITH f AS (SELECT doc_id, text, lower(text) AS lo, len(list_filter(regexp_split_to_array(text, '[\s\x{a0}\x0b\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+'), lambda w: w <> '')) AS words FROM documents)
 SELECT doc_id, words AS word_count, regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS has_email,
 len(list_filter(regexp_extract_all(text, '[\d()+][\d()+\s.-]{7,}\d'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) > 0 AS has_phone,
 regexp_matches(text, '(?i)(?:https?://|www\.)[^\s,;|]+|\b(?:linkedin|github|gitlab)\.com/[^\s,;|]+') AS has_links,
 array_to_string(list_filter([CASE WHEN NOT regexp_matches(lo, '\bexperience\b|\bemployment history\b') THEN 'experience' END, CASE WHEN NOT regexp_matches(lo, '\beducation\b|\bacademic background\b') THEN 'education' END,
  CASE WHEN NOT regexp_matches(lo, '\bskills\b|\bcore competencies\b') THEN 'skills' END, CASE WHEN NOT regexp_matches(lo, '\b(summary|objective|profile)\b') THEN 'summary' END], lambda x: x IS NOT NULL), '|') AS sections_missing,
 array_to_string(list_filter(['experience', 'education', 'skills', 'summary'], lambda x: NOT list_contains(string_split(sections_missing, '|'), x)), '|') AS sections_found,
 array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+(?:19|20)\d{2}\b') THEN 'Mon YYYY' END, CASE WHEN regexp_matches(text, '\b(?:0?[1-9]|1[0-2])/(?:19|20)\d{2}\b') THEN 'MM/YYYY' END,
  CASE WHEN regexp_matches(text, '\b(?:19|20)\d{2}-(?:0?[1-9]|1[0-2])\b') THEN 'YYYY-MM' END], lambda x: x IS NOT NULL), '|') AS date_styles,
 array_to_string(list_filter([CASE WHEN words < 100 THEN 'few words' END, CASE WHEN NOT has_email THEN 'no email' END, CASE WHEN NOT has_phone THEN 'no phone' END, CASE WHEN NOT has_links THEN 'no profile link' END,
  CASE WHEN contains(date_styles, '|') THEN 'mixed date formats' END, CASE WHEN sections_missing <> '' THEN 'missing sections' END], lambda x: x IS NOT NULL), '|') AS warnings FROM f""")
def resume_features(t):
    f = mt.document_features(t.documents, file_type=None)
    return f.select("doc_id", "word_count", "has_email", "has_phone", "has_links", *[c.joined(n).alias(n) for n in ("sections_missing", "sections_found", "date_styles", "warnings")])


RES_FEATURES = f"""rf AS (SELECT candidate_id, file_type, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, regexp_matches(text, '[a-z0-9]+@example') AS em, len(list_filter(regexp_extract_all(text, '[\\d()+][\\d()+\\s.-]{{7,}}\\d'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) > 0 AS ph,
 regexp_matches(lower(text), '\\bexperience\\b') AS s1, regexp_matches(lower(text), '\\beducation\\b') AS s2, regexp_matches(lower(text), '\\bskills\\b') AS s3, regexp_matches(lower(text), '\\b(summary|objective|profile)\\b') AS s4 FROM ({D.RESUME})),
 rs AS (SELECT *, greatest(0, least(100, 100 - 15 * ((NOT s1)::INT + (NOT s2)::INT + (NOT s3)::INT + (NOT s4)::INT) - 15 * (NOT em)::INT - 10 * (NOT ph)::INT - 20 * (file_type = 'pdf_multicol')::INT - 10 * (file_type = 'docx_tables')::INT - 15 * (words < 100)::INT)) AS fs,
  words >= 100 AND file_type <> 'pdf_multicol' AND em AS safe FROM rf)"""


@query("formatting_score", f"WITH {RES_FEATURES} SELECT candidate_id, words AS word_count, fs AS formatting_score FROM rs")
def formatting_score(t):
    return mt.document_features(c.resumes(t)).select("candidate_id", "word_count", mt.formatting_score().alias("formatting_score"))


@query("parse_gate", f"""WITH {RES_FEATURES} SELECT candidate_id, safe, unnest(['Text extraction', 'Single-column layout', 'No tables', 'Email', 'Phone', 'Standard section headers']) AS name,
 unnest([CASE WHEN words >= 100 THEN 'pass' ELSE 'fail' END, CASE WHEN file_type = 'pdf_multicol' THEN 'fail' ELSE 'pass' END, CASE WHEN file_type = 'docx_tables' THEN 'warn' ELSE 'pass' END,
  CASE WHEN em THEN 'pass' ELSE 'fail' END, CASE WHEN ph THEN 'pass' ELSE 'warn' END, CASE WHEN s1 AND s2 AND s3 THEN 'pass' ELSE 'warn' END]) AS status FROM rs""")
def parse_gate(t):
    return mt.parse_gate(mt.document_features(c.resumes(t)), "candidate_id")


NOT_SEARCHED = ", ".join(f"'{x}'" for x in V.NOT_SEARCHED)
TERM_IN_TITLE = "regexp_matches(' ' || title || ' ', '[^a-z0-9]' || regexp_escape(term) || CASE WHEN ends_with(term, 's') OR length(term) <= 2 THEN '' ELSE 's?' END || '[^a-z0-9]')"
SEARCHABLE = f"""{OFFERS}, tt AS (SELECT jd_id, replace(replace(' ' || title || ' ', ' data engineer ', ' data engineering '), ' qa ', ' quality assurance ').trim() AS title FROM ({TITLE_SQL.format(key='jd_id', src=TITLE_LINES)})),
 se AS (SELECT top.jd_id, term, rank FROM top JOIN tt ON tt.jd_id = top.jd_id WHERE rank <= 40 AND section IN ('hard', 'skills') AND term NOT IN ({NOT_SEARCHED})
  AND NOT (length(term) >= 2 AND contains(array_to_string(list_transform(string_split(title, ' '), lambda w: w[1]), ''), term)) AND NOT (title <> '' AND {TERM_IN_TITLE})),
 st AS (SELECT jd_id, term, row_number() OVER (PARTITION BY jd_id ORDER BY rank) AS n FROM se)"""


@query("searchable_terms", f"WITH {SEARCHABLE} SELECT jd_id, term, n AS position FROM st WHERE n <= 6")
def searchable_terms(t):
    title = tm.searchable(tx.clean_title(F.col("l_title")))
    rows = c.postings(t).select("jd_id", ex.keywords_of(F.col("jd_text"), alternatives=False).alias("keywords"), title.alias("title"))
    terms = ar.let(F.col("title"), lambda x: mt.searchable_terms(F.col("keywords"), x))
    return ar.unpack(rows, ["jd_id"], F.transform(terms, lambda x, i: F.struct(x.alias("term"), (i + 1).alias("position"))), "term")


FAM = "(VALUES " + ", ".join(f"('{x}', {i})" for i, fam in enumerate(V.FAMILIES) for x in fam) + ")"
GROUPS = rf"""{SEARCHABLE.replace(OFFERS, OFFERS + ', ' + LISTS)}, s6 AS (SELECT st.*, f FROM st LEFT JOIN {FAM} fm(ft, f) ON ft = term WHERE n <= 6),
 nm AS (SELECT s6.jd_id, line_no, term FROM s6 JOIN nl ON nl.jd_id = s6.jd_id AND regexp_matches(' ' || x || ' ', '[^a-z0-9]' || regexp_escape(term) || CASE WHEN ends_with(term, 's') OR length(term) <= 2 THEN '' ELSE 's?' END || '[^a-z0-9]')),
 pt AS (SELECT a.jd_id, a.n, min(b.n) AS p FROM s6 a JOIN s6 b ON b.jd_id = a.jd_id AND b.n < a.n AND b.f = a.f JOIN nm x ON x.jd_id = a.jd_id AND x.term = a.term JOIN nm y ON y.jd_id = a.jd_id AND y.term = b.term AND y.line_no = x.line_no GROUP BY 1, 2),
 r1 AS (SELECT s6.jd_id, s6.n, term, coalesce(p, s6.n) AS r FROM s6 LEFT JOIN pt ON pt.jd_id = s6.jd_id AND pt.n = s6.n),
 r2 AS (SELECT a.jd_id, a.n, a.term, b.r FROM r1 a JOIN r1 b ON b.jd_id = a.jd_id AND b.n = a.r), r4 AS (SELECT a.jd_id, a.n, a.term, b.r FROM r2 a JOIN r2 b ON b.jd_id = a.jd_id AND b.n = a.r),
 r8 AS (SELECT a.jd_id, a.n, a.term, b.r FROM r4 a JOIN r4 b ON b.jd_id = a.jd_id AND b.n = a.r), gp AS (SELECT jd_id, n, term, dense_rank() OVER (PARTITION BY jd_id ORDER BY r) AS group_no FROM r8),
 gt AS (SELECT jd_id, group_no, string_agg(term, '|' ORDER BY n) AS terms, count(*) AS size, string_agg(CASE WHEN contains(term, ' ') THEN '"' || term || '"' ELSE term END, ' OR ' ORDER BY n) AS q FROM gp GROUP BY 1, 2),
 gr AS (SELECT jd_id, group_no, terms, CASE WHEN size = 1 THEN q ELSE '(' || q || ')' END AS q FROM gt),
 ng AS (SELECT tt.jd_id, title, coalesce(max(group_no), 0) AS n FROM tt LEFT JOIN gp ON gp.jd_id = tt.jd_id GROUP BY 1, 2),
 se2 AS (SELECT jd_id, title, n, unnest([1, 2, 3, 4, 5, 6]) AS no, unnest(['Job title', 'Title + top requirement', 'Top two requirements', 'Core stack (top three)', 'Title + core stack', 'All top requirements (' || n || ')']) AS name,
  unnest([true, true, false, false, true, false]) AS uses, unnest([0, 1, 2, 3, 3, n]) AS k, unnest([0, 1, 2, 3, 3, 4]) AS need FROM ng),
 sr AS (SELECT jd_id, title, name, uses, k, row_number() OVER (PARTITION BY jd_id ORDER BY no) AS search_no FROM se2 WHERE n >= need AND (title <> '' OR NOT uses))"""


@query("skill_groups", f"WITH {GROUPS} SELECT jd_id, group_no, terms FROM gt")
def skill_groups(t):
    groups = F.transform("groups", lambda g, i: F.struct((i + 1).alias("group_no"), F.array_join(g, "|").alias("terms")))
    return ar.unpack(c.posting_models(t), ["jd_id"], groups, "group_no")


@query("build_searches", f"WITH {GROUPS} SELECT jd_id, search_no, name, k + CASE WHEN uses THEN 1 ELSE 0 END AS n_groups FROM sr")
def build_searches(t):
    rows = F.transform("searches", lambda s, i: F.struct((i + 1).alias("search_no"), s["name"].alias("name"), F.size(s["groups"]).alias("n_groups")))
    return ar.unpack(c.posting_models(t), ["jd_id"], rows, "search_no")


@query("render_search_query", f"""WITH {GROUPS}, tq AS (SELECT *, CASE WHEN contains(title, ' ') THEN '"' || title || '"' ELSE title END AS t FROM sr)
 SELECT tq.jd_id, name, CASE WHEN uses THEN t || CASE WHEN k > 0 THEN ' AND ' ELSE '' END ELSE '' END || coalesce(string_agg(gr.q, ' AND ' ORDER BY group_no), '') AS query FROM tq LEFT JOIN gr ON gr.jd_id = tq.jd_id AND group_no <= k GROUP BY tq.jd_id, name, uses, t, k""")
def render_search_query(t):
    rows = F.transform("searches", lambda s: F.struct(s["name"].alias("name"), mt.render_query(s["groups"]).alias("query")))
    return ar.unpack(c.posting_models(t), ["jd_id"], rows, "name")


def pair_rows(t, asked=lambda model: model, names=()):
    """Pairs with what is `asked` of a posting's model, whole or of some names, and the terms of the document."""
    model = c.posting_models(t, *names)
    return mt.paired(c.pairs(t), asked(model), c.candidate_terms(t, model))


# the aliases that occur in the composed documents
HELD = f"""{OFFERS}, {LISTS}, k40 AS (SELECT * FROM top WHERE rank <= 40),
 al AS (SELECT a.jd_id, a.term, b.term AS alt FROM om a JOIN om b ON b.jd_id = a.jd_id AND b.list_no = a.list_no UNION SELECT jd_id, head, unnest(members) FROM pg
  UNION SELECT jd_id, a, b FROM (SELECT jd_id, unnest(members) AS a, members FROM pg), unnest(members) AS u(b)),
 rh AS (SELECT candidate_id, ' ' || replace(replace(replace(replace(lower(text), 'k8s', 'kubernetes'), 'a/b tests', 'a/b testing'), 'data engineer', 'data engineering'), 'bi analyst', 'business intelligence analyst') || ' ' AS hay FROM ({D.RESUME})),
 wd AS (SELECT DISTINCT term FROM kw),
 held AS (SELECT candidate_id, term FROM rh, wd WHERE regexp_matches(hay, '[^a-z0-9]' || regexp_escape(term) || CASE WHEN ends_with(term, 's') OR length(term) <= 2 THEN '' ELSE 's?' END || '[^a-z0-9]')),
 want AS (SELECT jd_id, term, term AS alt FROM k40 UNION SELECT al.jd_id, al.term, al.alt FROM al),
 met AS (SELECT DISTINCT pa.candidate_id, pa.jd_id, want.term FROM ({D.PAIR}) pa JOIN want ON want.jd_id = pa.jd_id JOIN held ON held.candidate_id = pa.candidate_id AND held.term = want.alt)"""


GROUPS_HELD = HELD.replace(f"{OFFERS}, {LISTS}", GROUPS).replace("SELECT DISTINCT term FROM kw)", "SELECT DISTINCT term FROM kw UNION SELECT title FROM tt WHERE title <> '')")
FOUND = f"""{GROUPS_HELD}, gh AS (SELECT DISTINCT pa.candidate_id, pa.jd_id, group_no FROM ({D.PAIR}) pa JOIN gp ON gp.jd_id = pa.jd_id JOIN held ON held.candidate_id = pa.candidate_id AND held.term = gp.term),
 hit AS (SELECT pa.candidate_id, pa.jd_id, name, (NOT uses OR held.term IS NOT NULL) AND (SELECT count(*) FROM gh WHERE gh.candidate_id = pa.candidate_id AND gh.jd_id = pa.jd_id AND group_no <= k) = k AS matched
  FROM ({D.PAIR}) pa JOIN sr ON sr.jd_id = pa.jd_id LEFT JOIN held ON held.candidate_id = pa.candidate_id AND held.term = title)"""


@query("matched_missing_terms", f"""WITH {HELD} SELECT pa.candidate_id, pa.jd_id, coalesce(string_agg(k40.term, '|' ORDER BY rank) FILTER (met.term IS NOT NULL), '') AS matched, coalesce(string_agg(k40.term, '|' ORDER BY rank) FILTER (met.term IS NULL), '') AS missing
 FROM ({D.PAIR}) pa JOIN k40 ON k40.jd_id = pa.jd_id LEFT JOIN met ON met.candidate_id = pa.candidate_id AND met.jd_id = pa.jd_id AND met.term = k40.term GROUP BY 1, 2""")
def matched_missing_terms(t):
    lists = pair_rows(t, mt.asked_terms, ("keywords", "title")).select("candidate_id", "jd_id", mt.matched_terms(F.col("terms")).alias("l"))
    return lists.select("candidate_id", "jd_id", F.array_join("l.matched", "|").alias("matched"), F.array_join("l.missing", "|").alias("missing"))


@query("alternatives_match", f"""WITH {HELD}, own AS (SELECT pa.candidate_id, pa.jd_id, k40.term FROM ({D.PAIR}) pa JOIN k40 ON k40.jd_id = pa.jd_id JOIN held ON held.candidate_id = pa.candidate_id AND held.term = k40.term)
 SELECT pa.candidate_id, pa.jd_id, count(met.term) AS n_met, count(met.term) FILTER (own.term IS NULL) AS n_by_alternative, CAST(coalesce(sum(k40.weight) FILTER (met.term IS NOT NULL), 0) AS DOUBLE) AS met_weight FROM ({D.PAIR}) pa LEFT JOIN k40 ON k40.jd_id = pa.jd_id
  LEFT JOIN met ON met.candidate_id = pa.candidate_id AND met.jd_id = pa.jd_id AND met.term = k40.term LEFT JOIN own ON own.candidate_id = pa.candidate_id AND own.jd_id = pa.jd_id AND own.term = k40.term GROUP BY 1, 2""")
def alternatives_match(t):
    """Requirements that a document meets, by the term itself or by one that the posting lets stand in for it."""
    model = c.posting_models(t, "keywords", "title")
    edges = materialize(mt.alternative_edges(model), "edges")
    return mt.met_keywords(c.pairs(t), model, edges, c.candidate_terms(t, model))


@query("evaluate_searches", f"WITH {FOUND} SELECT candidate_id, jd_id, name, matched FROM hit")
def evaluate_searches(t):
    found = mt.evaluated_searches(F.col("terms"))
    return ar.unpack(pair_rows(t, mt.searches_of), ["candidate_id", "jd_id"], found, "name").select("candidate_id", "jd_id", "name", "matched")


VISIBLE = f"""{FOUND}, vis AS (SELECT pa.candidate_id, pa.jd_id, count(name) AS n_searches, round_even(count(*) FILTER (matched) / nullif(count(name), 0)::DOUBLE * 100, 1) AS visibility_score FROM ({D.PAIR}) pa LEFT JOIN hit ON hit.candidate_id = pa.candidate_id AND hit.jd_id = pa.jd_id GROUP BY 1, 2),
 vt AS (SELECT vis.*, CASE WHEN title <> '' THEN held.term IS NOT NULL END AS title_found FROM vis JOIN tt ON tt.jd_id = vis.jd_id LEFT JOIN held ON held.candidate_id = vis.candidate_id AND held.term = title)"""


@query("search_visibility", f"WITH {VISIBLE} SELECT candidate_id, jd_id, n_searches, visibility_score, title_found FROM vt")
def search_visibility(t):
    held = F.col("terms")
    return pair_rows(t).select("candidate_id", "jd_id", F.size("searches").alias("n_searches"),
                               ar.let(held, lambda h: mt.visibility_score(F.col("searches"), h)).alias("visibility_score"),
                               F.when(F.col("title") != "", F.array_contains(held, F.col("title"))).alias("title_found"))


# whole hundredths, then half-even to tenths
@query("ats_composite", f"""SELECT app_id, (n // 10 + CASE WHEN n % 10 > 5 OR (n % 10 = 5 AND (n // 10) % 2 = 1) THEN 1 ELSE 0 END) / 10.0 AS composite FROM (
 SELECT app_id, CAST(CASE WHEN manager_score IS NOT NULL THEN recruiter_score * 15 + visibility_score * 40 + manager_score * 45 ELSE recruiter_score * 25 + visibility_score * 75 END AS BIGINT) AS n FROM ({D.APPLICATION}))""")
def ats_composite(t):
    apps = t.sql(D.APPLICATION)
    return apps.select("app_id", mt.composite(F.col("recruiter_score"), F.col("visibility_score"), F.col("manager_score")).alias("composite"))


FIT = f"""SELECT o_orderkey AS id, {D.pick('o_orderkey', (('sql', "'{\"semantic_score\": ' || CAST(o_custkey % 140 AS STRING) || '}'"), ('sql', "'{\"semantic_score\": \"' || CAST(o_custkey % 90 AS STRING) || '\"}'"), '{"semantic_score": 61.7}', '{"semantic_score": "high"}', '{"semantic_score": -4}', '{"gaps": []}', 'no json', '{"semantic_score": null}'))} AS raw,
 o_custkey FROM orders"""


@query("semantic_score_ingest", f"""SELECT id, CASE id % 8 WHEN 0 THEN least(100, o_custkey % 140) WHEN 1 THEN o_custkey % 90 WHEN 2 THEN 61 WHEN 6 THEN NULL ELSE 0 END AS fit_score FROM ({FIT})""")
def semantic_score_ingest(t):
    return t.sql(FIT).select("id", ar.let(F.try_parse_json("raw"), mt.fit_score).alias("fit_score"))


RUBRIC = f"""SELECT o_orderkey AS id, '{{"quantification": ' || CAST(o_custkey % 101 AS STRING) || ', "outcome_focus": ' || {D.pick('o_orderkey', ('55.5', 'null', '"abc"', 'true', '120', '"40"', '-3'))} || ', "evidence_backing": ' || CAST(o_orderkey % 101 AS STRING)
 || {D.pick('o_orderkey + o_custkey', (', "scope_match": 70, "domain_relevance": 65, "credibility": 90', ', "credibility": 30', ''))} || '}}' AS raw, o_custkey FROM orders"""


@query("rubric_score", f"""WITH d AS (SELECT id, o_custkey % 101 AS q, CASE id % 7 WHEN 0 THEN 56 WHEN 4 THEN 100 WHEN 5 THEN 40 WHEN 6 THEN 0 END AS o, id % 101 AS e, (id + o_custkey) % 3 AS v FROM ({RUBRIC})),
 s AS (SELECT id, 20 * q + 20 * coalesce(o, 0) + 20 * e + CASE v WHEN 0 THEN 15 * 70 + 15 * 65 + 10 * 90 WHEN 1 THEN 10 * 30 ELSE 0 END AS t, 40 + CASE WHEN o IS NULL THEN 0 ELSE 20 END + CASE v WHEN 0 THEN 40 WHEN 1 THEN 10 ELSE 0 END AS w FROM d)
 SELECT id, CASE WHEN w >= 50 THEN CAST(round_even(t / w, 0) AS INT) END AS rubric_score FROM s""")
def rubric_score(t):
    return t.sql(RUBRIC).select("id", ar.let(F.try_parse_json("raw"), mt.rubric_score).alias("rubric_score"))


NEAR = "(n // 100 + CASE WHEN n % 100 > 50 OR (n % 100 = 50 AND (n // 100) % 2 = 1) THEN 1 ELSE 0 END) / 10.0"


FIT_ANSWER = """CASE WHEN (candidate_id + jd_id) % 3 = 0 THEN '{"semantic_score": ' || CAST((candidate_id * 7 + jd_id) % 101 AS STRING) || '}' END"""
RUBRIC_ANSWER = """CASE WHEN (candidate_id + jd_id) % 4 < 2 THEN '{"quantification": ' || CAST(jd_id % 101 AS STRING) || ', "outcome_focus": ' || CAST(candidate_id % 101 AS STRING) || ', "evidence_backing": 40}' END"""


@query("score_report", f"""WITH {VISIBLE}, {RES_FEATURES}, ks AS (SELECT pa.candidate_id, pa.jd_id, round_even(CAST(coalesce(sum(weight) FILTER (met.term IS NOT NULL), 0) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) * 100, 1) AS keyword_score
  FROM ({D.PAIR}) pa JOIN k40 ON k40.jd_id = pa.jd_id LEFT JOIN met ON met.candidate_id = pa.candidate_id AND met.jd_id = pa.jd_id AND met.term = k40.term GROUP BY 1, 2),
 al2 AS (SELECT vt.*, coalesce(keyword_score, 0.0) AS keyword_score, fs AS formatting_score, safe AS parse_safe, CASE WHEN (vt.candidate_id + vt.jd_id) % 3 = 0 THEN (vt.candidate_id * 7 + vt.jd_id) % 101 END AS fit_score,
  CASE WHEN (vt.candidate_id + vt.jd_id) % 4 < 2 THEN round_even((20 * (vt.jd_id % 101) + 20 * (vt.candidate_id % 101) + 800) / 60.0::DOUBLE, 0) END AS rubric_score FROM vt LEFT JOIN ks ON ks.candidate_id = vt.candidate_id AND ks.jd_id = vt.jd_id JOIN rs ON rs.candidate_id = vt.candidate_id),
 al3 AS (SELECT *, {NEAR} AS composite_score FROM (SELECT *, CAST(CASE WHEN fit_score IS NULL THEN formatting_score * 250 + round(keyword_score * 10) * 75 ELSE formatting_score * 150 + round(keyword_score * 10) * 40 + fit_score * 450 END AS BIGINT) AS n FROM al2))
 SELECT al3.candidate_id, al3.jd_id, keyword_score, visibility_score, n_searches, formatting_score, parse_safe, title_found, fit_score, rubric_score, composite_score, criteria_met_pct AS recruiter_score, resume_pct, candidacy_pct,
  {BAND.format(s='visibility_score')} AS visibility_band, {BAND.format(s='composite_score')} AS composite_band, {BAND.format(s='criteria_met_pct')} AS recruiter_band, {BAND.format(s='rubric_score')} AS rubric_band,
  array_to_string(list_filter([CASE WHEN fit_score IS NULL THEN '{mt.NOTES['fit_score']}' END, CASE WHEN rubric_score IS NULL THEN '{mt.NOTES['rubric_score']}' END], lambda x: x IS NOT NULL), '; ') AS notes
 FROM al3 JOIN ({SCREEN_SQL}) sq ON sq.candidate_id = al3.candidate_id AND sq.jd_id = al3.jd_id""")
def score_report(t):
    """Every layer: searches, keywords, formatting, the screen, and answers where a pair has them."""
    model = c.posting_models(t)
    features = mt.document_features(c.resumes(t)).drop("text")
    docs = c.candidate_terms(t, model).join(features, "candidate_id")
    pairs = materialize(c.pairs(t), "pairs")
    answers = pairs.select("candidate_id", "jd_id", F.try_parse_json(F.expr(FIT_ANSWER)).alias("fit"), F.try_parse_json(F.expr(RUBRIC_ANSWER)).alias("rubric"))
    # a pair's row takes its scores along from one layer to the next: layers are not joined by pair
    screened = sc.screen_scores(c.screened(t, mt.answer_scores(answers), model))
    report = mt.score_report(screened, model, docs)
    return report.withColumn("notes", c.joined("notes", "; "))


FINDINGS = f"""SELECT o_orderkey AS id, {D.pick('o_orderkey', ('{"weak_bullets": [{"bullet": "b1", "problem": "p1", "rewrite": "r1"}, "junk", {"bullet": "b2"}], "interview_risks": ["a", "b", "c", "d", "e"]}', '{"strengths": ["s1"], "gaps": ["g1", "g2"], "reworded_matches": []}', '{"gaps": "none"}', 'broken'))} AS raw FROM orders"""


@query("answer_findings", f"""SELECT id, 'weak_bullets' AS kind, unnest([1, 2]) AS item_no, unnest(['b1', 'b2']) AS text, unnest(['p1', '']) AS problem FROM ({FINDINGS}) WHERE id % 4 = 0
 UNION ALL SELECT id, 'interview_risks', unnest([1, 2, 3, 4]), unnest(['a', 'b', 'c', 'd']), NULL FROM ({FINDINGS}) WHERE id % 4 = 0
 UNION ALL SELECT id, 'strengths', 1, 's1', NULL FROM ({FINDINGS}) WHERE id % 4 = 1 UNION ALL SELECT id, 'gaps', unnest([1, 2]), unnest(['g1', 'g2']), NULL FROM ({FINDINGS}) WHERE id % 4 = 1""")
def answer_findings(t):
    rows = t.sql(FINDINGS).select("id", F.try_parse_json("raw").alias("answer"))
    return mt.answer_findings(rows, ["id"]).drop("rewrite")
