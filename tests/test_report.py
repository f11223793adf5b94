"""The report of pairs: a pair's scores go along in its row, terms are compared once, and cues rule out only lines that no pattern matches."""
from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import text as tx
from hiresift.operators import match as mt
from hiresift.operators import requirements as rq
from hiresift.operators import screen as sc

JD = "Job Title: Data Analyst\nRequirements:\n- SQL, Python and Excel\n- Power BI or Tableau or Looker\n- Scrum routines (Jira, Kanban, Agile)\n- Docker\nNice to have:\n- AWS"
DOCS = [(1, "Data analyst with SQL and Tableau, Docker"), (2, "nothing of it"), (3, "Python, Excel, Looker, Kanban, Jira and AWS " + "word " * 120 + "a@b.co"), (4, None)]
FIT = ['{"semantic_score": 61.7}', '{"semantic_score": "high"}', '{"semantic_score": true}', '{"gaps": []}', "no json", None]
RUBRIC = ['{"quantification": 70, "outcome_focus": "40", "evidence_backing": 120}', '{"quantification": true, "outcome_focus": null, "scope_match": 5}',
          '{"quantification": "NaN", "outcome_focus": -3, "evidence_backing": 50.5, "credibility": 10}', "[]", None, "{}"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sides(spark):
    postings = spark.createDataFrame([(1, JD), (2, ""), (3, None), (4, JD.replace("Data Analyst", "Join a crew")), (4, JD)], "jd_id long, jd_text string")
    resumes = spark.createDataFrame(DOCS, "candidate_id long, text string").withColumn("file_type", F.lit("text"))
    model = mt.posting_model(postings)
    docs = mt.document_terms(resumes, mt.vocabulary_of(model), key="candidate_id").join(mt.document_features(resumes).drop("text"), "candidate_id")
    pairs = resumes.select("candidate_id").crossJoin(postings.select("jd_id").distinct())
    return model, docs, pairs


def test_scores_of_a_pair_equal_those_of_its_whole_arrays(sides):
    model, docs, pairs = sides
    held = F.col("terms")
    whole = mt.paired(pairs, model, docs).select(
        "candidate_id", "jd_id", mt.keyword_score(F.col("keywords"), held).alias("k"), mt.visibility_score(F.col("searches"), held).alias("v"),
        F.size("searches").alias("n"), F.when(F.col("title") != "", F.array_contains(held, F.col("title"))).alias("t"))
    report = mt.score_report(pairs, model, docs).select("candidate_id", "jd_id", "keyword_score", "visibility_score", "n_searches", "title_found")
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert order(report) == order(whole) and len({r.keyword_score for r in report.collect()}) == 3


def test_scores_that_pairs_bear_are_not_joined_again(spark, sides):
    model, docs, pairs = sides
    screened = pairs.withColumns({"criteria_met_pct": F.col("candidate_id") * 10.0, "resume_pct": F.lit(None).cast("double"), "candidacy_pct": F.lit(50.0)})
    texts = lambda options: F.get(F.array(*[F.lit(x) for x in options]), ((F.col("candidate_id") + F.col("jd_id")) % 6).cast("int"))
    answers = pairs.withColumns({"fit": F.try_parse_json(texts(FIT)), "rubric": F.try_parse_json(texts(RUBRIC))})
    borne = screened.join(mt.answer_scores(answers), ["candidate_id", "jd_id"])
    along, joined = mt.score_report(borne, model, docs), mt.score_report(pairs, model, docs, answers=answers, screened=screened)
    assert along.columns == joined.columns
    assert sorted((tuple(r) for r in along.collect()), key=repr) == sorted((tuple(r) for r in joined.collect()), key=repr)
    assert along.where("recruiter_score is not null and size(notes) = 0").count() and along.where("fit_score = 61").count()
    bare = lambda df: mt.score_report(df, model, docs)
    assert plan(bare(screened)).count("Join") == plan(bare(pairs)).count("Join"), "no join for what a pair bears"


def test_the_screen_takes_a_pairs_columns_along(spark):
    checks = "array<struct<name:string,status:string,category:string,importance:double,citation:string,topic:string>>"
    row = [("a", "pass", "resume", 3.0, "", None), ("b", "warn", "candidacy", 2.0, "", None), ("c", "skipped", "candidacy", 1.0, "", None), ("d", "fail", "candidacy", 3.0, "", None)]
    rows = spark.createDataFrame([(1, 2, 7, row), (1, 3, None, row[2:3]), (1, 4, 9, None)], f"candidate_id long, jd_id long, fit_score int, checks {checks}")
    got = sc.screen_scores(rows.withColumn("asks_location", F.lit(True))).orderBy("jd_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 7, 50.0, 100.0, 20.0), (1, 3, None, 0.0, None, None), (1, 4, 9, 0.0, None, None)]


def test_answers_score_as_before(spark):
    rows = spark.createDataFrame([(i, f, r) for i, (f, r) in enumerate(zip(FIT, RUBRIC))], "i int, f string, r string")
    got = mt.answer_scores(rows.select("i", F.try_parse_json("f").alias("fit"), F.try_parse_json("r").alias("rubric"))).orderBy("i").collect()
    assert [(r.fit_score, r.rubric_score) for r in got] == [(61, 70), (0, None), (1, 22), (0, None), (None, None), (None, None)]


# every alternative of a pattern, in mixed case and with the least around it
LINES = {
    "degree": ("Diploma", "a BACHELORS degree", "Bachelor's", "btech", "B.Tech", "bsc", "B.Sc", "x B.A", "BA in", "ba (hons", "bba", "B.B.A", "bb.a", "Undergraduate degree", "b.s", "bs degree", "B.E.", "bsn",
               "any GRADUATE", "MBA", "master's", "Masters", "Master of", "msc", "M.Sc", "m.s", "an MS", "phd", "Ph.D", "Doctorate", "x;ms", "1. PhD. b.a", "postgraduate", "embassy"),
    "years": ("3-5 years", "3 – 5 YRS", "5+ yr", "at least 4 Years", "min. 2yrs", "7 years relevant experience", "3 to 4 year"),
    "mode": ("Fully Remote", "HYBRID", "on-site", "Onsite", "in office", "in-office", "in person", "work from office", "WFO", "office-based", "offsite"),
    "sponsor": ("Sponsorship is not available", "visa: we are unable", "we do not ever sponsor", "No sponsorship", "cannot provide sponsor", "must be based in X with a valid UAE visa", "own visa required", "candidates must hold a valid work visa"),
    "auth": ("must be legally authorised to work", "must be eligible to work", "Right to Work", "work authorization required"),
    "place": ("Location: X", "based in Y city", "Located in Leeds", "office in Rome", "situated in Oslo", "work from Home now"),
}


@pytest.mark.parametrize("kind, patterns, cues", [
    ("degree", tuple(rq.DEGREE_PATTERNS.values()), rq.DEGREE_CUE), ("years", rq.YEAR_PATTERNS, rq.YEARS_CUES), ("mode", tuple(rq.MODE_PATTERNS.values()), rq.MODE_CUES),
    ("sponsor", (rq.NO_SPONSORSHIP,), rq.SPONSOR_CUES), ("auth", (rq.WORK_AUTH,), rq.AUTH_CUES), ("place", (rq.LOCATION,), rq.LOCATION_CUES)])
def test_cues_rule_out_no_line_that_a_pattern_matches(kind, patterns, cues):
    matched = [x for x in LINES[kind] if any(re.search(p, x) for p in patterns)]
    able = [x for x in LINES[kind] if (re.search(cues, x) if isinstance(cues, str) else any(c in x.lower() for c in cues))]
    assert set(matched) <= set(able) and len(matched) >= len(LINES[kind]) - 2


def test_salary_lines_and_countries_are_found_by_any_of_their_names(spark):
    words = ("Salary", "compensation", "CTC", "pay range", "pay", "paying", "Per annum", "annually", "10 lpa", "lakhs", "per month", "monthly", "budgeted", "usd", "₹5", "£", "display", "payer")
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.matches(F.col("w"), rq.SALARY_CONTEXT).alias("m")).collect()
    assert [r.w for r in rows if not r.m] == ["display", "payer"]
    names = [(c, f"x {a.upper()} y") for c, aliases in V.COUNTRY_ALIASES.items() for a in aliases] + [("", "Indiana"), ("", "x"), ("", None)]
    found = spark.createDataFrame(names, "c string, t string").select("c", "t", tx.countries_in(F.col("t")).alias("f")).collect()
    assert all(r.c in r.f if r.c else r.f == [] for r in found)


def test_ranges_of_a_document_by_line(spark, column):
    from hiresift.functions import dates as dt

    month = lambda y, m: y * 12 + m
    read = column(dt.date_ranges, "A (Jan 2019 - Mar 2021), before 03/2015 to 11/2018\nno year here\nDegree 2010 - 2014", "Sept. 2020 – Present\n2001 until 2003, 1999-now", "5 to 6, 1920s", "", None)
    assert [None if r is None else [tuple(x) for x in r] for r in read] == [
        [(month(2019, 1), month(2021, 3)), (month(2015, 3), month(2018, 11))], [(month(2020, 9), None), (month(2001, 1), month(2003, 1)), (month(1999, 1), None)], [], [], None]


def test_a_pairs_lists_are_read_from_what_its_posting_asks(spark):
    model = spark.sql("""SELECT 7 AS jd_id, 'data analyst' AS title, array(named_struct('term', 'sql', 'weight', 3.00BD, 'alternatives', array('postgresql')),
      named_struct('term', 'excel', 'weight', 1.00BD, 'alternatives', CAST(array() AS array<string>)), named_struct('term', 'dax', 'weight', 1.00BD, 'alternatives', array('bi'))) AS keywords,
     array(named_struct('name', 'Title', 'groups', array(array('data analyst'))), named_struct('name', 'Both', 'groups', array(array('data analyst'), array('sql', 'dax'), array('excel')))) AS searches""")
    documents = spark.createDataFrame([(1, ["data analyst", "excel", "postgresql", "unasked"]), (2, ["dax", "excel"]), (3, [])], "candidate_id int, terms array<string>")
    pairs = spark.createDataFrame([(k, 7) for k in (1, 2, 3)], "candidate_id int, jd_id int")
    lists = mt.paired(pairs, mt.asked_terms(model), documents).select("candidate_id", mt.matched_terms(F.col("terms")).alias("l"))
    assert {r.candidate_id: (r.l.matched, r.l.missing) for r in lists.collect()} == {
        1: (["sql", "excel"], ["dax"]), 2: (["excel", "dax"], ["sql"]), 3: ([], ["sql", "excel", "dax"])}
    found = mt.paired(pairs, mt.searches_of(model), documents).select("candidate_id", mt.evaluated_searches(F.col("terms")).alias("s"))
    query, rest = '"data analyst" AND (sql OR dax) AND excel', '"data analyst"; (sql OR dax); excel'
    assert {r.candidate_id: [tuple(s) for s in r.s] for r in found.collect()} == {
        1: [("Title", '"data analyst"', True, ""), ("Both", query, False, "(sql OR dax)")],
        2: [("Title", '"data analyst"', False, '"data analyst"'), ("Both", query, False, '"data analyst"')],
        3: [("Title", '"data analyst"', False, '"data analyst"'), ("Both", query, False, rest)]}
    met = mt.met_keywords(pairs, model, mt.alternative_edges(model), documents)
    assert {r.candidate_id: (r.n_met, r.n_by_alternative, r.met_weight) for r in met.collect()} == {1: (2, 1, 4.0), 2: (2, 0, 2.0), 3: (0, 0, 0.0)}
    assert "array_intersect" in met._jdf.queryExecution().optimizedPlan().toString()  # what a document holds is cut first


def test_posting_models_leave_out_what_a_query_does_not_read(spark, tmp_path):
    from hiresift.plans import common as c
    from hiresift.plans.tables import Tables

    spark.createDataFrame([(k, 1 + k, 900.0 + k) for k in range(40)], "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    t = Tables(spark, str(tmp_path))
    few, whole = c.posting_models(t, "keywords", "title"), c.posting_models(t)
    assert few.columns == ["jd_id", "keywords", "title"] and whole.columns == ["jd_id", "keywords", "title", "groups", "searches"]
    assert sorted(map(repr, few.collect())) == sorted(map(repr, whole.select(*few.columns).collect()))
