"""What joins send where: no text to the driver, no column that a result doesn't need to the pairs."""
from __future__ import annotations

import pytest

from hiresift.operators import grounding as gr

ANSWER = '{"skills": [{"term": "SQL", "required": true, "quote": "we use SQL"}, {"term": "gardening", "required": true, "quote": "we use gardening"}]}'


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    postings = spark.createDataFrame([(1, "we use SQL\nand gardening"), (2, "nothing")], "jd_id int, jd_text string")
    answers = spark.createDataFrame([(1, ANSWER), (2, ANSWER)], "jd_id int, raw string")
    return postings, answers


def test_texts_are_never_broadcast(spark, tables):
    postings, answers = tables
    quotes = spark.createDataFrame([(1, "we use SQL"), (2, "we use SQL")], "jd_id int, quote string")
    quoted, grounded = gr.ground_quotes(quotes, postings), gr.ground_fields(answers, postings)
    assert "Broadcast" not in plan(quoted) and "Broadcast" not in plan(grounded)
    assert sorted((r.jd_id, r.reason) for r in quoted.collect()) == [(1, None), (2, "quote not found")]
    assert sorted((r.jd_id, r.value, r.reason) for r in grounded.collect()) == [
        (1, "gardening", "quote not found"), (1, "sql", None), (2, "gardening", "quote not found"), (2, "sql", "quote not found")]


def test_keywords_of_all_postings_are_never_broadcast(spark, tables):
    postings, answers = tables
    skills = spark.createDataFrame([(1, "gardening", True, "q"), (1, "weeding", True, "q")], "jd_id int, term string, required boolean, quote string")
    keywords = spark.createDataFrame([(1, "weeding")], "jd_id int, term string")
    found = gr.learned_candidates(skills, keywords)
    assert "Broadcast" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [("gardening", 1, "q")]


def test_pairs_move_twice_and_carry_no_lines(spark):
    from hiresift.operators import requirements as rq
    from hiresift.operators import screen as sc
    from hiresift.sources import profiles as pf

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        postings = spark.createDataFrame([(1, "Data Analyst\nRequirements:\n- 5+ years of SQL\n- PMP required\n- Fully remote")], "jd_id long, jd_text string")
        fields = ("years_experience current_title education_level certifications location open_to_relocation acceptable_work_modes work_authorization "
                  "work_authorized_in notice_period_days expected_salary_min expected_salary_max salary_currency").split()
        raw = spark.createDataFrame([(7, "2", *[""] * (len(fields) - 1))], "candidate_id long, " + ", ".join(f"{n} string" for n in fields))
        pairs = spark.createDataFrame([(7, 1)], "candidate_id long, jd_id long")
        facts = sc.resume_facts(spark.createDataFrame([(7, "SQL and a PMP")], "candidate_id long, text string"), 24000)
        must = spark.createDataFrame([(1, ["sql"])], "jd_id long, must_have array<string>")
        asked, people = rq.jd_requirements(postings), pf.coerce_profiles(raw)
        cited, bare = (sc.screen(pairs, people, asked, facts, must_have=must, cited=flag) for flag in (True, False))
        scores = sc.screen_scores(bare)
        assert [tuple(r) for r in scores.collect()] == [tuple(r) for r in sc.screen_scores(cited).collect()]
        checks = {c.name: c for c in bare.first().checks}
        assert checks["Certification: PMP"].status == "pass" and checks["Years of experience"].status == "fail"
        assert not any(c.citation for c in checks.values()) and any(c.citation for c in cited.first().checks)
        depth = [len(x) - len(x.lstrip(" :+-")) for x in plan(scores).splitlines() if "Exchange hashpartitioning(jd_id" in x]
        top = min(len(x) - len(x.lstrip(" :+-")) for x in plan(scores).splitlines() if "Exchange hashpartitioning(candidate_id" in x)
        assert top < min(depth), "pairs are dealt by candidate last, and once"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_must_have_terms_of_a_posting_model_are_not_extracted_again(spark, monkeypatch):
    from hiresift.operators import match as mt
    from hiresift.plans import common as c

    texts = ["Data Analyst\nRequirements:\n- SQL, Python, Excel, Tableau, Power BI, Snowflake\n- AWS, Azure, Docker, Jira, Agile and Spark\nNice to have:\n- Airflow or dbt", "", None]
    postings = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "jd_id long, jd_text string")
    monkeypatch.setattr(c, "postings", lambda t: postings)
    read = sorted(tuple(r) for r in c.must_have(None).collect())
    model = mt.posting_model(postings)
    monkeypatch.setattr(c, "postings", lambda t: pytest.fail("postings are read a second time"))
    assert sorted(tuple(r) for r in c.must_have(None, model).collect()) == read
    assert len(read) == 4 and len(read[0][1]) == 10
