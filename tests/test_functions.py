"""Scalars against stated values."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hiresift.functions import dates as dt
from hiresift.functions import sqlfuncs
from hiresift.functions import stats as st
from hiresift.functions import terms as tm
from hiresift.functions import text as tx
from hiresift.operators import grounding as gr
from hiresift.operators import requirements as rq
from hiresift.operators import writing as wr


def test_aliases_rewrite_in_one_pass(column):
    got = column(tm.alias_normalize, "nodejs, Node.js, next.js, js and node; k8s")
    assert got == "node.js, Node.js, next.js, javascript and node.js; kubernetes"


def test_term_boundaries(spark):
    docs = spark.createDataFrame([(1, "dashboards, c++ and a/b testing"), (2, "c++x dashboardss ab"), (3, "x.net core c++s"), (4, "power\nbi power bi")], "id int, t string")
    vocab = spark.createDataFrame([(x,) for x in ("dashboard", "c++", "a/b testing", ".net core", "power bi", "ab")], "term string")
    got = {tuple(r) for r in tm.term_index(docs, ["id"], F.col("t"), vocab).collect()}
    assert got == {(1, "dashboard"), (1, "c++"), (1, "a/b testing"), (2, "ab"), (3, "c++"), (4, "power bi")}


def test_index_agrees_with_the_pair_test(spark):
    """The inverted index against the boundary regex on every (text, term) pair."""
    texts = ["sql, python/r; (power bi) dashboards", "node.js-based c# c#, .net core!", "a/b testing b testings", "fp&a p&l ci/cd ci/cds", "ss kpis kpi's k", ""]
    terms = ["sql", "python", "r", "power bi", "dashboard", "node.js", "c#", ".net core", "a/b testing", "testing", "fp&a", "p&l", "ci/cd", "kpi", "ss", "k"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    vocab = spark.createDataFrame([(x,) for x in terms], "term string")
    index = {tuple(r) for r in tm.term_index(docs, ["id"], F.col("t"), vocab).collect()}
    pairs = {tuple(r) for r in docs.crossJoin(vocab).where(tm.term_in(F.col("term"), F.col("t"))).select("id", "term").collect()}
    assert index == pairs and pairs


def test_index_of_known_and_unknown_spans(spark, monkeypatch):
    """Spans dropped in the tasks and spans dropped by the join give the pairs of the boundary test, each text read in Arrow
    batches once; contexts that the test can't tell apart leave a task once."""
    texts = ["über der tür", "tür", "x über, über über", "", None, "\x01a\x01 c++ c++s c++x", "(.net core) x.net core", "té ét éts été t", "power\nbi power bi", "a^b ^b"]
    terms = ["über", "tür", "c++", ".net core", "té", "ét", "t", "power bi", "^b", "der tür", "+++"]
    docs = spark.createDataFrame([*enumerate(texts), (0, "power bi"), (None, "t")], "id int, t string")
    vocab = spark.createDataFrame([(x,) for x in [*terms, "t"]], "term string")
    wanted = {tuple(r) for r in docs.crossJoin(vocab.where("term <> '+++'")).where(tm.term_in(F.col("term"), F.col("t"))).select("id", "term").collect()}
    for most in (tm.MAX_KEYS, 3):
        monkeypatch.setattr(tm, "MAX_KEYS", most)
        found = [tuple(r) for r in tm.term_index(docs, ["id"], F.col("t"), vocab).collect()]
        assert set(found) == wanted and len(found) == len(wanted)
    read = tm.known_spans([("c", "", "+"), ("power bi", "", ""), ("t", "", "")])
    assert read("a c+ one c+ two t power bi c d") == {tm.MARK.join(("c", " ", "+ ", "x")), "power bi", "t"}


@pytest.mark.parametrize("line,title", [
    ("Job Title: Senior Business Intelligence Manager (Hybrid - Dubai)", "business intelligence manager"),
    ("Lead Data Analyst - Remote", "data analyst"), ("Team Lead", "team lead"), ("Staff Accountant", "staff accountant"),
    ("Staff Software Engineer", "software engineer"), ("About our company", ""), ("Lead Generation Specialist", "lead generation specialist"),
])
def test_clean_title(column, line, title):
    assert column(tx.clean_title, line) == title


@pytest.mark.parametrize("line,want", [
    ("₹6-10 LPA", (600000.0, 1000000.0, "INR")), ("Salary: $90k-110k", (90000.0, 110000.0, "USD")), ("$120,000 - $140,000 CAD", (120000.0, 140000.0, "CAD")),
    ("up to £70k", (None, 70000.0, "GBP")), ("from €50,000", (50000.0, None, "EUR")), ("₹50,000+ per month", (50000.0, None, "INR")),
    ("3+ years, budget", None), ("Salary 12 lakhs", None), ("S$8,000 - S$9,000 monthly", (8000.0, 9000.0, "SGD")),
])
def test_salary_line(column, line, want):
    got = column(rq.salary_in, line)
    assert (None if got is None else tuple(got)) == want


def test_dates(column):
    assert column(dt.parse_month, "2024-03", "2024/13", "Sept 2020", "2019", "present", "soon") == [24291, 24300, 24249, 24229, None, None]
    ranges = column(dt.date_ranges, "Analyst (Jul 2020 - Present)\nX 03/2018 – 06/2019\nBachelor degree 2010 - 2014\n2015 to 2016")
    assert [tuple(r) for r in ranges] == [(2020 * 12 + 7, None), (2018 * 12 + 3, 2019 * 12 + 6), (2015 * 12 + 1, 2016 * 12 + 1)]


def test_intervals_match_closed_forms(spark):
    rows = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (1, 20), (0, 0)], "k int, n int")
    low, high = st.wilson(F.col("k"), F.col("n"))
    got = [(round(r[0], 4), round(r[1], 4)) for r in rows.select(low, high).collect()]
    assert got == [(0.0, 0.2775), (0.2366, 0.7634), (0.7225, 1.0), (0.0089, 0.2361), (0.0, 1.0)]
    lo, hi = st.fisher(F.lit(0.5), F.lit(30))
    assert [round(x, 4) for x in spark.range(1).select(lo, hi).first()] == [0.1704, 0.729]
    sqlfuncs.register(spark)
    assert round(spark.sql("SELECT wilson_low(5, 10)").first()[0], 4) == 0.2366


@pytest.mark.parametrize("raw,ok", [
    ('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('Sure {"a": {"b": "}"}} done {x}', True), ("[1, 2]", False), ("no json", False), ("", False), ("{bad} {\"a\": 1}", False),
])
def test_parse_answer(column, raw, ok):
    assert (column(lambda c: gr.parse_answer(c).cast("string"), raw) is not None) == ok


def test_html(column):
    page = "<p>A &amp;lt; &#233; &#x41;</p><script>var x='</p>'</script><div>B<br/>C</div>"
    assert column(tx.html_to_text, page) == "A &lt; é A\nB\nC"


def test_company(column):
    got = column(tx.company_from_url, "https://boards.greenhouse.io/acme-corp/jobs/1", "careers.acme.co.uk/x", "https://acme.bamboohr.com", "https://www.linkedin.com/jobs")
    assert got == ["Acme Corp", "Acme", "Acme", None]
    assert column(tx.company_from_posting, "About us\nAbout Acme Corp\nx", "Company: X Ltd", "About the role") == ["Acme Corp", "X Ltd", None]


def test_countries(column):
    assert column(tx.normalize_country, "UAE", "Dubai, AE", "Atlantis") == ["united arab emirates", "united arab emirates", "atlantis"]
    assert column(tx.countries_in, "work with us in Austin or pune") == ["india", "united states"]


def test_metrics_leave_out_phones_and_dates(column):
    assert column(wr.count_metrics, "Call +91 98765 43210\n2019 - 2021\n03/2020 - 04/2021\nCut cost 30% for 12 teams, 5k users") == 3


def test_references_without_a_character_are_replaced(spark):
    page = "&#9999999;|&#xD800;|&#0;|&#99999999999999999999;|&#x80;|&rarr;|&deg;|&#65;|&nosuchname;|&amp;lt;|&bsol;|&apos;"
    df = spark.createDataFrame([(page,)], ["x"]).select(tx.unescape(F.col("x")).alias("y"))
    assert df.first().y == "�|�|�|�|€|→|°|A|&nosuchname;|&lt;|\\|'"


def test_answer_numbers_are_clamped_before_the_cast(spark):
    from hiresift.operators import match

    rows = [('{"semantic_score": 5000000000, "scope": 1e12}',), ('{"semantic_score": -7.5, "scope": -1e12}',), ('{"semantic_score": 71.9, "scope": 70.5}',)]
    v = F.parse_json("x")
    got = spark.createDataFrame(rows, ["x"]).select(match.fit_score(v).alias("a"), match.rubric_dimension(v, "scope").alias("b")).collect()
    assert [tuple(r) for r in got] == [(100, 100), (0, 0), (71, 70)]


def test_first_balanced_object_of_a_chatty_reply(spark):
    from hiresift.operators import grounding

    replies = ['Sure: {"a": "}{ \\" }", "b": {"c": 1}} and {"d": 2}', "no object", '{"open": 1', "{bad} {\"d\": 2}", "x {" + '"k": [' + "{}," * 4000 + "{}]} y"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], ["i", "x"])
    got = [r.v for r in df.select("i", grounding.parse_answer(F.col("x")).cast("string").alias("v")).orderBy("i").collect()]
    assert got[0] == '{"a":"}{ \\" }","b":{"c":1}}' and got[1:4] == [None, None, None] and got[4].startswith('{"k":[{},')


def test_overlong_notice_period_is_null(spark):
    from hiresift.sources import profiles as pf

    names = ["candidate_id", *dict.fromkeys([*pf.NUMBER_FIELDS, *pf.TEXT_FIELDS, *pf.LIST_FIELDS, "open_to_relocation", "notice_period_days"])]
    row = [1 if n == "candidate_id" else "99999999999" if n == "notice_period_days" else "" for n in names]
    assert pf.coerce_profiles(spark.createDataFrame([row], names)).first().notice_period_days is None


def test_no_rate_below_the_gate(spark):
    from hiresift.operators import funnel

    apps = spark.createDataFrame([(1, "offer"), (2, "rejected_auto")], ["app_id", "outcome"])
    row = funnel.overall_conversion(apps).first()
    assert (row.n, row.calibrated, row.conversion_pct, row.rate) == (2, False, None, None)


def test_aliases_are_tried_by_their_first_character_and_found_as_before():
    import random
    import re

    from hiresift import vocab as V
    from hiresift.functions import terms as tm

    def as_python(pattern):
        return re.compile(pattern, re.ASCII)

    variants = sorted(V.DEFAULT.alias_variants, key=lambda v: (-len(v), v))
    flat = as_python(r"(?i)(?<![a-z0-9.])(?:" + "|".join(tm.literal_pattern(v) for v in variants) + r")(?![a-z0-9]|\.[a-z0-9])")
    grouped = tm.alias_pattern(V.DEFAULT)
    assert len(grouped.split("(?:")) - 2 == len({v[0].lower() for v in variants})
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice((rng.choice(variants), rng.choice(variants).upper(), " ", ", ", "s", ".", "/", "x1", "é")) for _ in range(12))
        assert [m.span() for m in as_python(grouped).finditer(text)] == [m.span() for m in flat.finditer(text)]


def test_a_term_is_sought_by_pattern_only_in_texts_that_contain_it(spark):
    from hiresift.functions import terms as tm

    rows = [("c++", "c++ and c"), ("c++", "c+"), ("sql", "mysql"), ("sql", "sqls"), ("go", "gos"), ("node.js", "nodexjs"), ("sql", None), (None, "sql")]
    df = spark.createDataFrame(rows, "t string, x string").selectExpr("*").select("t", "x", tm.term_in(F.col("t"), F.col("x")).alias("r"))
    assert "contains(" in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [bool(r.r) for r in df.collect()] == [True, False, False, True, False, False, False, False]
