"""Operators on small fixtures, some against an independent brute force."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from hiresift.operators import evidence as ev
from hiresift.operators import extract as ex
from hiresift.operators import funnel as fn
from hiresift.operators import match as mt
from hiresift.operators import requirements as rq
from hiresift.operators import screen as sc
from hiresift.operators import verify as vf
from hiresift.operators import writing as wr

POSTING = """Senior Data Analyst
About us:
A consulting firm using SAP
What you'll do
- Build dashboards with Tableau
Requirements:
- 3-5 years of experience, SQL; Power BI or Tableau
- Strong SQL and Excel skills
- CRM tools (Salesforce, HubSpot, Zoho)
- React (Next.js is a plus)
- 2+ years with Spark preferred
Nice to have:
- Python, dbt
"""


def posting(spark, text=POSTING):
    return spark.createDataFrame([(1, text)], "jd_id int, jd_text string")


def test_sections_and_weights(spark):
    rows = {r.term: r for r in ex.jd_keywords(posting(spark)).collect()}
    assert rows["sql"].section == "hard" and float(rows["sql"].weight) == 3.9
    assert rows["tableau"].section == "hard" and float(rows["react"].weight) == 3.0
    assert rows["next.js"].section == "nice" and rows["python"].section == "nice" and rows["spark"].section == "nice"
    assert "sap" not in rows and "consulting" not in rows


def test_alternatives_are_directed(spark):
    alts = {r.term: set(r.alternatives) for r in ex.jd_keywords(posting(spark)).collect()}
    assert alts["power bi"] == {"tableau"} and alts["tableau"] == {"power bi"}
    assert alts["crm"] == {"salesforce", "hubspot", "zoho"} and alts["salesforce"] == {"hubspot", "zoho"}
    assert alts["sql"] == set() and alts["python"] == set()


def test_requirements(spark):
    r = rq.jd_requirements(posting(spark)).first()
    assert r.min_years == 3.0 and r.seniority == "senior" and r.jd_title == "data analyst" and r.min_degree is None


def test_searches_group_families_named_together(spark):
    r = mt.posting_model(posting(spark)).first()
    assert ["tableau", "power bi"] in r.groups and r.title == "data analyst"
    assert [s.name for s in r.searches][:2] == ["Job title", "Title + top requirement"]
    assert r.searches[-1].name == f"All top requirements ({len(r.groups)})"


def test_timeline_gap_of_seven_months_only(spark):
    rows = spark.createDataFrame([(1, 100, 110), (1, 116, 120), (1, 127, 130), (2, 5, 50), (2, 10, 20), (2, 58, 60)], "k int, start_month int, end_month int")
    got = {tuple(r) for r in sc.employment_gaps(rows, "k").collect()}
    assert got == {(1, 120, 127, 7), (2, 50, 58, 8)}


def test_close_spellings_equal_brute_force(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(150)})
    needles = sorted({"".join(c if rng.random() > 0.2 else rng.choice("abcde") for c in n) + rng.choice(["", "a"]) for n in names[:60]})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    want = {(a, b) for a in needles for b in names if 1 - distance(a, b) / max(len(a), len(b)) >= 0.75}
    index = fn.grams(spark.createDataFrame([(n,) for n in names], "company string"), "company", (1, 2, 3)).withColumn("letters", F.length("company"))
    got = fn.close_spellings(spark.createDataFrame([(n,) for n in needles], "needle string"), index, index.groupBy("gram").agg(F.count("*").alias("times")), cutoff=0.75)
    assert {(r.needle, r.company) for r in got.collect()} == want and want


def brute_select(bullets, weights, max_lines):
    """Reference greedy in plain Python over (id, role, current, cost, tags, chars, covers)."""
    sat, counts, picked, lines = (10, 3, 1), {}, [], 0
    value = lambda b: sum(weights.get(t, 0) * (sat[counts.get(t, 0)] if counts.get(t, 0) < 3 else 0) for t in b["covers"])

    def take(b):
        nonlocal lines
        picked.append(b["id"])
        lines += b["cost"]
        for t in b["covers"]:
            if t in weights:
                counts[t] = counts.get(t, 0) + 1

    for role in sorted({b["role"] for b in bullets}):
        mine = [b for b in bullets if b["role"] == role]
        for slot in range(4 if mine[0]["current"] else 2):
            left = [b for b in mine if b["id"] not in picked]
            pool = [b for b in left if lines + b["cost"] <= max_lines] or (left if slot == 0 else [])
            if not pool:
                break
            take(max(pool, key=lambda b: (value(b), b["tags"], -b["chars"], -b["id"])))
    while True:
        free = [b for b in bullets if b["id"] not in picked and lines + b["cost"] <= max_lines and value(b) > 0
                and sum(1 for x in bullets if x["role"] == b["role"] and x["id"] in picked) < (5 if b["current"] else 3)]
        if not free:
            return picked, lines
        take(max(free, key=lambda b: (value(b) / b["cost"], value(b), -b["id"])))


def test_greedy_selection_equals_brute_force(spark):
    rng = random.Random(11)
    terms = [f"t{i}" for i in range(9)]
    banks, models, pairs, want = [], [], [], {}
    for c in range(12):
        bullets, n = [], 0
        for role in range(1, rng.randint(2, 4)):
            for b in range(rng.randint(1, 7)):
                bullets.append(dict(id=n, role=role, current=role == 1, cost=rng.randint(1, 4), tags=rng.randint(0, 3), chars=rng.randint(5, 30), covers=sorted(rng.sample(terms, rng.randint(0, 4)))))
                n += 1
        banks.append((c, [(b["id"], b["role"], b["role"], b["id"] + 1, b["current"], b["cost"], b["tags"], b["chars"], b["covers"]) for b in bullets]))
        weights = {t: rng.choice([100, 150, 300, 390]) for t in rng.sample(terms, 6)}
        models.append((c, [(t, w / 100) for t, w in weights.items()]))
        pairs.append((c, c))
        want[c] = brute_select(bullets, weights, 12)
    bank_df = spark.createDataFrame(banks, f"candidate_id int, bullets array<{ev.BULLET}>")
    model_df = spark.createDataFrame(models, "jd_id int, k array<struct<term:string,weight:double>>").select("jd_id", F.transform(
        "k", lambda x: F.struct(x["term"].alias("term"), x["weight"].cast("decimal(6,2)").alias("weight"))).alias("keywords"))
    out = ev.select_evidence(spark.createDataFrame(pairs, "candidate_id int, jd_id int"), bank_df, model_df, max_lines=12)
    got = {r.candidate_id: (list(r.picked), r.lines) for r in out.collect()}
    assert got == want


def test_rewrite_reasons(spark):
    rows = [("Built 25+ dashboards in Power BI", r) for r in ("", "built 25+ dashboards in power bi", "Built", "Built dashboards in Power BI", "Built 25+ dashboards in Power BI for 3 teams",
                                                            "Built 25+ dashboards in Tableau", "Built 25+ dashboards in Power BI and SQL", "Delivered 25+ dashboards in PowerBI [99]")]
    df = spark.createDataFrame(rows, "o string, r string")
    got = [x.p for x in df.select(vf.rewrite_problem(F.col("o"), F.col("r"), F.array(F.lit("power bi"))).alias("p")).collect()]
    assert got == ["empty rewrite", "no change", "truncates the bullet", "lost number", "added number", "lost skill", "introduced skill", None]


def test_writing_joins_wrapped_lines(spark):
    text = "EXPERIENCE\nAnalyst, Acme | 2023 - Present\n- Worked on the\n  Python migration\n- Worked on x\n- Worked on y\n\nSKILLS\nPython, Java"
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    lines = {r.line_no: r.text for r in wr.join_continuations(docs, "id").collect()}
    assert lines[3] == "- Worked on the Python migration" and lines[9] == "Python, Java"
    rules = [(r.line_no, r.rule) for r in wr.review(docs, "id").orderBy("rule", "line_no").collect()]
    assert [n for n, rule in rules if rule == "repeated_opener"] == [3, 5, 6]
    assert [n for n, rule in rules if rule == "unclear_contribution"] == [3, 5, 6]


def test_correlation_needs_points_and_variance(spark):
    rows = [("flat", 5.0, "offer"), ("flat", 5.0, "ghosted"), ("flat", 5.0, "ghosted"), ("two", 1.0, "offer"), ("two", 2.0, "ghosted"),
            ("good", 1.0, "ghosted"), ("good", 2.0, "ghosted"), ("good", 9.0, "offer"), ("good", 8.0, "offer")]
    df = spark.createDataFrame(rows, "layer string, score double, outcome string")
    got = [r.layer for r in fn.summarize_correlation(df.groupBy("layer")).collect()]
    assert got == ["good"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_companies_are_found_as_by_comparing_every_pair(spark):
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(1, 12))) for _ in range(120)} | {"acme traders", "acme trading", "ab"})
    needles = sorted({n[rng.randint(0, 2):] for n in names[:40]} | {n.replace("b", "c", 1) for n in names[40:90]} | {"acme tradxrs", "a", "", "zzzz"})
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = {(r.needle, r.company, r.how) for r in fn.find_company(frame(needles, "needle"), frame(names, "company"), top=1000).collect()}
    want = set()
    for q in filter(None, needles):
        inside = {(q, n, "substring") for n in names if q in n}
        want |= inside or {(q, n, "close") for n in names if 1 - edits(q, n) / max(len(q), len(n)) >= 0.75}
    assert got == want


def test_nothing_is_rated_before_enough_outcomes(spark):
    columns = "app_id int, outcome string, visibility_score double, ats_score double, recruiter_score double, manager_score double, days_after_posting int, components string"
    rows = [(i, "offer" if i % 2 else "ghosted", float(i), float(i), 50.0 + i, None, i, '{"keyword_score": ' + str(i) + "}") for i in range(25)]
    for n, some in ((25, True), (19, False)):
        apps = spark.createDataFrame(rows[:n], columns)
        found = [fn.conversion_by_band(apps), fn.score_outcome_correlation(apps), fn.component_ranking(apps), fn.apply_timing(apps)]
        assert [(f.count() > 0) for f in found] == [some] * 4


def test_alternatives_stand_in_one_way(spark):
    model = mt.posting_model(posting(spark))
    edges = {(r.term, r.alternative) for r in mt.alternative_edges(model).collect()}
    assert ("crm", "salesforce") in edges and ("salesforce", "crm") not in edges and ("power bi", "tableau") in edges
    docs = spark.createDataFrame([(1, ["salesforce"]), (2, ["crm"]), (3, [])], "candidate_id int, terms array<string>")
    pairs = spark.createDataFrame([(c, 1) for c in (1, 2, 3)], "candidate_id int, jd_id int")
    met = {r.candidate_id: (r.n_met, r.n_by_alternative) for r in mt.met_keywords(pairs, model, mt.alternative_edges(model), docs).collect()}
    assert met == {1: (4, 3), 2: (1, 0), 3: (0, 0)}
