"""Greedy selection and moves against slow versions that revalue everything, and documents with every fallback."""
from __future__ import annotations

import random

import pytest

from hiresift import vocab as V
from hiresift.operators import evidence as ev


def case(rng):
    n = rng.randint(0, 10)
    roles = sorted(rng.randint(1, 3) for _ in range(n))
    current = [r == 1 for r in roles]
    cost, tags, chars = ([rng.randint(1, 3) for _ in range(n)], [rng.randint(0, 2) for _ in range(n)], [rng.choice((20, 30)) for _ in range(n)])
    covers = [rng.sample("abcdefgh", rng.randint(0, 4)) for _ in range(n)]
    weights = {t: rng.choice((100, 150, 300)) for t in rng.sample("abcdefgh", rng.randint(0, 8))}
    return roles, current, cost, tags, chars, covers, weights


def value(b, picked, covers, weights):
    seen = [t for p in picked for t in covers[p]]
    return sum(weights.get(t, 0) * ([round(10 * s) for s in V.SATURATION] + [0] * 99)[seen.count(t)] for t in covers[b])


def slow_choose(roles, current, cost, tags, chars, covers, weights, max_lines, max_current, max_other):
    picked = []
    def lines():
        return sum(cost[p] for p in picked)
    for role in sorted(set(roles)):
        mine = [b for b, r in enumerate(roles) if r == role]
        for slot in range(4 if current[mine[0]] else 2):
            left = [b for b in mine if b not in picked]
            able = [b for b in left if lines() + cost[b] <= max_lines] or (left if slot == 0 else [])
            if not able:
                break
            picked.append(max(able, key=lambda b: (value(b, picked, covers, weights), tags[b], -chars[b], -b)))
    first = list(picked)
    while True:
        best = None
        for b in range(len(roles)):
            v = value(b, picked, covers, weights)
            if b in picked or v <= 0 or lines() + cost[b] > max_lines or sum(roles[p] == roles[b] for p in picked) >= (max_current if current[b] else max_other):
                continue
            if best is None or (v / cost[b], v) > best[:2]:
                best = (v / cost[b], v, b)
        if best is None:
            return first, picked, lines(), {t: sum(t in covers[p] for p in picked) for p in picked for t in covers[p] if t in weights}
        picked.append(best[2])


@pytest.mark.parametrize("limits", [(26, 5, 3), (6, 2, 1), (3, 5, 3)])
def test_lazy_choice_equals_full_revaluation(limits):
    rng = random.Random(sum(limits))
    for _ in range(500):
        given = case(rng)
        assert ev.choose(*given, *limits) == slow_choose(*given, *limits)


def test_moves_by_counts_equal_recomputed_coverage():
    rng = random.Random(5)
    for _ in range(500):
        roles, current, cost, tags, chars, covers, weights = case(rng)
        _, picked, lines, _ = ev.choose(roles, current, cost, tags, chars, covers, weights, 6, 2, 1)
        def worth(bs):
            return sum(weights.get(t, 0) for t in {t for b in bs for t in covers[b]})
        want = []
        for b in range(len(roles)):
            same = [c for c in sorted(picked) if roles[c] == roles[b]]
            if b in picked:
                continue
            want += [("swap", c, b, roles[b], (worth([*(p for p in picked if p != c), b]) - worth(picked)) / 100) for c in same if lines - cost[c] + cost[b] <= 8]
            if same and len(same) < (3 if current[b] else 2) and lines + cost[b] <= 8:
                want.append(("add", -1, b, roles[b], (worth([*picked, b]) - worth(picked)) / 100))
        assert ev.moves_of(roles, current, cost, covers, weights, picked, lines, 8, 3, 2) == want


def test_selection_of_pairs_without_bullets_or_terms(spark):
    banks = spark.createDataFrame([(1, []), (2, [(0, 1, 1, 1, True, 1, 0, 10, ["sql"])])], f"candidate_id int, bullets array<{ev.BULLET}>")
    model = spark.createDataFrame([(7, []), (8, [("sql", "3.00")])], "jd_id int, keywords array<struct<term: string, weight: string>>").selectExpr("jd_id", "transform(keywords, k -> named_struct('term', k.term, 'weight', CAST(k.weight AS DECIMAL(6, 2)))) AS keywords")
    pairs = spark.createDataFrame([(c, j) for c in (1, 2) for j in (7, 8)], "candidate_id int, jd_id int")
    got = {(r.candidate_id, r.jd_id): (r.picked, r.lines, r.counts) for r in ev.select_evidence(pairs, banks, model).collect()}
    assert got == {(1, 7): ([], 0, {}), (1, 8): ([], 0, {}), (2, 7): ([0], 1, {}), (2, 8): ([0], 1, {"sql": 1})}
    assert ev.swap_add_moves(ev.select_evidence(pairs, banks, model)).count() == 0


def test_declared_terms_need_no_bullet(spark):
    banks = spark.createDataFrame([(1, ["Excel", "k8s"], ["PMP certified", ""]), (2, None, None)], "candidate_id int, skills_extra array<string>, certifications array<string>")
    vocabulary = spark.createDataFrame([("excel",), ("kubernetes",), ("pmp",), ("sql",)], "term string")
    assert {(r.candidate_id, r.term) for r in ev.declared_terms(banks, vocabulary).collect()} == {(1, "excel"), (1, "kubernetes"), (1, "pmp")}


def small_case(spark):
    banks = spark.createDataFrame([(1, [(0, 1, 1, 1, True, 1, 0, 10, ["sql", "excel"]), (1, 1, 1, 2, True, 1, 0, 12, ["sql"])])], f"candidate_id int, bullets array<{ev.BULLET}>")
    model = spark.sql("SELECT 7 AS jd_id, array(named_struct('term', 'sql', 'weight', CAST(3 AS DECIMAL(6, 2))), named_struct('term', 'dax', 'weight', CAST(1 AS DECIMAL(6, 2)))) AS keywords")
    return spark.createDataFrame([(1, 7), (1, 7)], "candidate_id int, jd_id int"), banks, model


def test_banks_move_to_the_pairs_and_not_with_them(spark):
    pairs, banks, model = small_case(spark)
    covered = spark.createDataFrame([(1, 1, 1, "sql"), (1, 1, 2, "excel")], "candidate_id int, role_no int, bullet_no int, term string")
    weights = model.selectExpr("jd_id", "inline(keywords)")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for df in (ev.select_evidence(pairs, banks, model), ev.bullet_covers(covered, weights, pairs)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            last = next(line for line in plan.splitlines() if "hashpartitioning(" in line)
            assert "hashpartitioning(candidate_id" in last, plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_covers_and_gains_count_repeats_as_joins_do(spark):
    pairs, banks, model = small_case(spark)
    covered = spark.createDataFrame([(1, 1, 1, "sql"), (1, 1, 1, "excel"), (1, 1, 2, "sql"), (2, 1, 1, "sql")], "candidate_id int, role_no int, bullet_no int, term string")
    covers = ev.bullet_covers(covered, model.selectExpr("jd_id", "inline(keywords)"), pairs)
    assert sorted((r.candidate_id, r.jd_id, r.role_no, r.bullet_no, r.term, float(r.weight)) for r in covers.collect()) == [(1, 7, 1, b, "sql", 3.0) for b in (1, 1, 2, 2)]
    chosen = ev.select_evidence(pairs.distinct(), banks, model)
    assert sorted(tuple(r) for r in ev.times_covered(chosen).collect()) == [(1, 7, "excel", 1), (1, 7, "sql", 2)]
    twice = ev.select_evidence(pairs.distinct(), banks, model.unionByName(model))
    assert sorted(tuple(r) for r in ev.times_covered(twice).collect()) == [(1, 7, "excel", 1), (1, 7, "excel", 1), (1, 7, "sql", 2), (1, 7, "sql", 2)]
    bullets = spark.createDataFrame([(1, 1, 1, "a b"), (1, 1, 2, "c"), (1, 1, 2, "c")], "candidate_id int, role_no int, bullet_no int, text string")
    once = covers.distinct()
    counts = spark.createDataFrame([(1, 7, "sql", 1)], "candidate_id int, jd_id int, term string, n int")
    assert sorted((r.bullet_no, r.value) for r in ev.marginal_gain(once, bullets, counts).collect()) == [(1, 0.9), (2, 0.9), (2, 0.9)]
    repeated = counts.unionByName(counts)
    assert sorted((r.bullet_no, r.value) for r in ev.marginal_gain(once, bullets, repeated).collect()) == [(1, 0.3), (2, 0.3), (2, 0.3)]
    assert sorted((r.bullet_no, r.value) for r in ev.marginal_gain(once, bullets).collect()) == [(1, 3.0), (2, 3.0), (2, 3.0)]


def test_first_weight_of_a_repeated_term_counts(spark):
    pairs, banks, _ = small_case(spark)
    model = spark.sql("SELECT 7 AS jd_id, array(named_struct('term', 'excel', 'weight', 1.00BD), named_struct('term', 'excel', 'weight', 9.00BD), named_struct('term', 'dax', 'weight', 1.00BD)) AS keywords")
    got = ev.select_evidence(pairs.distinct(), banks, model, max_lines=1).first()
    assert (got.picked, got.lines, got.counts) == ([0], 1, {"excel": 1})


def test_only_moves_that_gain_are_gathered(spark):
    moves = spark.createDataFrame([(1, 7, "swap", 0, 2, 1, 0.5), (1, 7, "add", -1, 3, 1, 0.5), (1, 7, "swap", 1, 2, 1, 0.0), (2, 7, "swap", 0, 1, 1, -1.0)], "candidate_id int, jd_id int, move string, out_id int, in_id int, role_rank int, gain double")
    best = ev.best_move(moves)
    assert [tuple(r) for r in best.collect()] == [(1, 7, "add", -1, 3, 0.5)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.index("Aggregate"):], plan


def skill_case(spark):
    """One person with two bullets of a role, shared numbers and extras; one with extras alone; one unknown."""
    bullets = spark.createDataFrame([
        (1, 1, 1, 1, True, "made sql run", ["SQL", "k8s"], True), (1, 1, 1, 2, True, "kept books", ["excel"], True), (1, 1, 1, 2, True, "kept books", ["git"], True),
    ], "candidate_id int, role_rank int, role_no int, bullet_no int, is_current boolean, text string, skills array<string>, reviewed boolean")
    covered = spark.createDataFrame([(1, 1, 1, "sql"), (1, 1, 2, "excel")], "candidate_id int, role_no int, bullet_no int, term string")
    extras = spark.createDataFrame([(1, "rfp"), (1, "git"), (2, "dax"), (2, "bi")], "candidate_id int, term string")
    model = spark.sql("SELECT 7 AS jd_id, array(named_struct('term', 'excel', 'weight', 1.00BD), named_struct('term', 'sql', 'weight', 3.00BD), named_struct('term', 'rfp', 'weight', 2.00BD)) AS keywords")
    asked = ev.with_asked(model, model.selectExpr("jd_id", "inline(keywords)"))
    pairs = spark.createDataFrame([(1, 7), (1, 9), (2, 7), (2, None), (3, 7)], "candidate_id int, jd_id int")
    return pairs, ev.bank_rows(bullets, covered, tagged=True), extras, asked


def test_skills_line_of_each_pair_is_made_in_its_row(spark):
    pairs, banks, extras, asked = skill_case(spark)
    chosen = ev.select_evidence(pairs, ev.with_skills(banks, extras, how="full"), asked, every=True)
    got = {(r.candidate_id, r.jd_id): [tuple(s) for s in r.skills] for r in ev.ordered_skills(chosen, once=True).collect()}
    assert got == {
        (1, 7): [(1, "sql", "SQL"), (2, "rfp", "RFP"), (3, "excel", "Excel"), (4, "git", "Git"), (5, "kubernetes", "Kubernetes")],
        (1, 9): [(1, "git", "Git"), (2, "rfp", "RFP")], (2, 7): [(1, "bi", "BI"), (2, "dax", "DAX")], (2, None): [(1, "bi", "BI"), (2, "dax", "DAX")], (3, 7): []}
    blank = ev.select_evidence(pairs.where("candidate_id = 1"), ev.with_skills(banks, extras, how="full"), asked.selectExpr("jd_id", "if(jd_id = 7, null, keywords) AS keywords", "asked"), every=True)
    assert sorted(r.jd_id for r in blank.where("size(picked) > 0").collect()) == [7]  # a posting without keywords is a posting
    plan = ev.ordered_skills(chosen, once=True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan[:plan.index("ArrowEvalPython")], plan


def test_a_pair_that_comes_twice_has_the_skills_of_all_its_choices(spark):
    pairs, banks, extras, asked = skill_case(spark)
    twice = asked.unionByName(asked.selectExpr("jd_id", "array() AS keywords", "asked"))
    chosen = ev.select_evidence(pairs.where("jd_id = 7"), ev.with_skills(banks, extras), twice, max_lines=1)
    lines = {(r.candidate_id, tuple(s.term for s in r.skills)) for r in ev.ordered_skills(chosen).collect()}
    assert lines == {(1, ("sql", "rfp", "kubernetes", "git"))}


def test_documents_take_their_parts_from_the_bank(spark):
    pairs, banks, extras, asked = skill_case(spark)
    nested = spark.sql("""SELECT 1 AS candidate_id, named_struct('name', 'Ann', 'email', 'a@example.com') AS contact, '' AS headline,
     array(named_struct('company', 'Acme', 'title', 'Analyst', 'start', '2021-07', 'end', 'present', 'bullets', array(
       named_struct('text', 'made sql run', 'skills', array('SQL', 'k8s'), 'reviewed', 'true'), named_struct('text', 'kept books', 'skills', array('excel'), 'reviewed', 'true')))) AS roles,
     array(named_struct('degree', 'BBA', 'institution', 'College', 'year', '2014')) AS education, array('PMP', '') AS certifications""")
    rows = ev.with_document_parts(ev.with_skills(banks, extras), nested)
    chosen = ev.select_evidence(pairs.where("jd_id = 7"), rows, asked)
    documents = ev.assemble_documents(ev.ordered_skills(chosen, once=True))
    (got,) = documents.collect()
    assert got.document.split("\n") == [
        "Ann", "a@example.com", "", "Summary", "Analyst with hands-on experience in SQL and Excel.", "", "Skills", "SQL, RFP, Excel, Git, Kubernetes", "", "Experience",
        "Analyst - Acme (Jul 2021 - Present)", "- made sql run", "- kept books", "- kept books", "", "Education", "BBA - College (2014)", "", "Certifications", "PMP"]
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(candidate_id" not in plan[:plan.index("ArrowEvalPython")], plan  # nothing moves after the choice


def test_skills_lists_reach_pairs_with_their_bank(spark):
    pairs, banks, model = small_case(spark)
    listed = ev.with_listed(banks, spark.createDataFrame([(1, ["dax", "git"]), (2, ["sql"])], "candidate_id int, skills array<string>"))
    summary = ev.selection_summary(ev.select_evidence(pairs.distinct(), listed, model))
    assert [tuple(r) for r in summary.collect()] == [(1, 7, 2, ["sql"], ["dax"], [])]
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[:plan.index("ArrowEvalPython")], plan
    assert "BroadcastHashJoin" not in listed._jdf.queryExecution().executedPlan().toString()


def test_moves_read_a_bank_once_for_all_its_pairs(spark):
    rng = random.Random(9)
    cases = [case(rng) for _ in range(6)]
    banks = spark.createDataFrame([(k, [(b, r[b], r[b], b, cu[b], co[b], tg[b], ch[b], sorted(cv[b])) for b in range(len(r))]) for k, (r, cu, co, tg, ch, cv, _) in enumerate(cases)], f"candidate_id int, bullets array<{ev.BULLET}>")
    model = spark.createDataFrame([(j, [(t, f"{w / 100:.2f}") for t, w in c[-1].items()]) for j, c in enumerate(cases)], "jd_id int, keywords array<struct<term: string, weight: string>>").selectExpr(
        "jd_id", "transform(keywords, k -> named_struct('term', k.term, 'weight', CAST(k.weight AS DECIMAL(6, 2)))) AS keywords")
    pairs = spark.createDataFrame([(k, j) for k in range(6) for j in range(6)], "candidate_id int, jd_id int")
    chosen = ev.select_evidence(pairs, banks, model, max_lines=6, max_current=2, max_other=1)
    got = {}
    for m in ev.swap_add_moves(chosen, max_lines=8, max_current=3, max_other=2).collect():
        got.setdefault((m.candidate_id, m.jd_id), []).append((m.move, m.out_id, m.in_id, m.role_rank, m.gain))
    want = {}
    for k, (r, cu, co, tg, ch, cv, _) in enumerate(cases):
        for j, c in enumerate(cases):
            _, picked, lines, _ = ev.choose(r, cu, co, tg, ch, [sorted(x) for x in cv], c[-1], 6, 2, 1)
            moves = ev.moves_of(r, cu, co, [sorted(x) for x in cv], c[-1], picked, lines, 8, 3, 2)
            want |= {(k, j): moves} if moves else {}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    with_numbers = ev.Bank.of([1, 1], [True, True], [1, 1], [0, 0], [0, 0], [["a"], ["b", "a"]])
    assert ev.moves_from(with_numbers, [100, 300], [0], 1, 9, 5, 3) == [(0, 1, 300), (-1, 1, 300)]
