"""Best postings and coverage pairs against brute force, with waves of one posting, hot terms, ties and empty rows."""
from __future__ import annotations

import random
from collections import defaultdict

import pytest

from hiresift.operators import ranking as rk


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    terms = ["everywhere", *(f"t{i}" for i in range(25))]

    def search():
        return [rng.sample(terms, rng.choice((1, 1, 2))) for _ in range(rng.randint(1, 3))]

    postings = [(i, [("s", g) for g in (search() for _ in range(rng.choice((0, 1, 2, 4, 6))))]) for i in range(60)]
    postings += [(100, None), (101, []), (102, [("s", [["everywhere"]])])]
    docs = [(i, ["everywhere", *rng.sample(terms, rng.randint(0, 12))]) for i in range(40)]
    docs += [(50, []), (51, None), (52, terms), (52, terms), (53, ["unknown"])]
    return docs, postings


def frames(spark, tables):
    docs, postings = tables
    return (spark.createDataFrame(docs, "doc_id long, terms array<string>").repartition(3),
            spark.createDataFrame(postings, "jd_id long, searches array<struct<name: string, groups: array<array<string>>>>"))


def plain_best(docs, postings, k):
    out = []
    for d, held in {d: h for d, h in docs}.items():
        rows = []
        for j, searches in postings:
            n = len(searches or [])
            hits = sum(all(set(g) & set(held or []) for g in groups) for _, groups in searches or [])
            rows.append((-(hits / n) if n else 1, j, n, hits))
        out += [(d, j, n, hits, i + 1) for i, (_, j, n, hits) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("k", "wave_bytes"), [(1, 1 << 20), (5, 1 << 20), (5, 1), (100, 400)])
def test_best_postings_equal_brute_force(spark, tables, k, wave_bytes):
    docs, postings = frames(spark, tables)
    rows = rk.best_postings(docs, postings, doc="doc_id", k=k, wave_bytes=wave_bytes).collect()
    assert sorted((r.doc_id, r.jd_id, r.n_searches, r.n_matched, r["rank"]) for r in rows) == plain_best(*tables, k)
    assert all((r.score is None) == (r.n_searches == 0) for r in rows)


def test_best_postings_of_nothing(spark, tables):
    docs, postings = frames(spark, tables)
    assert rk.best_postings(docs.limit(0), postings, doc="doc_id").count() == 0
    assert rk.best_postings(docs, postings.limit(0), doc="doc_id").count() == 0


@pytest.mark.parametrize("wave_bytes", [1 << 20, 1])
def test_coverage_pairs_equal_brute_force(spark, tables, wave_bytes):
    rng = random.Random(2)
    docs = [r for r in tables[0] if r[0] != 52] + [(52, ["t1", "t1", "t2"])]
    keywords = [(j, t, w) for j in range(20) for t, w in {rng.choice(["everywhere", "t1", "t2", "t3", "t4", "zz"]): rng.choice((1.25, 3.0, 0.4)) for _ in range(4)}.items()]
    kw = spark.createDataFrame(keywords, "jd_id long, term string, weight double").selectExpr("jd_id", "term", "CAST(weight AS DECIMAL(6, 2)) AS weight")
    rows = rk.coverage_pairs(spark.createDataFrame(docs, "doc_id long, terms array<string>"), kw, doc="doc_id", wave_bytes=wave_bytes).collect()
    want = defaultdict(lambda: [0, 0.0])
    for d, held in docs:
        for j, t, w in keywords:
            if t in (held or []):
                want[d, j][0] += 1
                want[d, j][1] += w
    total = defaultdict(float)
    for j, _, w in keywords:
        total[j] += w
    assert {(r.doc_id, r.jd_id): (r.n_matched, round(r.matched_weight, 2)) for r in rows} == {p: (n, round(w, 2)) for p, (n, w) in want.items()}
    assert all(abs(r.score - 100 * r.matched_weight / total[r.jd_id]) <= 0.0501 for r in rows)
