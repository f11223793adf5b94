"""Large vocabularies: the index gives the rows of the literal form."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import terms as tm
from hiresift.operators import extract as ex
from test_operators import POSTING

COLUMNS = ["jd_id", "term", "weight", "section", "first_pos", "rank", "alternatives"]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def postings(spark):
    more = "Requirements:\n- metadata analysis of bigdata  platforms, xyzzy frobs; Quux Core\n- KPIs, ETL and data analysis\n- quux core lines (frob, plugh)\n"
    return spark.createDataFrame([(1, POSTING), (2, more), (3, ""), (4, None), (5, POSTING + more)], "jd_id int, jd_text string")


def test_a_table_of_terms_gives_the_literal_rows(spark):
    vocab = V.DEFAULT.extended(["frob", "quux core", "plugh", "ta analysis", "quux core lines", "core l", "platform", "bigdata  platforms"])
    table = spark.createDataFrame([(t,) for t in vocab.taxonomy], "term string")
    want = rows(ex.jd_keywords(postings(spark), vocab=vocab))
    assert any(r[1] == "ta analysis" for r in want) and any(r[1] == "frob" for r in want)
    assert rows(ex.jd_keywords(postings(spark), vocabulary=table)) == want
    arrays = ex.keyword_arrays(postings(spark), vocabulary=table)
    assert arrays.columns == ["jd_id", "jd_text", "keywords"] and arrays.count() == 5


def test_two_hundred_thousand_terms_give_the_literal_rows(spark):
    rng = random.Random(1)
    many = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) + rng.choice(("", " " + rng.choice(("data", "core", "analysis")) + str(i))) for i in range(245_000)}
    vocab = V.DEFAULT.extended([*many, "quux core", "frob"])
    assert len(vocab.taxonomy) >= 200_000
    text = " ".join(r.jd_text or "" for r in postings(spark).collect()).lower()
    few = [t for t in vocab.taxonomy if t in text or t in V.DEFAULT.taxonomy]
    want = rows(ex.jd_keywords(postings(spark), vocab=V.Vocabulary(taxonomy=tuple(few))))
    assert rows(ex.jd_keywords(postings(spark), vocab=vocab)) == want


def test_phrase_index_finds_phrases_within_words(spark):
    docs = spark.createDataFrame([(1, "a big data set"), (2, "xbig datasets"), (3, None), (4, "big  data"), (4, "big data"), (5, "")], "k int, text string")
    terms = ["big data", "g d", "big data set", "data", "a b", "big datasets x", "a big data set"]
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.k, r.term) for r in tm.phrase_index(docs, ["k"], F.col("text"), table).collect()}
    want = {(r.k, t) for r in docs.collect() for t in terms if " " in t and t in (r.text or "")}
    assert got == want
