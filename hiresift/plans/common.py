"""Inputs shared by the registered queries, and SQL fragments shared by their oracles."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import text as tx
from hiresift.operators import extract as ex
from hiresift.operators import match as mt
from hiresift.operators import screen as sc
from hiresift.operators import requirements as rq
from hiresift.plans import derived as D
from hiresift.plans.tables import Tables
from hiresift.session import materialize
from hiresift.sources import bank as bk
from hiresift.sources import profiles as pf

AS_OF_MONTH = 2024 * 12 + 1
AS_OF_DATE = "1999-01-01"


def postings(t: Tables) -> DataFrame:
    return t.sql(D.POSTING)


def resumes(t: Tables) -> DataFrame:
    return t.sql(D.RESUME)


def profiles(t: Tables) -> DataFrame:
    return pf.coerce_profiles(t.sql(D.PROFILE_RAW))


def banks(t: Tables) -> DataFrame:
    return t.sql(D.BANK_NESTED)


def bullets(t: Tables) -> DataFrame:
    return bk.flatten_evidence_bank(banks(t))


def pairs(t: Tables) -> DataFrame:
    """Every pair once.  Pairs are dealt by posting before repeats are dropped, as the joins after it want them."""
    return t.sql(D.PAIR.replace("DISTINCT ", "")).repartition("jd_id").distinct()


def applications(t: Tables) -> DataFrame:
    """The log, with days after posting from the order's first shipment."""
    ship = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s"))
    dates = t.orders.join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("app_id"), F.date_diff("s", "o_orderdate").alias("days_after_posting"))
    return t.sql(D.APPLICATION).join(dates, "app_id")


def outcome_events(t: Tables) -> DataFrame:
    """User events read as outcome events of one application per user."""
    kinds = {"view": "pending", "click": "recruiter_call", "signup": "interview", "purchase": "offer", "error": "rejected_auto"}
    note = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("n"), F.col("event_id").cast("string")))
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("app_id"), tx.lookup(kinds, F.col("event_type"), F.col("event_type")).alias("outcome"), note.alias("notes"))


BENCH_WORD = r"[\p{L}\p{N}]*[a-z0-9][\p{L}\p{N}]*"


def bench_words(t: Tables) -> DataFrame:
    """(jd_id, n, pos, term): the words of benchmark passages, read as postings, by line and place.  Every word that
    has a letter a-z or a digit counts; others have no end that a boundary test could see."""
    lines = t.benchmark.select(F.col("item_id").alias("jd_id"), F.posexplode(F.split(F.lower("text"), "\n")).alias("n", "line"))
    return lines.select("jd_id", "n", F.posexplode(tx.find_all(F.col("line"), BENCH_WORD)).alias("pos", "term"))


def bench_titles(t: Tables) -> DataFrame:
    """(jd_id, title): the first two words of the first line, a term of two words."""
    first = bench_words(t).where("n = 0 and pos < 2").groupBy("jd_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("w"))
    return first.select("jd_id", F.array_join(ar.field(F.col("w"), "term"), " ").alias("title"))


def bench_keywords(t: Tables) -> DataFrame:
    """Every word of a passage and its title as weighted terms; the first line carries requirements."""
    words = bench_words(t).select("jd_id", F.when(F.col("n") == 0, 3.0).otherwise(1.0).cast("decimal(6,2)").alias("weight"), "term")
    titles = bench_titles(t).select("jd_id", F.lit(3.0).cast("decimal(6,2)").alias("weight"), F.col("title").alias("term"))
    return words.unionByName(titles).groupBy("jd_id", "term").agg(F.max("weight").alias("weight"))


def bench_searches(t: Tables, keywords: DataFrame) -> DataFrame:
    """(jd_id, searches) of every passage: its title and its six heaviest, then longest words, a group each."""
    order = F.struct((-F.col("weight")).alias("w"), (-F.length("term")).alias("l"), F.col("term"))
    words = keywords.where(~F.contains("term", F.lit(" ")))
    top = words.groupBy("jd_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, V.MAX_SEARCH_TERMS).alias("top"))
    items = t.benchmark.select(F.col("item_id").alias("jd_id")).join(top, "jd_id", "left").join(bench_titles(t), "jd_id", "left")
    groups = F.transform(F.coalesce("top", F.array().cast(top.schema["top"].dataType)), lambda s: F.array(s["term"]))
    return items.select("jd_id", mt.build_searches(F.coalesce("title", F.lit("")), groups).alias("searches"))


def posting_models(t: Tables, *names: str) -> DataFrame:
    """The posting models, or only some of their columns: the others are then neither read out nor written."""
    wide = mt.posting_model(postings(t))
    return materialize(wide.select("jd_id", *names) if names else wide, "postings")


def candidate_terms(t: Tables, model: DataFrame) -> DataFrame:
    vocabulary = materialize(mt.vocabulary_of(model), "vocabulary")
    return mt.document_terms(resumes(t), vocabulary, key="candidate_id")


def screened(t: Tables, paired: DataFrame | None = None, model: DataFrame | None = None) -> DataFrame:
    """The screen of all pairs for results that cite nothing."""
    facts = materialize(sc.resume_facts(resumes(t).select("candidate_id", "text"), AS_OF_MONTH), "facts")
    return sc.screen(materialize(pairs(t), "pairs") if paired is None else paired, profiles(t), requirements(t), facts, must_have=must_have(t, model), cited=False)


def must_have(t: Tables, model: DataFrame | None = None) -> DataFrame:
    """The ten heaviest terms of every posting; a posting model has read them already."""
    keywords = model if model is not None else ex.keyword_arrays(postings(t), alternatives=False).select("jd_id", "keywords")
    return materialize(sc.must_have_terms(keywords), "must-have")


def requirements(t: Tables, *names: str) -> DataFrame:
    """The requirement records, or only some of their columns: the others are then neither read out nor written."""
    wide = rq.jd_requirements(postings(t))
    return materialize(wide.select("jd_id", *names) if names else wide, "requirements")


def joined(array_column: str, sep: str = "|"):
    return F.array_join(array_column, sep)


# ------------------------------------------------------------------ oracle fragments (DuckDB)

WS = "' ' || chr(9) || chr(10) || chr(13)"
ORACLE_LINES = """SELECT {key}, line_no, trim(raw, {ws}) AS line, raw FROM (
 SELECT {key}, unnest(string_split_regex({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS raw,
 generate_subscripts(string_split_regex({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) AS line_no FROM {src})
 WHERE trim(raw, {ws}) <> ''"""


def oracle_lines(src: str, key: str, text: str) -> str:
    return ORACLE_LINES.format(src=src, key=key, text=text, ws=WS)


BENCH_KW = r"""bw AS (SELECT jd_id, n, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (
  SELECT jd_id, n, regexp_extract_all(line, '[\p{L}\p{N}]*[a-z0-9][\p{L}\p{N}]*') AS w FROM (
   SELECT item_id AS jd_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(lower(text), chr(10)), 1) AS n FROM benchmark))),
 bti AS (SELECT jd_id, string_agg(term, ' ' ORDER BY pos) AS title FROM bw WHERE n = 1 AND pos <= 2 GROUP BY 1),
 kw AS (SELECT jd_id, term, max(weight) AS weight FROM (SELECT jd_id, CASE WHEN n = 1 THEN 3.0 ELSE 1.0 END AS weight, term FROM bw UNION ALL SELECT jd_id, 3.0, title FROM bti) GROUP BY 1, 2)"""
# every document against every term, by the boundary test itself
DOC_INDEX = """hay AS (SELECT doc_id, ' ' || lower(text) || ' ' AS x FROM documents), terms AS (SELECT DISTINCT term FROM kw),
 idx AS (SELECT doc_id, term FROM hay, terms WHERE contains(x, term) AND regexp_matches(x, '[^a-z0-9]' || term || CASE WHEN ends_with(term, 's') OR length(term) <= 2 THEN '' ELSE 's?' END || '[^a-z0-9]'))"""
