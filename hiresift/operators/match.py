"""Coverage, searches and reports over (document, posting) pairs.

Each side is read once: postings become a `posting_model` row (keywords, searches), documents become a
`document_model` row (features, the vocabulary terms they hold).  Pairs then meet by id and compare arrays, so
the cost is one compact row per pair instead of one per pair and term.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import terms as tm
from hiresift.functions import text as tx
from hiresift.operators import extract as ex
from hiresift.operators import requirements as rq

# ---- fixed patterns
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_RUN = r"[\d()+][\d()+\s.-]{7,}\d"
LINK = (r"(?i)(?:https?://|www\.)[^\s,;|]+|\b(?:linkedin\.com|github\.com|gitlab\.com|behance\.net|dribbble\.com)/[^\s,;|]+"
        r"|\bmedium\.com/@?[^\s,;|]+")
STANDARD_SECTIONS = {
    "experience": r"\b(?:work experience|professional experience|employment history|experience)\b",
    "education": r"\b(?:education|academic background)\b",
    "skills": r"\b(?:skills|technical skills|core competencies)\b",
    "summary": r"\b(?:summary|objective|profile)\b",
}
CORE_SECTIONS = ("experience", "education", "skills")
DATE_STYLES = {
    "Mon YYYY": r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+(?:19|20)\d{2}\b",
    "MM/YYYY": r"\b(?:0?[1-9]|1[0-2])/(?:19|20)\d{2}\b",
    "YYYY-MM": r"\b(?:19|20)\d{2}-(?:0?[1-9]|1[0-2])\b",
}
MIN_WORDS = 100


# ------------------------------------------------------------------ document features

def has_phone(text: Column) -> Column:
    digits = lambda run: F.length(F.regexp_replace(run, r"[^\d]", ""))
    return F.exists(tx.find_all(text, PHONE_RUN), lambda r: digits(r).between(9, 15))


def document_features(docs: DataFrame, *, text: str = "text", file_type: str | None = "file_type") -> DataFrame:
    """Adds the parse facts of each document."""
    body, kind = F.col(text), F.col(file_type) if file_type else F.lit("text")
    lower = F.lower(body)
    present = {s: tx.matches(lower, p) for s, p in STANDARD_SECTIONS.items()}
    names = lambda flip: F.array_compact(F.array(*[F.when(~c if flip else c, F.lit(s)) for s, c in present.items()]))
    df = docs.select(
        "*", F.size(tx.words(body)).alias("word_count"), tx.matches(body, EMAIL).alias("has_email"),
        has_phone(body).alias("has_phone"), tx.matches(body, LINK).alias("has_links"),
        names(False).alias("sections_found"), names(True).alias("sections_missing"),
        (kind == "pdf_multicol").alias("multi_column"), (kind == "docx_tables").alias("has_tables"),
        F.array_compact(F.array(*[F.when(tx.matches(body, p), F.lit(n)) for n, p in DATE_STYLES.items()])).alias("date_styles"),
    )
    notes = F.array_compact(F.array(
        F.when(F.col("word_count") < MIN_WORDS, "few words"), F.when(F.col("multi_column"), "multiple columns"),
        F.when(F.col("has_tables"), "tables"), F.when(~F.col("has_email"), "no email"),
        F.when(~F.col("has_phone"), "no phone"), F.when(~F.col("has_links"), "no profile link"),
        F.when(F.size("date_styles") > 1, "mixed date formats"), F.when(F.size("sections_missing") > 0, "missing sections")))
    return df.withColumn("warnings", notes)


def formatting_score() -> Column:
    off = lambda flag, points: F.when(flag, points).otherwise(0)
    lost = (15 * F.size("sections_missing") + off(~F.col("has_email"), 15) + off(~F.col("has_phone"), 10)
            + off(F.col("multi_column"), 20) + off(F.col("has_tables"), 10) + off(F.col("word_count") < MIN_WORDS, 15))
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost))


def gate_checks() -> Column:
    """array<struct<name, status>> over document_features columns."""
    check = lambda name, ok, bad: F.struct(F.lit(name).alias("name"), F.when(ok, "pass").otherwise(bad).alias("status"))
    core_missing = F.arrays_overlap("sections_missing", tx.constant_array(CORE_SECTIONS))
    return F.array(
        check("Text extraction", F.col("word_count") >= MIN_WORDS, "fail"),
        check("Single-column layout", ~F.col("multi_column"), "fail"),
        check("No tables", ~F.col("has_tables"), "warn"), check("Email", F.col("has_email"), "fail"),
        check("Phone", F.col("has_phone"), "warn"), check("Standard section headers", ~core_missing, "warn"))


def parse_safe() -> Column:
    return (F.col("word_count") >= MIN_WORDS) & ~F.col("multi_column") & F.col("has_email")


def parse_gate(features: DataFrame, key: str) -> DataFrame:
    """One row per (document, check) with the document's overall verdict."""
    return ar.unpack(features.withColumn("safe", parse_safe()), [key, "safe"], gate_checks(), "name")


# ------------------------------------------------------------------ keywords over whole tables (see ranking)

def merged_keywords(keywords: DataFrame, vocab: V.Vocabulary = V.DEFAULT) -> DataFrame:
    """One row per (posting, canonical term) with the larger weight; repeats never add up."""
    return keywords.groupBy("jd_id", tm.canonical(F.col("term"), vocab).alias("term")).agg(F.max("weight").alias("weight"))


# ------------------------------------------------------------------ posting model

def searchable_terms(keywords: Column, title: Column) -> Column:
    """Up to six requirement terms a recruiter would type, strongest first."""
    initials = F.array_join(F.transform(tx.words(title), lambda w: F.substring(w, 1, 1)), "")
    eligible = F.filter(keywords, lambda k: (
        ~tx.among(k["term"], V.NOT_SEARCHED) & k["section"].isin(*V.HARD_SECTIONS)
        & ~((F.length(k["term"]) >= 2) & F.contains(initials, k["term"])) & ~((title != "") & tm.term_in(k["term"], title))))
    return F.slice(F.array_distinct(ar.field(eligible, "term")), 1, V.MAX_SEARCH_TERMS)


def family_of(term: Column) -> Column:
    return tx.lookup({t: i for i, fam in enumerate(V.FAMILIES) for t in fam}, term)


def skill_groups(terms: Column, lines: Column) -> Column:
    """OR-groups, strongest first: same-family terms share a group only when one line names both."""
    families = F.array_compact(F.transform(terms, family_of))
    # lines are read only when two terms could share a group at all
    shared = F.size(F.array_distinct(families)) < F.size(families)
    read = F.transform(lines, lambda s: ar.let(tm.searchable(s["line"]), lambda hay: F.filter(terms, lambda t: tm.term_in(t, hay))))
    named = F.when(shared, read).otherwise(F.array().cast("array<array<string>>"))

    def fold(co_lines: Column) -> Column:
        empty = F.array().cast("array<struct<term:string,group_no:int>>")

        def place(placed: Column, term: Column) -> Column:
            partner = F.get(F.filter(placed, lambda p: (family_of(p["term"]) == family_of(term)) & F.exists(
                co_lines, lambda ln: F.array_contains(ln, term) & F.array_contains(ln, p["term"]))), 0)
            fresh = F.coalesce(F.array_max(ar.field(placed, "group_no")), F.lit(0)) + 1
            return F.concat(placed, F.array(F.struct(
                term.alias("term"), F.coalesce(partner["group_no"], fresh).cast("int").alias("group_no"))))

        return F.aggregate(terms, empty, place)

    def gather(placed: Column) -> Column:
        groups = F.array_sort(F.array_distinct(ar.field(placed, "group_no")))
        return F.transform(groups, lambda g: F.transform(F.filter(placed, lambda p: p["group_no"] == g), lambda p: p["term"]))

    return ar.let(ar.let(named, fold), gather)


def build_searches(title: Column, groups: Column) -> Column:
    """array<struct<name, groups>>, loosest to strictest."""
    def searches(g: Column, t: Column) -> Column:
        n, titled = F.size(g), F.size(t) > 0
        one = lambda cond, name, gs: F.when(cond, F.struct(name.alias("name"), gs.alias("groups")))
        return F.array_compact(F.array(
            one(titled, F.lit("Job title"), t),
            one(titled & (n >= 1), F.lit("Title + top requirement"), F.concat(t, F.slice(g, 1, 1))),
            one(n >= 2, F.lit("Top two requirements"), F.slice(g, 1, 2)),
            one(n >= 3, F.lit("Core stack (top three)"), F.slice(g, 1, 3)),
            one(titled & (n >= 3), F.lit("Title + core stack"), F.concat(t, F.slice(g, 1, 3))),
            one(n >= 4, F.format_string("All top requirements (%d)", n), g)))

    none = F.array().cast("array<array<string>>")
    return ar.let(groups, lambda g: ar.let(F.when(title != "", F.array(F.array(title))).otherwise(none), lambda t: searches(g, t)))


def render_group(group: Column) -> Column:
    quoted = F.transform(group, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    return F.when(F.size(group) == 1, F.get(quoted, 0)).otherwise(
        F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")")))


def render_query(groups: Column) -> Column:
    return F.array_join(F.transform(groups, render_group), " AND ")


def posting_model(postings: DataFrame, *, text: str = "jd_text", top_n: int = 40,
                  vocab: V.Vocabulary = V.DEFAULT) -> DataFrame:
    """(jd_id, keywords, title, groups, searches): everything a pair comparison needs from a posting."""
    lines = F.col("_lines")  # read once, for the keywords, the title and the groups
    base = postings.select("jd_id", ex.sectioned_lines(F.col(text)).alias("_lines")).select(
        "jd_id", ex.keywords_in(lines, top_n=top_n, vocab=vocab).alias("keywords"),
        tm.searchable(F.coalesce(tx.clean_title(rq.title_line(lines)), F.lit("")), vocab).alias("title"), "_lines")
    terms = ar.let(F.col("title"), lambda t: searchable_terms(F.col("keywords"), t))
    grouped = base.withColumn("groups", ar.let(terms, lambda ts: ar.let(F.col("_lines"), lambda ls: skill_groups(ts, ls))))
    return grouped.withColumn("searches", build_searches(F.col("title"), F.col("groups"))).drop("_lines")


def vocabulary_of(model: DataFrame) -> DataFrame:
    """Every term any pair comparison may look up: keywords, their alternatives, titles."""
    wanted = F.concat(
        ar.field(F.col("keywords"), "term"), F.flatten(ar.field(F.col("keywords"), "alternatives")), F.array("title"))
    return model.select(F.explode_outer(wanted).alias("term")).where("term <> ''").distinct()


def vocabulary_of_searches(model: DataFrame) -> DataFrame:
    """(term) of every group of every search."""
    wanted = F.flatten(F.flatten(F.transform("searches", lambda s: s["groups"])))
    return model.select(F.explode_outer(wanted).alias("term")).where("term <> ''").distinct()


def document_terms(docs: DataFrame, vocabulary: DataFrame, *, key: str, text: str = "text",
                   shape: tm.Shape | None = None, vocab: V.Vocabulary = V.DEFAULT) -> DataFrame:
    """(key, terms): the vocabulary terms each document holds; documents with none keep an empty array."""
    index = tm.term_index(docs, [key], tm.searchable(F.col(text), vocab), vocabulary, shape)
    held = index.groupBy(key).agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return docs.select(key).join(held, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


# ------------------------------------------------------------------ pair comparisons (array columns)

def keyword_met(k: Column, held: Column) -> Column:
    """A requirement is met by its term or by any listed alternative."""
    return F.array_contains(held, k["term"]) | F.arrays_overlap(k["alternatives"], held)


def alternative_edges(model: DataFrame) -> DataFrame:
    """(jd_id, term, alternative): what stands in for what, as written.  Directed: a head is met by its members, a member
    by the others of its list, never a member by its head."""
    edges = F.flatten(F.transform("keywords", lambda k: F.transform(k["alternatives"], lambda a: F.struct(k["term"].alias("term"), a.alias("alternative")))))
    return ar.unpack(model, ["jd_id"], edges, "term").distinct()


def met_keywords(pairs: DataFrame, model: DataFrame, edges: DataFrame, documents: DataFrame, *, doc: str = "candidate_id") -> DataFrame:
    """(doc, jd_id, n_met, n_by_alternative, met_weight) of each pair: keywords held, or met by an edge to a term that is.

    Edges are gathered by posting, a list bounded by its own text; pairs compare them with the terms a document holds.
    """
    by_posting = edges.groupBy("jd_id").agg(F.collect_list(F.struct("term", "alternative")).alias("edges"))
    asked = model.select("jd_id", F.transform("keywords", lambda k: F.struct(k["term"].alias("term"), k["weight"].alias("weight"))).alias("keywords")).join(by_posting, "jd_id", "left")
    asked = asked.withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<term:string,alternative:string>>")))
    rows = pairs.select(doc, "jd_id").join(asked, "jd_id").join(documents.select(doc, "terms"), doc)
    # what a document holds is first cut to what the posting names: the tests after it read a few terms
    named = F.concat(ar.field(F.col("keywords"), "term"), ar.field(F.col("edges"), "alternative"))
    rows = rows.withColumn("_held", F.array_intersect(named, "terms"))
    by_edge = rows.withColumn("_in", ar.field(F.filter("edges", lambda e: F.array_contains("_held", e["alternative"])), "term"))
    held = F.filter("keywords", lambda k: F.array_contains("_held", k["term"]))
    other = F.filter("keywords", lambda k: ~F.array_contains("_held", k["term"]) & F.array_contains("_in", k["term"]))
    return by_edge.select(doc, "jd_id", held.alias("_h"), other.alias("_o")).select(
        doc, "jd_id", (F.size("_h") + F.size("_o")).alias("n_met"), F.size("_o").alias("n_by_alternative"),
        weight_of(F.concat("_h", "_o")).cast("double").alias("met_weight"))


def total_of(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0).cast("decimal(18,2)"), lambda acc, w: (acc + w).cast("decimal(18,2)"))


def weight_of(keywords: Column) -> Column:
    return total_of(ar.field(keywords, "weight"))


def keyword_score(keywords: Column, held: Column) -> Column:
    met = weight_of(F.filter(keywords, lambda k: keyword_met(k, held)))
    return F.coalesce(tx.ratio_pct(met, weight_of(keywords)), F.lit(0.0))


def matched_terms(held: Column) -> Column:
    """struct<matched, missing> of a pair from the columns of `asked_terms`: the terms asked for, in their order, that the
    document meets and those it does not.  What it holds is first cut to what the posting asks, and each term is tested once."""
    def read(h: Column) -> Column:
        met = F.transform("asked", lambda term, i: F.array_contains(h, term) | F.arrays_overlap(F.get("alternatives", i), h))
        return ar.let(met, lambda m: F.struct(
            F.filter("asked", lambda term, i: F.get(m, i)).alias("matched"), F.filter("asked", lambda term, i: ~F.get(m, i)).alias("missing")))

    return ar.let(F.array_intersect(F.concat("asked", F.flatten("alternatives")), held), read)


def group_matched(group: Column, held: Column) -> Column:
    return F.arrays_overlap(group, held)


def searches_of(model: DataFrame) -> DataFrame:
    """(jd_id, groups, shown, asked_searches): a posting's searches, written out once for all its pairs.

    A group that several searches ask for stands once, beside how it is written; a search is its name, its query and the
    places of its groups.
    """
    wide = model.select("jd_id", "searches", F.array_distinct(F.flatten(ar.field(F.col("searches"), "groups"))).alias("groups"))
    written = F.transform("searches", lambda s: F.struct(
        s["name"].alias("name"), render_query(s["groups"]).alias("query"),
        F.transform(s["groups"], lambda g: F.array_position("groups", g).cast("int") - 1).alias("needs")))
    return wide.select("jd_id", "groups", F.transform("groups", render_group).alias("shown"), written.alias("asked_searches"))


def evaluated_searches(held: Column) -> Column:
    """array<struct<name, query, matched, missing>> of a pair from the columns of `searches_of`; each group is tested once."""
    def read(hits: Column) -> Column:
        return F.transform("asked_searches", lambda s: F.struct(
            s["name"].alias("name"), s["query"].alias("query"), F.forall(s["needs"], lambda p: F.get(hits, p)).alias("matched"),
            F.array_join(F.transform(F.filter(s["needs"], lambda p: ~F.get(hits, p)), lambda p: F.get("shown", p)), "; ").alias("missing")))

    return ar.let(F.array_intersect(F.flatten("groups"), held), lambda h: ar.let(F.transform("groups", lambda g: group_matched(g, h)), read))


def visibility_score(searches: Column, held: Column) -> Column:
    hit = F.size(F.filter(searches, lambda s: F.forall(s["groups"], lambda g: group_matched(g, held))))
    return tx.ratio_pct(hit, F.size(searches))


def paired(pairs: DataFrame, model: DataFrame, documents: DataFrame, *, doc: str = "candidate_id") -> DataFrame:
    """Pairs joined to both models by id; neither side's text takes part."""
    return pairs.select(doc, "jd_id").join(model, "jd_id").join(documents, doc)


def composite(formatting: Column, keyword: Column, fit: Column) -> Column:
    """Legacy composite; without a fit score the other two weights apply.  Decimal arithmetic, so the rounding
    never depends on how a binary sum happens to fall."""
    def mean(parts) -> Column:
        total = sum((c.cast("decimal(9,2)") * F.lit(round(w * 100)) for c, w in parts), F.lit(0))
        return F.bround((total / 100).cast("decimal(18,4)"), 1).cast("double")

    w, nw = V.COMPOSITE_WEIGHTS, V.COMPOSITE_WEIGHTS_NO_FIT
    full = mean([(formatting, w["formatting"]), (keyword, w["keyword"]), (fit, w["semantic"])])
    return F.when(fit.isNotNull(), full).otherwise(mean([(formatting, nw["formatting"]), (keyword, nw["keyword"])]))


# ------------------------------------------------------------------ supplied answers

def fit_score(answer: Column) -> Column:
    """0-100 from a parsed answer; junk counts 0, a missing answer stays null."""
    kind = F.schema_of_variant(F.try_variant_get(answer, "$.semantic_score", "variant"))
    value = F.try_variant_get(answer, "$.semantic_score", "string")
    text_number = F.when(tx.matches(F.trim(value), r"^[+-]?\d+$"), F.trim(value)).try_cast("double")
    number = (F.when(kind == "STRING", text_number).when(kind == "BOOLEAN", F.when(value == "true", 1.0).otherwise(0.0))
              .otherwise(value.try_cast("double")))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(number, F.lit(0.0))))
    return F.when(answer.isNotNull(), F.floor(clamped).cast("int"))


def rubric_dimension(answer: Column, name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(answer, f"$.{name}", "variant"))
    usable = lambda value: value.isNotNull() & ~F.isnan(value) & (kind != "BOOLEAN")
    return ar.let(F.try_variant_get(answer, f"$.{name}", "string").try_cast("double"), lambda value: F.when(
        usable(value), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), 0).cast("int")))


def rubric_score(answer: Column) -> Column:
    """Weighted mean over the dimensions present; null when they carry under half the weight."""
    # whole hundredths keep the weight sums exact
    weights = [round(w * 100) for w in V.RUBRIC_WEIGHTS.values()]

    def mean(dims: Column) -> Column:
        each = [F.get(dims, i) for i in range(len(weights))]
        scored = sum((F.when(d.isNotNull(), w).otherwise(0) for d, w in zip(each, weights)), F.lit(0))
        total = sum((F.coalesce(d * w, F.lit(0)) for d, w in zip(each, weights)), F.lit(0))
        return F.when(scored >= 50, F.bround(total / scored, 0).cast("int"))

    return F.when(answer.isNotNull(), ar.let(F.array(*[rubric_dimension(answer, n) for n in V.RUBRIC_WEIGHTS]), mean))


ANSWER_LISTS = {"weak_bullets": 5, "interview_risks": 4, "strengths": None, "gaps": None, "reworded_matches": None}


def answer_findings(answers: DataFrame, key: list[str], answer: str = "answer") -> DataFrame:
    """(key, kind, item_no, text, problem, rewrite): the lists inside supplied answers, long."""
    def items(name: str, cap: int | None) -> Column:
        raw = F.coalesce(F.try_variant_get(F.col(answer), f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        listed = raw if cap is None else F.slice(raw, 1, cap)
        get = lambda v, path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
        if name == "weak_bullets":
            listed = F.filter(listed, lambda v: F.schema_of_variant(v).startswith("OBJECT"))
            return F.transform(listed, lambda v, i: F.struct(
                F.lit(name).alias("kind"), (i + 1).alias("item_no"), get(v, "$.bullet").alias("text"),
                get(v, "$.problem").alias("problem"), get(v, "$.rewrite").alias("rewrite")))
        none = F.lit(None).cast("string")
        return F.transform(listed, lambda v, i: F.struct(
            F.lit(name).alias("kind"), (i + 1).alias("item_no"), v.cast("string").alias("text"), none.alias("problem"), none.alias("rewrite")))

    return ar.unpack(answers, key, F.concat(*[items(n, c) for n, c in ANSWER_LISTS.items()]), "kind")


# ------------------------------------------------------------------ full report

NOTES = {"fit_score": "fit not scored: formatting and keywords only", "rubric_score": "rubric not scored", "recruiter_score": "no screen of this pair"}


ANSWER_SCORES = {"fit_score": "int", "rubric_score": "int"}
SCREEN_SCORES = {"criteria_met_pct": "double", "resume_pct": "double", "candidacy_pct": "double"}


def answer_scores(answers: DataFrame) -> DataFrame:
    """The rows with the scores of their `fit` and `rubric` answers in place of the answers.

    Bound with `let`, which keeps them out of the generated code: together they make a method too long to be compiled.
    """
    scores = {"fit_score": ar.let(F.col("fit"), fit_score), "rubric_score": ar.let(F.col("rubric"), rubric_score)}
    return answers.withColumns(scores).drop("fit", "rubric")


def asked_of(model: DataFrame) -> DataFrame:
    """(jd_id, title, asked, weights, alternatives, total_weight, groups, needs): what a pair takes along of its posting.

    Keywords are arrays side by side, a group that several searches ask for stands once, and `needs` holds the places of
    each search's groups.
    """
    wide = model.select("jd_id", "title", "keywords", "searches", F.array_distinct(F.flatten(ar.field(F.col("searches"), "groups"))).alias("groups"))
    part = lambda name: ar.field(F.col("keywords"), name)
    needs = F.transform("searches", lambda s: F.transform(s["groups"], lambda g: F.array_position("groups", g).cast("int") - 1))
    return wide.select("jd_id", "title", part("term").alias("asked"), part("weight").alias("weights"), part("alternatives").alias("alternatives"),
                       weight_of(F.col("keywords")).alias("total_weight"), "groups", needs.alias("needs"))


def asked_terms(model: DataFrame) -> DataFrame:
    """(jd_id, asked, alternatives): of `asked_of` what `matched_terms` reads."""
    part = lambda name: ar.field(F.col("keywords"), name).alias(name)
    return model.select("jd_id", part("term").alias("asked"), part("alternatives"))


def asked_scores(held: Column) -> Column:
    """struct<keyword_score, visibility_score, title_found> of a pair from the columns of `asked_of`.

    What the document holds is first cut to what the posting asks: the tests that follow then read a few terms.
    """
    asked = F.concat("asked", F.flatten("alternatives"), F.flatten("groups"), F.array("title"))

    def read(h: Column) -> Column:
        met = F.filter("weights", lambda w, i: F.array_contains(h, F.get("asked", i)) | F.arrays_overlap(F.get("alternatives", i), h))
        found = lambda hits: F.size(F.filter("needs", lambda places: F.forall(places, lambda p: F.get(hits, p))))
        return F.struct(
            F.coalesce(tx.ratio_pct(total_of(met), F.col("total_weight")), F.lit(0.0)).alias("keyword_score"),
            tx.ratio_pct(ar.let(F.transform("groups", lambda g: group_matched(g, h)), found), F.size("needs")).alias("visibility_score"),
            F.when(F.col("title") != "", F.array_contains(h, F.col("title"))).alias("title_found"))

    return ar.let(F.array_intersect(asked, held), read)


def score_report(pairs: DataFrame, model: DataFrame, documents: DataFrame, *, doc: str = "candidate_id",
                 answers: DataFrame | None = None, screened: DataFrame | None = None) -> DataFrame:
    """One row per pair with every measured layer, its band, and a note for each layer that is missing.

    `documents` carries the feature columns and `terms`; `answers` carries `fit` and `rubric` answers as VARIANT
    columns; `screened` is the screen's scores of the pairs (criteria_met_pct, resume_pct, candidacy_pct).  Scores that
    the pairs bear already (see `answer_scores`, `screen.screen_scores`) go along and need no join by pair.
    """
    borne = [n for n in (*ANSWER_SCORES, *SCREEN_SCORES) if n in pairs.columns]
    described = documents.select(doc, "terms", formatting_score().alias("formatting_score"), parse_safe().alias("parse_safe"))
    met = pairs.select(doc, "jd_id", *borne).join(asked_of(model), "jd_id").join(described, doc)
    rows = met.select(doc, "jd_id", *borne, asked_scores(F.col("terms")).alias("_s"), F.size("needs").alias("n_searches"), "formatting_score", "parse_safe")
    rows = rows.select(doc, "jd_id", *borne, "_s.*", "n_searches", "formatting_score", "parse_safe")
    # what else is known of a pair meets its scores, not the arrays they were read from
    for known in (answers if answers is None else answer_scores(answers.select(doc, "jd_id", "fit", "rubric")),
                  screened if screened is None else screened.select(doc, "jd_id", *SCREEN_SCORES)):
        if known is not None:
            rows = rows.join(known, [doc, "jd_id"], "left")
    rows = rows.withColumns({n: F.lit(None).cast(kind) for n, kind in (ANSWER_SCORES | SCREEN_SCORES).items() if n not in rows.columns})
    scored = rows.select(
        doc, "jd_id", "keyword_score", "visibility_score", "n_searches", "formatting_score", "parse_safe",
        "fit_score", "rubric_score", F.col("criteria_met_pct").alias("recruiter_score"), "resume_pct", "candidacy_pct", "title_found")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(note)) for c, note in NOTES.items()]))
    return scored.withColumn(
        "composite_score", composite(F.col("formatting_score"), F.col("keyword_score"), F.col("fit_score"))).withColumn(
        "visibility_band", tx.score_band(F.col("visibility_score"))).withColumn(
        "composite_band", tx.score_band(F.col("composite_score"))).withColumn(
        "recruiter_band", tx.score_band(F.col("recruiter_score"))).withColumn(
        "rubric_band", tx.score_band(F.col("rubric_score"))).withColumn("notes", missing)
