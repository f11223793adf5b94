"""Profile-against-posting checks and work timelines.

A check is pass, warn, fail or skipped; blank input skips, it is never guessed.  All checks of a pair are one
array column, so a pair costs two joins (profile, posting) and no further shuffle until the scores are summed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import dates as dt
from hiresift.functions import terms as tm
from hiresift.functions import text as tx
from hiresift.operators import requirements as rq
from hiresift.session import shuffled

RESUME, CANDIDACY = "resume", "candidacy"
GATE, STRONG, SOFT = 3.0, 2.0, 1.0
CREDIT = {"pass": 1.0, "warn": 0.5, "fail": 0.0}
GAP_MONTHS = 6
MUST_HAVE, MIN_HEAD_WORDS = 10, 30
COUNTRY_WORDS = tuple(sorted({w for name in V.COUNTRY_ALIASES for w in name.split()}))
PROFILE_LEVEL = r"(?i)\b(intern|trainee|junior|jr\.?|associate|senior|sr\.?|staff|principal|lead|head of|director|vp|manager)\b"
STANDARD_TOPICS = ("Current & expected salary", "Why are you leaving", "Why this role / company")


# ------------------------------------------------------------------ timelines

def timeline(ranges: Column, as_of_month: int) -> Column:
    """struct<gaps array<struct<from_month, to_month, months>>, average_tenure, dated_roles> of one document."""
    closed = F.array_sort(F.transform(ranges, lambda r: F.struct(
        r["start_month"].alias("start_month"), F.coalesce(r["end_month"], F.lit(as_of_month)).alias("end_month"))))

    def read(rows: Column) -> Column:
        start = F.struct(
            F.get(rows, 0)["end_month"].alias("furthest"),
            F.array().cast("array<struct<from_month:int,to_month:int,months:int>>").alias("gaps"))

        def step(acc: Column, r: Column) -> Column:
            months = r["start_month"] - acc["furthest"]
            gap = F.array(F.struct(acc["furthest"].alias("from_month"), r["start_month"].alias("to_month"), months.alias("months")))
            return F.struct(F.greatest(acc["furthest"], r["end_month"]).alias("furthest"),
                            F.when(months > GAP_MONTHS, F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

        spent = F.aggregate(rows, F.lit(0), lambda acc, r: acc + F.greatest(F.lit(0), r["end_month"] - r["start_month"]))
        return F.struct(
            F.aggregate(F.slice(rows, 2, 1_000_000), start, step, lambda acc: acc["gaps"]).alias("gaps"),
            F.bround(F.try_divide(spent.cast("double"), F.size(rows).cast("double")), 1).alias("average_tenure"),
            F.size(rows).alias("dated_roles"))

    return ar.let(closed, read)


def month_spans(spans: DataFrame, key: str) -> DataFrame:
    """(key, start_month) -> latest end and count.  Months bound the rows of any key, however hot it is, and the
    maximum combines before the shuffle, so the window below never sees an unbounded partition."""
    return spans.groupBy(key, "start_month").agg(
        F.max("end_month").alias("end_month"), F.count("*").alias("n"),
        F.sum(F.greatest(F.lit(0), F.col("end_month") - F.col("start_month"))).alias("months"))


def employment_gaps(spans: DataFrame, key: str, *, longer_than: int = GAP_MONTHS) -> DataFrame:
    """Gaps between month spans of each key: running furthest end against the next start."""
    so_far = W.partitionBy(key).orderBy("start_month").rowsBetween(W.unboundedPreceding, -1)
    rows = month_spans(spans, key).withColumn("furthest", F.max("end_month").over(so_far))
    return rows.where(F.col("start_month") - F.col("furthest") > longer_than).select(
        key, F.col("furthest").alias("from_month"), F.col("start_month").alias("to_month"),
        (F.col("start_month") - F.col("furthest")).alias("months"))


def average_tenure(spans: DataFrame, key: str) -> DataFrame:
    return month_spans(spans, key).groupBy(key).agg(F.sum("n").alias("dated_roles"), F.sum("months").alias("months")).select(
        key, "dated_roles", F.bround(F.col("months") / F.col("dated_roles"), 1).alias("average_tenure"))


# ------------------------------------------------------------------ the top of a document

def top_third(text: Column) -> Column:
    """The first max(30, n/3) words, joined by single spaces."""
    return ar.let(tx.words(text), lambda ws: F.array_join(
        F.slice(ws, F.lit(1), F.greatest(F.lit(30), F.floor(F.size(ws) / 3).cast("int"))), " "))


def fold_hyphens(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("-"), F.lit(" "))


def top_third_coverage(text: Column, terms: Column) -> Column:
    """% of terms in the top third, hyphens folded; null under 30 words or without terms.  For one document beside its
    terms; whole tables go through `head_terms`."""
    head = F.replace(tm.searchable(top_third(text)), F.lit("-"), F.lit(" "))
    folded = F.transform(terms, fold_hyphens)
    hits = ar.let(head, lambda h: F.size(F.filter(folded, lambda t: tm.term_in(t, h))))
    return F.when((F.size(tx.words(text)) >= MIN_HEAD_WORDS) & (F.size(terms) > 0), tx.ratio_pct(hits, F.size(terms)))


def must_have_terms(model: DataFrame, n: int = MUST_HAVE) -> DataFrame:
    """(jd_id, must_have): the heaviest terms of each posting, canonical and with hyphens folded."""
    return model.select("jd_id", F.transform(F.slice("keywords", 1, n), lambda k: fold_hyphens(tm.canonical(k["term"]))).alias("must_have"))


def head_terms(resumes: DataFrame, must_have: DataFrame, *, key: str = "candidate_id", text: str = "text") -> DataFrame:
    """(key, head_terms): the must-have terms that stand in the top third of each document, null under 30 words.

    One index of the heads; pairs then compare arrays, and no text meets a pair.
    """
    wanted = must_have.select(F.explode("must_have").alias("term")).distinct()
    head = F.replace(tm.searchable(top_third(F.col(text))), F.lit("-"), F.lit(" "))
    held = tm.term_index(resumes, [key], head, wanted).groupBy(key).agg(F.collect_set("term").alias("_t"))
    long_enough = F.size(tx.words(F.col(text))) >= MIN_HEAD_WORDS
    return resumes.select(key, long_enough.alias("_long")).join(held, key, "left").select(
        key, F.when(F.col("_long"), F.coalesce("_t", F.array().cast("array<string>"))).alias("head_terms"))


def shown_share() -> Column:
    """% of a pair's must-have terms that the head shows; null for a short document and a posting without terms."""
    return F.when(F.col("head_terms").isNotNull() & (F.size("must_have") > 0), tx.ratio_pct(
        F.size(F.filter("must_have", lambda t: F.array_contains("head_terms", t))), F.size("must_have")))


# ------------------------------------------------------------------ checks

def check(name, status, category: str, importance, citation=None, topic=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(name).cast("string").alias("name"), as_col(status).cast("string").alias("status"), F.lit(category).alias("category"),
        as_col(importance).cast("double").alias("importance"), F.coalesce(as_col(citation).cast("string"), F.lit("")).alias("citation"),
        as_col(topic).cast("string").alias("topic"))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def years_checks() -> Column:
    need, have, cite = F.col("min_years"), F.col("years_experience"), F.col("years_line")
    gap = need - have
    known = need.isNotNull() & have.isNotNull()
    status = F.when(~known, "skipped").when(gap <= 0, "pass").when(gap <= 2, "warn").otherwise("fail")
    main = check("Years of experience", status, CANDIDACY, F.when(known, GATE).otherwise(SOFT), F.when(known, cite),
                 F.when(known & (gap > 0), "Experience level"))
    over = check("Overqualification", "warn", CANDIDACY, SOFT, cite, "Overqualification")
    return F.when(known & (have > need + 6), F.array(main, over)).otherwise(F.array(main))


def degree_check() -> Column:
    need, have = F.col("degree_rank"), F.col("education_rank")
    known = ~blank(F.col("min_degree")) & ~blank(F.col("education_level"))
    optional = ~F.col("degree_mandatory")
    status = F.when(~known, "skipped").when(have >= need, "pass").when(optional, "warn").otherwise("fail")
    weight = F.when(~known, SOFT).when((have < need) & optional, STRONG).otherwise(GATE)
    return check("Education", status, CANDIDACY, weight, F.when(known, F.col("degree_line")), F.when(known & (have < need), "Education"))


def held_certificates(pairs: DataFrame, requirements: DataFrame, profiles: DataFrame, resumes: DataFrame) -> DataFrame:
    """(candidate_id, held_certs): of the certificates that a candidate's postings name, those in the profile or the text.

    Names, not texts, are gathered by candidate; each text is read once.
    """
    asked = requirements.where(F.size("certs") > 0).select("jd_id", F.explode(F.array_distinct(ar.field(F.col("certs"), "cert"))).alias("cert"))
    wanted = pairs.select("candidate_id", "jd_id").join(asked, "jd_id").groupBy("candidate_id").agg(F.collect_set("cert").alias("_wanted"))
    own = F.lower(F.concat(F.array_join(F.coalesce("certifications", F.array().cast("array<string>")), " "), F.lit(" "), F.coalesce("text", F.lit(""))))
    rows = shuffled(resumes.select("candidate_id", "text")).join(profiles.select("candidate_id", "certifications"), "candidate_id").join(wanted, "candidate_id", "left")
    return rows.select("candidate_id", ar.let(own, lambda h: F.filter(
        F.coalesce("_wanted", F.array().cast("array<string>")), lambda w: F.contains(h, F.lower(w)))).alias("held_certs"))


def certification_checks() -> Column:
    def row(c: Column) -> Column:
        name = F.concat(F.lit("Certification: "), c["cert"])
        has = F.array_contains("held_certs", c["cert"])
        status = F.when(has, "pass").when(c["mandatory"], "fail").otherwise("warn")
        weight = F.when(has | c["mandatory"], STRONG).otherwise(SOFT)
        return check(name, status, CANDIDACY, weight, c["line"], F.when(~has & c["mandatory"], name))

    return F.when(F.size("certs") > 0, F.transform("certs", row)).otherwise(
        F.array(check("Certifications", "skipped", CANDIDACY, SOFT)))


def work_mode_check() -> Column:
    known = (F.size("work_modes") > 0) & (F.size("acceptable_work_modes") > 0)
    meets = F.arrays_overlap("work_modes", "acceptable_work_modes")
    status = F.when(~known, "skipped").when(meets, "pass").otherwise("fail")
    return check("Work mode", status, CANDIDACY, F.when(known, GATE).otherwise(SOFT), F.when(known, F.get("modes", F.lit(0))["line"]),
                 F.when(known & ~meets, "Work arrangement"))


def salary_check() -> Column:
    jmin, jmax, pmin, pmax = (F.col(c) for c in ("salary_min", "salary_max", "expected_salary_min", "expected_salary_max"))
    jcur, pcur = F.upper(F.coalesce("salary_currency", F.lit(""))), F.upper(F.coalesce("profile_currency", F.lit("")))
    known = (jmin.isNotNull() | jmax.isNotNull()) & (pmin.isNotNull() | pmax.isNotNull())
    mismatch = (jcur != "") & (pcur != "") & (jcur != pcur)
    above, below, upper = (F.coalesce(c, F.lit(False)) for c in (pmin > jmax, pmax < jmin, pmin > jmin))
    status = (F.when(~known | mismatch, "skipped").when(above, "fail").when(below | upper, "warn").otherwise("pass"))
    weight = F.when(~known | mismatch, SOFT).when(above, GATE).when(below, STRONG).otherwise(SOFT)
    topic = F.when(known & ~mismatch & (above | (~below & upper)), "Salary expectations")
    return check("Salary", status, CANDIDACY, weight, F.when(known, F.col("salary_line")), topic)


def place_words(c: Column) -> Column:
    return F.array_except(F.transform(tx.find_all(F.coalesce(c, F.lit("")), "[A-Za-z]{4,}"), F.lower), tx.constant_array(COUNTRY_WORDS))


def location_check() -> Column:
    same = F.arrays_overlap("place_words", "jd_place_words") | F.arrays_overlap("here", "countries")
    stated = ~blank(F.col("jd_location")) | (F.size("countries") > 0)
    known = stated & (~blank(F.col("location")) | (F.size("work_authorized_in") > 0))
    move, onsite, remote = F.col("open_to_relocation"), F.array_contains("work_modes", "onsite"), F.array_contains("work_modes", "remote")
    decided = known & (same | move.isNotNull())
    status = (F.when(~decided, "skipped").when(same, "pass").when(move, "warn").when(onsite, "fail").otherwise("warn"))
    weight = F.when(~decided | same | move, SOFT).when(onsite, GATE).when(remote, SOFT).otherwise(STRONG)
    topic = F.when(decided & ~same, F.when(move, "Relocation").when(onsite, "Location"))
    return check("Location", status, CANDIDACY, weight, F.when(decided, F.col("location_line")), topic)


def authorisation_check() -> Column:
    overlap = F.arrays_overlap("countries", "authorised")
    both = (F.size("countries") > 0) & (F.size("work_authorized_in") > 0)
    sponsor = F.contains(F.lower(F.coalesce("work_authorization", F.lit(""))), F.lit("sponsor"))
    blocked = F.when(both & ~overlap, "fail").when(overlap, "pass").when(sponsor, "fail").otherwise("warn")
    status = F.when(F.col("sponsorship_unavailable"), blocked).when(F.col("work_auth_required"), "warn").otherwise("skipped")
    weight = F.when(F.col("sponsorship_unavailable"), F.when(blocked == "warn", STRONG).otherwise(GATE)).otherwise(SOFT)
    cite = F.when(F.col("sponsorship_unavailable"), F.col("no_sponsor_line")).when(F.col("work_auth_required"), F.col("work_auth_line"))
    return check("Work authorisation", status, CANDIDACY, weight, cite,
                 F.when(F.col("sponsorship_unavailable") & (blocked == "fail"), "Work authorisation"))


def notice_check() -> Column:
    days = F.col("notice_period_days")
    status = F.when(days.isNull(), "skipped").when(days > 60, "warn").otherwise("pass")
    return check("Notice period", status, CANDIDACY, F.when(days > 90, STRONG).otherwise(SOFT), None, F.when(days > 90, "Notice period"))


def title_level_check() -> Column:
    known = ~blank(F.col("seniority")) & ~blank(F.col("current_title"))
    delta = F.col("jd_level") - F.col("level")
    status = F.when(~known, "skipped").when(delta <= 0, "pass").otherwise("warn")
    weight = F.when(known & (delta != 1), STRONG).otherwise(SOFT)
    return check("Title alignment", status, CANDIDACY, weight, F.when(known, F.col("title_line")), F.when(known & (delta >= 2), "Step up in level"))


def timeline_checks(t: Column) -> Column:
    gaps, tenure, roles = F.size(t["gaps"]) > 0, t["average_tenure"], t["dated_roles"]
    short = F.coalesce(tenure < 18, F.lit(False))
    return F.array(
        check("Employment gaps", F.when(gaps, "warn").otherwise("pass"), CANDIDACY, F.when(gaps, STRONG).otherwise(SOFT), None,
              F.when(gaps, "Employment gap")),
        check("Tenure pattern", F.when(tenure.isNull(), "skipped").when(short, "warn").otherwise("pass"), CANDIDACY,
              F.when(short, STRONG).otherwise(SOFT), None, F.when(short, "Short tenure")),
        check("Experience legibility", F.when(roles == 0, "fail").when(roles == 1, "warn").otherwise("pass"), RESUME, STRONG))


def top_third_check(coverage: Column) -> Column:
    status = F.when(coverage.isNull(), "skipped").when(coverage >= 60, "pass").when(coverage >= 35, "warn").otherwise("fail")
    return check("Top-third visibility", status, RESUME, F.when(coverage.isNotNull(), GATE).otherwise(SOFT))


def title_visible_check(head: Column) -> Column:
    named = ~blank(F.col("current_title"))
    status = F.when(~named, "skipped").when(F.contains(head, F.lower(F.col("current_title"))), "pass").otherwise("warn")
    return check("Title visibility", status, RESUME, F.when(named, STRONG).otherwise(SOFT))


def resume_facts(resumes: DataFrame, as_of_month: int, *, text: str = "text") -> DataFrame:
    """Per-document parts of the screen, computed once per document instead of once per pair."""
    return resumes.withColumn("timeline", timeline(dt.date_ranges(F.col(text)), as_of_month)).withColumn(
        "head", F.lower(top_third(F.col(text))))


def profile_rows(pairs: DataFrame, profiles: DataFrame, requirements: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Pairs with both sides' facts; without `facts` (candidate_id, ..) enough for every check that does not read the document.

    What a check derives from one side alone (ranks, places, countries) is derived there, once for each row of that side.
    All that is known of a candidate is joined before pairs come, so that a pair moves twice: to its posting, and with what
    the posting asks to its candidate.
    """
    authorised = F.transform("work_authorized_in", tx.normalize_country)
    people = profiles.withColumnsRenamed({"certifications": "profile_certifications", "salary_currency": "profile_currency"}).withColumns({
        "authorised": authorised, "here": F.concat(tx.countries_in(F.coalesce("location", F.lit(""))), authorised),
        "place_words": place_words(F.col("location")), "education_rank": rq.education_rank(F.col("education_level")),
        "level": rq.seniority_rank(tx.first_match(F.col("current_title"), PROFILE_LEVEL, 1))})
    asked = requirements.drop("certifications").withColumns({
        "jd_place_words": place_words(F.col("jd_location")), "degree_rank": rq.education_rank(F.col("min_degree")),
        "jd_level": rq.seniority_rank(F.col("seniority"))})
    return pairs.join(asked, "jd_id").join(people if facts is None else people.join(facts, "candidate_id"), "candidate_id")


def uncited(requirements: DataFrame) -> DataFrame:
    """The requirements without the lines that state them: checks of them cite nothing."""
    line = F.lit(None).cast("string")
    return requirements.withColumns({n: line for n in ("years_line", "degree_line", "salary_line", "location_line", "title_line", "no_sponsor_line", "work_auth_line")} | {
        "certs": F.transform("certs", lambda c: F.struct(c["cert"].alias("cert"), line.alias("line"), c["mandatory"].alias("mandatory"))),
        "modes": F.transform("modes", lambda m: F.struct(m["mode"].alias("mode"), line.alias("line")))})


def screen(pairs: DataFrame, profiles: DataFrame, requirements: DataFrame, resumes: DataFrame, *,
           must_have: DataFrame | None = None, cited: bool = True) -> DataFrame:
    """(candidate_id, jd_id, checks): every check of every pair.

    `resumes` comes from `resume_facts`; `must_have` is (jd_id, must_have array<string>), see `must_have_terms`.
    What the document decides is decided before pairs meet: its timeline, its title, the certificates it names and
    the must-have terms its head shows.  No text reaches a pair, and no line of a posting where nobody reads citations.
    What else the pairs' rows hold goes along to the result.
    """
    none = F.array().cast("array<string>")
    titles = resumes.select("candidate_id", "head", ar.let(F.col("timeline"), timeline_checks).alias("timeline_checks")).join(
        shuffled(profiles.select("candidate_id", "current_title")), "candidate_id")
    facts = titles.select("candidate_id", "timeline_checks", title_visible_check(F.col("head")).alias("title_check"))
    facts = facts.join(held_certificates(pairs, requirements, profiles, resumes), "candidate_id")
    asked = requirements if cited else uncited(requirements)
    if must_have is None:
        facts, asked = facts.withColumn("head_terms", F.lit(None).cast("array<string>")), asked.withColumn("must_have", none)
    else:
        facts = facts.join(head_terms(resumes, must_have), "candidate_id")
        asked = asked.join(must_have, "jd_id", "left").withColumn("must_have", F.coalesce("must_have", none))
    rows = profile_rows(pairs, profiles, asked, facts)
    checks = F.concat(
        years_checks(), F.array(degree_check()), certification_checks(),
        F.array(work_mode_check(), salary_check(), location_check(), authorisation_check(), notice_check(), title_level_check()),
        F.col("timeline_checks"), F.array(ar.let(shown_share(), top_third_check), F.col("title_check")))
    located = ~blank(F.col("location")) | (F.size("work_modes") > 0)
    return rows.select(*pairs.columns, checks.alias("checks"), located.alias("asks_location"))


def check_rows(screened: DataFrame) -> DataFrame:
    return ar.unpack(screened, ["candidate_id", "jd_id"], F.col("checks"), "name")


def met_pct(counted: Column) -> Column:
    """% of criteria met; null when nothing was scored."""
    credit = lambda s: F.when(s == "pass", 1.0).when(s == "warn", 0.5).otherwise(0.0)
    total = lambda f: F.aggregate(counted, F.lit(0.0), lambda acc, c: acc + f(c))
    return tx.ratio_pct(total(lambda c: credit(c["status"]) * c["importance"]), total(lambda c: c["importance"]))


def screen_scores(screened: DataFrame) -> DataFrame:
    """(pair's columns, criteria_met_pct, resume_pct, candidacy_pct): the checks that count are picked out once, then by category."""
    borne = [n for n in screened.columns if n not in ("checks", "asks_location")]
    of = lambda counted, category: ar.let(F.filter(counted, lambda c: c["category"] == category), met_pct)
    # named twice, the checks stay a column of their own and are not evaluated within the lambda
    pcts = F.when(F.col("checks").isNotNull(), ar.let(F.filter("checks", lambda c: c["status"].isin(*CREDIT)), lambda counted: F.struct(
        met_pct(counted).alias("criteria_met_pct"),
        of(counted, RESUME).alias("resume_pct"), of(counted, CANDIDACY).alias("candidacy_pct"))))
    return screened.select(*borne, pcts.alias("_p")).select(
        *borne, F.coalesce("_p.criteria_met_pct", F.lit(0.0)).alias("criteria_met_pct"), "_p.resume_pct", "_p.candidacy_pct")


def is_blocker(c: Column) -> Column:
    return (c["status"] == "fail") & (c["importance"] >= GATE)


def screen_blockers(screened: DataFrame) -> DataFrame:
    """Failed gates per pair; `no_apply` is raised by facts about the candidate only."""
    failed = F.filter("checks", is_blocker)
    rows = screened.select("candidate_id", "jd_id", ar.field(failed, "name").alias("blockers"),
                           F.exists(failed, lambda c: c["category"] == CANDIDACY).alias("no_apply"))
    return rows.where(F.size("blockers") > 0)


def applicable_pairs(screened: DataFrame) -> DataFrame:
    """Pairs past the no-apply gate."""
    return screened.where(~F.exists("checks", lambda c: is_blocker(c) & (c["category"] == CANDIDACY))).select("candidate_id", "jd_id")


def screen_expectations(screened: DataFrame) -> DataFrame:
    """(candidate_id, jd_id, topic, source): what the call will raise."""
    derived = F.transform(F.filter("checks", lambda c: c["topic"].isNotNull()), lambda c: F.struct(c["topic"].alias("topic"), F.lit("derived").alias("source")))
    standard = [F.struct(F.lit(t).alias("topic"), F.lit("standard").alias("source")) for t in STANDARD_TOPICS]
    moving = F.when(F.col("asks_location"), F.struct(F.lit("Location & relocation").alias("topic"), F.lit("standard").alias("source")))
    return ar.unpack(screened, ["candidate_id", "jd_id"], F.concat(derived, F.array_compact(F.array(*standard, moving))), "topic")
