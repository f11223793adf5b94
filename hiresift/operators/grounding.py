"""Model answers checked against the postings they describe, then merged over the rules.

Answers arrive as a table.  Each is parsed once to VARIANT and turned into one array of items with the reason
each was refused, so verification is a map over (answer, posting) rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import terms as tm
from hiresift.functions import text as tx
from hiresift.operators import requirements as rq
from hiresift.session import shuffled

MAX_QUOTE, MAX_TERM_WORDS, MAX_TERM_CHARS, MAX_YEARS = 300, 5, 50, 30
# ---- fixed patterns
DEGREE_LINE = (r"(?i)degree|bachelor|master|\bmba\b|ph\s?d|doctorate|diploma|graduat|b\s?tech|b\s?sc|\bb\s?e\b|\bb\s?s\b"
               r"|\bm\s?s\b|\bbsn\b|m\s?sc|b\s?b\s?a|\bb\s?a\b|undergrad|post ?grad")
MODE_WORDS = {
    "remote": r"(?i)remote|work from home|wfh|anywhere",
    "hybrid": r"(?i)hybrid|days? (?:a week )?in (?:the )?office|days? on ?site",
    "onsite": (r"(?i)on ?site|in office|in person|office based|work from office|\bwfo\b|on the ground"
               r"|at our .{0,30}(?:office|site|plant|facility)"),
}
SPONSOR = r"(?i)sponsor|visa|authori[sz]|right to work|work permit|citizen"
YEARS_WORD = r"(?i)\b(?:years?|yrs?)\b"
LEVEL_SHORT = {"sr": "senior", "sr.": "senior", "jr": "junior", "jr.": "junior"}
DEGREE_SHORT = {"bachelor": "bachelors", "bachelor's": "bachelors", "master": "masters", "master's": "masters",
                "doctorate": "phd", "ph.d": "phd"}
MODE_SHORT = {"on site": "onsite", "in office": "onsite", "office": "onsite"}


# ------------------------------------------------------------------ reading answers

def parse_answer(raw: Column) -> Column:
    """First JSON object of a fenced or chatty reply as VARIANT; null when there is none."""
    text = tx.strip(F.regexp_replace(tx.strip(F.regexp_replace(tx.strip(raw), "^```(?:json)?", "")), "```$", ""))
    as_object = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)

    def salvage(t: Column) -> Column:
        # the first balanced object: one fold over the pieces counts the open braces outside strings
        tail = F.when(F.contains(t, F.lit("{")), F.substring(t, F.instr(t, "{"), F.length(t)))
        start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

        def step(state: Column, piece: Column) -> Column:
            move = F.when(state["quoted"], 0).when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
            depth = state["depth"] + move
            after = F.struct(depth.alias("depth"), (state["quoted"] != (piece == '"')).alias("quoted"), (state["size"] + F.length(piece)).alias("size"), ((piece == "}") & (depth == 0)).alias("closed"))
            return F.when(state["closed"], state).otherwise(after)

        balanced = F.aggregate(tx.find_all(tail, r'\\[\s\S]|[{}"]|[^\\{}"]+|\\'), start, step, lambda s: F.when(s["closed"], s["size"]))
        return F.try_parse_json(ar.let(balanced, lambda n: F.substring(tail, F.lit(1), n)))

    def read(t: Column) -> Column:
        whole = F.try_parse_json(F.when(t != "", t))
        return ar.let(whole, lambda w: as_object(F.when(w.isNotNull(), w).otherwise(salvage(t))))

    return ar.let(text, read)


def cache_key(text: Column, model: Column, host: Column, prompt_version: Column) -> Column:
    """sha256 over the parts, each closed by a NUL byte."""
    blank = F.lit("")
    parts = [prompt_version, F.coalesce(model, blank), F.coalesce(host, blank), text]
    return F.sha2(F.concat(*[F.concat(p, F.lit("\0")) for p in parts]), 256)


def answer_cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests with the cached answer or a pending flag.  The cache holds one row per key, so copies of one
    text, however many, meet a unique build side."""
    unique = cache.groupBy(key).agg(F.min("answer").alias("answer"))
    return requests.join(unique, key, "left").withColumn("pending", F.col("answer").isNull())


def match_pasted_answers(expected: DataFrame, replies: DataFrame) -> DataFrame:
    """(task_id, status) for expected ids and pasted `{id: answer}` replies: answered, missing or unknown."""
    parsed = replies.select(F.from_json(parse_answer(F.col("raw")).cast("string"), "map<string,string>").alias("m"))
    given = ar.unnest(parsed, [], F.map_entries("m"), "e").select(F.col("e.key").alias("task_id"), F.col("e.value").alias("value"))
    usable = given.where(F.regexp_like("task_id", F.lit("^[0-9a-f]+$")) & F.col("value").startswith("{")).select("task_id").distinct()
    left = expected.select("task_id").distinct().withColumn("_want", F.lit(True))
    rows = left.join(usable.withColumn("_got", F.lit(True)), "task_id", "full_outer")
    status = F.when(F.col("_want") & F.col("_got"), "answered").when(F.col("_want"), "missing").otherwise("unknown")
    return rows.select("task_id", status.alias("status"))


# ------------------------------------------------------------------ quotes

def quote_problem(quote: Column, posting_norm: Column) -> Column:
    """Why a quotation does not hold, null when it does."""
    q = tx.normalize_quote(quote)
    return (F.when(F.coalesce(tx.strip(quote), F.lit("")) == "", "no quote").when(F.length(q) < 2, "quote too short")
            .when(F.length(q) > MAX_QUOTE, "quote too long").when(~F.contains(posting_norm, q), "quote not found"))


def ground_quotes(quotes: DataFrame, postings: DataFrame, *, key: str = "jd_id", text: str = "jd_text") -> DataFrame:
    norm = postings.select(key, tx.normalize_quote(F.col(text)).alias("_norm"))
    return quotes.join(shuffled(norm), key).withColumn("reason", quote_problem(F.col("quote"), F.col("_norm"))).drop("_norm")


def term_in_quote(term: Column, quote: Column) -> Column:
    """Visible as a phrase, or every longer word of it present."""
    def test(hay: Column) -> Column:
        def named(t: Column) -> Column:
            long_words = F.filter(F.split(t, " "), lambda w: F.length(w) > 2)
            def by_words(qw: Column) -> Column:
                seen = lambda w: F.array_contains(qw, w) | F.array_contains(qw, F.concat(w, F.lit("s"))) | F.array_contains(qw, F.rtrim(w, F.lit("s")))
                return (F.size(long_words) > 0) & F.forall(long_words, seen)
            return (t != "") & (tm.term_in(t, hay) | F.contains(hay, t) | ar.let(F.split(hay, " "), by_words))
        return ar.let(tx.normalize_quote(tm.canonical(term)), named)
    return ar.let(tx.normalize_quote(tm.searchable(quote)), test)


def _words(text: Column) -> Column:
    return F.filter(F.split(tx.normalize_quote(tm.searchable(text)), " "), lambda w: w != "")


# ------------------------------------------------------------------ fields

def _item(name: str, value: Column, quote: Column, problem: Column, flag: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), quote.alias("quote"),
                    problem.alias("reason"), (flag if flag is not None else F.lit(None)).cast("boolean").alias("flag"))


def _one(present: Column, item: Column) -> Column:
    return F.when(present, F.array(item)).otherwise(F.filter(F.array(item), lambda _: F.lit(False)))


def answer_items(answer: Column, norm: Column) -> Column:
    """array<struct<field, value, quote, reason, flag>>: every statement of an answer, refused or not."""
    s = lambda path: F.try_variant_get(answer, path, "string")
    word = lambda path: F.lower(tx.strip(F.coalesce(s(path), F.lit(""))))
    listed = lambda path: F.coalesce(F.try_variant_get(answer, path, "array<variant>"), F.array().cast("array<variant>"))
    of = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    grounded = lambda q, *proofs: F.coalesce(quote_problem(q, norm), *proofs)
    number = lambda path: F.replace(F.when(F.schema_of_variant(F.try_variant_get(answer, path, "variant")) != "BOOLEAN", s(path)), F.lit(","), F.lit("")).try_cast("double")

    # title
    title, tq = word("$.title.value"), s("$.title.quote")
    bare = tx.squeeze(F.regexp_replace(tx.normalize_quote(title), tx.TITLE_LEVEL, " "))
    shown = ar.let(_words(tq), lambda qw: F.size(F.array_except(_words(title), qw)) == 0)
    title_item = _item("title", F.coalesce(F.nullif(tx.clean_title(title), F.lit("")), bare), tq, grounded(tq, F.when(~shown, "title words not in quote")))

    # seniority
    raw_level, sq = word("$.seniority.value"), s("$.seniority.quote")
    level = tx.lookup(LEVEL_SHORT, raw_level, raw_level)
    named = F.transform(tx.find_all(sq, rq.SENIORITY, 1), lambda x: tx.lookup(LEVEL_SHORT, F.lower(x), F.lower(x)))
    known_levels = [k for k in V.SENIORITY_RANK if k]
    level_item = _item("seniority", level, sq, F.coalesce(
        F.when(~level.isin(*known_levels), "unknown seniority level"), grounded(sq, F.when(~F.array_contains(named, level), "seniority word not in quote"))))

    # years
    years, yq = number("$.min_years.value"), s("$.min_years.quote")
    plain = F.when(years == F.floor(years), F.floor(years).cast("string")).otherwise(years.cast("string"))
    figure = F.regexp_like(yq, F.concat(F.lit(r"(?<!\d)\Q"), plain, F.lit(r"\E(?!\d)"))) & tx.matches(yq, YEARS_WORD)
    years_item = _item("min_years", plain, yq, F.coalesce(
        F.when(~((years > 0) & (years <= MAX_YEARS)), "years out of range"), grounded(yq, F.when(~figure, "number and years not in quote"))),
        F.coalesce(s("$.min_years.mandatory") != "false", F.lit(True)))

    # degree
    raw_degree, dq = word("$.degree.value"), s("$.degree.quote")
    degree = tx.lookup(DEGREE_SHORT, raw_degree, raw_degree)
    degree_item = _item("min_degree", degree, dq, F.coalesce(
        F.when(~degree.isin(*V.DEGREE_RANK), "unknown degree level"),
        grounded(dq, F.when(~tx.matches(tx.normalize_quote(dq), DEGREE_LINE), "quote is not a degree line"))),
        F.coalesce(s("$.degree.mandatory") != "false", F.lit(True)))

    # lists
    cert_items = F.transform(
        F.filter(listed("$.certifications"), lambda v: tx.strip(F.coalesce(of(v, "name"), F.lit(""))) != ""),
        lambda v: ar.let(tx.strip(of(v, "name")), lambda n: _item("certifications", n, of(v, "quote"), grounded(
            of(v, "quote"), F.when(~term_in_quote(n, of(v, "quote")), "name not in quote")))))

    def mode_item(v: Column) -> Column:
        def build(m: Column) -> Column:
            hay = tx.normalize_quote(of(v, "quote"))
            proof = F.lit(None).cast("string")
            for mode, pattern in MODE_WORDS.items():
                proof = F.when((m == mode) & ~tx.matches(hay, pattern), "mode word not in quote").otherwise(proof)
            return _item("work_modes", m, of(v, "quote"), F.coalesce(F.when(~m.isin(*V.WORK_MODES), "unknown work mode"), grounded(of(v, "quote"), proof)))
        raw = F.replace(F.lower(tx.strip(F.coalesce(of(v, "value"), F.lit("")))), F.lit("on-site"), F.lit("onsite"))
        return ar.let(tx.lookup(MODE_SHORT, raw, raw), build)

    mode_items = F.filter(F.transform(listed("$.work_modes"), mode_item), lambda i: i["value"] != "")

    # sponsorship
    sv, pq = s("$.sponsorship_unavailable.value"), s("$.sponsorship_unavailable.quote")
    sponsor_item = _item("sponsorship_unavailable", sv, pq, F.when(sv == "true", grounded(
        pq, F.when(~tx.matches(pq, SPONSOR), "no sponsorship wording in quote"))))

    # salary
    lo, hi, gq = number("$.salary.min"), number("$.salary.max"), s("$.salary.quote")
    cur = F.upper(tx.strip(F.coalesce(s("$.salary.currency"), F.lit(""))))
    disordered = F.coalesce(lo <= 0, F.lit(False)) | F.coalesce(hi <= 0, F.lit(False)) | F.coalesce(lo > hi, F.lit(False))
    salary_item = _item("salary", F.concat_ws("|", rq.money_text(lo), rq.money_text(hi), cur), gq, F.coalesce(
        F.when(disordered, "amounts out of order"), F.when(~tx.matches(cur, "^[A-Z]{3}$"), "currency is not a 3-letter code"),
        grounded(gq, F.when(~tx.matches(gq, r"\d"), "no amount in quote"))))

    def country_item(v: Column) -> Column:
        def build(n: Column) -> Column:
            q = of(v, "quote")
            odd = tx.among(n, V.NOT_COUNTRIES) | ~tx.matches(n, "^[a-z]+(?: [a-z]+){0,2}$")
            seen = F.contains(tx.normalize_quote(q), n) | F.array_contains(tx.countries_in(q), n)
            return _item("countries", n, q, grounded(q, F.when(odd, "not a country").when(~seen, "country not in quote")))
        return ar.let(tx.normalize_country(of(v, "value")), build)

    country_items = F.filter(F.transform(listed("$.countries"), country_item), lambda i: i["value"] != "")

    def skill_item(v: Column) -> Column:
        def build(t: Column) -> Column:
            q = of(v, "quote")
            size = F.when((F.size(tx.words(t)) > MAX_TERM_WORDS) | (F.length(t) > MAX_TERM_CHARS), "too long for a skill")
            filler = F.when(tx.among(t, V.STOPWORDS + V.NON_SKILL_ACRONYMS), "boilerplate word")
            return _item("skills", t, q, F.coalesce(size, filler, grounded(q, F.when(~term_in_quote(t, q), "term not in quote"))),
                         F.coalesce(of(v, "required") == "true", F.lit(False)))
        return ar.let(tm.canonical(F.coalesce(of(v, "term"), F.lit(""))), build)

    skill_items = F.filter(F.transform(listed("$.skills"), skill_item), lambda i: i["value"] != "")

    return F.concat(
        _one(title != "", title_item), _one(level != "", level_item), _one(years.isNotNull(), years_item), _one(degree != "", degree_item),
        cert_items, mode_items, _one(F.coalesce(sv.isin("true", "false"), F.lit(False)), sponsor_item),
        _one(lo.isNotNull() | hi.isNotNull(), salary_item), country_items, skill_items)


def ground_fields(answers: DataFrame, postings: DataFrame, *, key: str = "jd_id", raw: str = "raw", text: str = "jd_text") -> DataFrame:
    """(key, item_no, field, value, quote, reason, flag), reason null where the posting supports the statement."""
    rows = answers.select(key, raw).join(shuffled(postings.select(key, text)), key)
    items = ar.let(parse_answer(F.col(raw)), lambda a: ar.let(tx.normalize_quote(F.col(text)), lambda n: answer_items(a, n)))
    numbered = F.transform(items, lambda s, i: F.struct(
        (i + 1).alias("item_no"), *[s[n].alias(n) for n in ("field", "value", "quote", "reason", "flag")]))
    return ar.unpack(rows, [key], numbered, "field")


def rejected_items(grounded: DataFrame) -> DataFrame:
    return grounded.where("reason is not null")


def verified_items(grounded: DataFrame) -> DataFrame:
    return grounded.where("reason is null")


def verified_skills(grounded: DataFrame, key: str = "jd_id") -> DataFrame:
    """(key, term, required, quote): required anywhere means required; its first such quote is kept."""
    skills = verified_items(grounded).where("field = 'skills'")
    return skills.groupBy(key, F.col("value").alias("term")).agg(
        F.bool_or("flag").alias("required"),
        F.min_by("quote", F.struct((~F.col("flag")).cast("int"), F.col("item_no"))).alias("quote"))


# ------------------------------------------------------------------ merge

SCALARS = ("title", "seniority", "min_years", "min_degree", "sponsorship_unavailable", "salary")


def rule_scalars() -> Column:
    """array<struct<field, value>> over requirement-record columns, blanks left out."""
    number = lambda c: F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    row = lambda f, v: F.struct(F.lit(f).alias("field"), F.nullif(v, F.lit("")).alias("value"))
    paid = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    pay = F.when(paid, F.concat_ws("|", rq.money_text(F.col("salary_min")), rq.money_text(F.col("salary_max")), F.coalesce("salary_currency", F.lit(""))))
    rows = F.array(
        row("title", F.col("jd_title")), row("seniority", F.col("seniority")), row("min_years", number(F.col("min_years"))),
        row("min_degree", F.col("min_degree")), row("sponsorship_unavailable", F.when(F.col("sponsorship_unavailable"), "true")), row("salary", pay))
    return F.filter(rows, lambda r: r["value"].isNotNull())


def rule_values(requirements: DataFrame, key: str = "jd_id") -> DataFrame:
    """(key, field, value) of the rule record, spelled as grounded values are: scalars, the sorted work modes, and
    whether a stated degree is mandatory."""
    row = lambda f, v: F.struct(F.lit(f).alias("field"), F.nullif(v, F.lit("")).alias("value"))
    more = F.array(row("work_modes", F.array_join(F.array_sort(F.array_distinct("work_modes")), "|")),
                   row("degree_mandatory", F.when(F.col("min_degree").isNotNull(), F.col("degree_mandatory").cast("string"))))
    return ar.unpack(requirements, [key], F.concat(rule_scalars(), F.filter(more, lambda r: r["value"].isNotNull())), "field")


def verified_scalars(grounded: DataFrame, key: str = "jd_id") -> DataFrame:
    """One verified value per field; a stated false is silence, not a claim.  Work modes are one sorted list, and a
    verified degree brings whether it is mandatory."""
    items = verified_items(grounded)
    kept = items.where(F.col("field").isin(*SCALARS)).where("not (field = 'sponsorship_unavailable' and value = 'false')")
    single = kept.groupBy(key, "field").agg(F.min_by("value", "item_no").alias("value"))
    modes = items.where("field = 'work_modes'").groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("value")), "|").alias("value"))
    degree = items.where("field = 'min_degree'").groupBy(key).agg(F.min_by("flag", "item_no").cast("string").alias("value")).where("value is not null")
    return single.unionByName(modes.select(key, F.lit("work_modes").alias("field"), "value")).unionByName(degree.select(key, F.lit("degree_mandatory").alias("field"), "value"))


def merge_hybrid_fields(rules: DataFrame, verified: DataFrame, key: str = "jd_id") -> DataFrame:
    """Full outer merge of (key, field, value): verified values win, rules fill the gaps."""
    a, b = rules.select(key, "field", F.col("value").alias("rule_value")), verified.select(key, "field", F.col("value").alias("llm_value"))
    return a.join(shuffled(b), [key, "field"], "full_outer").select(
        key, "field", F.coalesce("llm_value", "rule_value").alias("value"),
        F.when(F.col("llm_value").isNotNull(), "llm").otherwise("rules").alias("source"), "rule_value", "llm_value")


def merge_lists(rules: Column, verified: Column, contained: bool) -> Column:
    """Union in order; with `contained`, an entry inside a kept one (or holding one) adds nothing."""
    def add(kept: Column, c: Column) -> Column:
        inside = lambda x: F.contains(F.lower(x), F.lower(c)) | F.contains(F.lower(c), F.lower(x))
        seen = F.exists(kept, inside) if contained else F.array_contains(kept, c)
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(c)))
    return F.aggregate(F.coalesce(verified, F.array().cast("array<string>")), rules, add)


def merge_hybrid_lists(requirements: DataFrame, grounded: DataFrame, key: str = "jd_id") -> DataFrame:
    """(key, certifications, countries): rule lists plus the verified entries they lack."""
    kept = verified_items(grounded)
    gather = lambda f: F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct("item_no", "value")))), lambda s: s["value"])
    lists = kept.where(F.col("field").isin("certifications", "countries")).groupBy(key).agg(
        gather("certifications").alias("_c"), gather("countries").alias("_n"))
    rows = requirements.select(key, "certifications", "countries").join(shuffled(lists), key, "left")
    return rows.select(key, merge_lists(F.col("certifications"), F.col("_c"), True).alias("certifications"),
                       merge_lists(F.col("countries"), F.col("_n"), False).alias("countries"))


def merge_hybrid_skills(keywords: DataFrame, skills: DataFrame, key: str = "jd_id") -> DataFrame:
    """Verified skills over rule keywords: additions only when required; shared terms re-sectioned, bump kept."""
    k = keywords.select(key, "term", F.col("weight").alias("rule_weight"), F.col("section").alias("rule_section"))
    rows = k.join(shuffled(skills.select(key, "term", "required")), [key, "term"], "full_outer")
    base = lambda s: tx.lookup(V.SECTION_WEIGHTS, s, F.lit(1.0))
    was_required = F.col("rule_section").isin(*V.HARD_SECTIONS)
    moved = F.col("required").isNotNull() & F.col("rule_section").isNotNull() & (was_required != F.col("required"))
    section = F.when(F.col("required"), "hard").otherwise("nice")
    bump = F.col("rule_weight").cast("double") / base(F.col("rule_section"))
    weight = (F.when(F.col("rule_section").isNull(), F.lit(V.SECTION_WEIGHTS["hard"])).when(moved, F.bround(base(section) * bump, 2))
              .otherwise(F.col("rule_weight").cast("double")))
    kept = rows.where("rule_section is not null or required")
    return kept.select(
        key, "term", weight.cast("decimal(6,2)").alias("weight"),
        F.when(F.col("rule_section").isNull() | moved, section).otherwise(F.col("rule_section")).alias("section"),
        F.when(F.col("rule_section").isNull(), "added").when(moved, "moved").otherwise("kept").alias("change"), "rule_section")


def extraction_conflicts(fields: DataFrame, skills: DataFrame, key: str = "jd_id") -> DataFrame:
    """(key, field, llm, rules): every disagreement between the two readings."""
    scalar = fields.where("rule_value is not null and llm_value is not null and rule_value <> llm_value and field <> 'degree_mandatory'").select(
        key, "field", F.col("llm_value").alias("llm"), F.col("rule_value").alias("rules"))
    moved = skills.where("change = 'moved'").select(
        key, F.concat(F.lit("skill:"), "term").alias("field"), F.col("section").alias("llm"), F.col("rule_section").alias("rules"))
    return scalar.unionByName(moved)


# ------------------------------------------------------------------ vocabulary growth

def learned_candidates(skills: DataFrame, keywords: DataFrame, *, vocab: V.Vocabulary = V.DEFAULT,
                       approved: DataFrame | None = None, key: str = "jd_id") -> DataFrame:
    """(term, count, example) of verified terms nobody knows yet, most seen first by `count`."""
    unknown = skills.where(~F.col("term").isin(*vocab.taxonomy)).join(shuffled(keywords.select(key, "term")), [key, "term"], "left_anti")
    if approved is not None:
        unknown = unknown.join(approved.select("term"), "term", "left_anti")
    return unknown.groupBy("term").agg(F.count("*").alias("count"), F.left(F.min_by("quote", key), F.lit(200)).alias("example"))


def promote_terms(candidates: DataFrame, approved: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(approved, candidates) after (term, decision) rows: promote adds to approved, both leave the candidates."""
    d = decisions.select(F.lower(tx.strip(F.col("term"))).alias("term"), "decision").where("term <> ''")
    grown = approved.select("term").unionByName(d.where("decision = 'promote'").select("term")).distinct()
    return grown, candidates.join(d.select("term"), "term", "left_anti")
