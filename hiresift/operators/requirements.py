"""Hard filters stated in postings, each with the line that states it.

All filters are array expressions over one posting row; the long evidence table is an `inline` of them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import text as tx
from hiresift.operators import extract as ex

# ---- fixed patterns
YEAR_PATTERNS = (
    r"(?i)(\d{1,2})\s*(?:-|–|—|to)\s*\d{1,2}\s*\+?\s*(?:years?|yrs?)",
    r"(?i)(\d{1,2})\s*\+\s*(?:years?|yrs?)",
    r"(?i)(?:minimum|at least|min\.?)\s*(?:of\s*)?(\d{1,2})\s*(?:years?|yrs?)",
    r"(?i)(\d{1,2})\s*(?:years?|yrs?)\s+(?:of\s+)?(?:relevant\s+|professional\s+|hands-on\s+)?experience",
)
YEARS_SOFT = r"(?i)\bpreferred\b|\bnice to have\b|\ba plus\b|\bbonus\b|\bor equivalent\b"
DEGREE_SOFT = r"(?i)\bor equivalent\b|\bpreferred\b|\bnice to have\b|\ba plus\b|\bor relevant experience\b"
DEGREE_PATTERNS = {
    "diploma": r"(?i)\bdiploma\b",
    "bachelors": (
        r"(?i)\bbachelor'?s?\b|\bb\.?tech\b|\bb\.?sc\b|\bb\.a\.?(?!\w)|\bba\s+(?:in|degree|\(?hons)\b|\bb\.?b\.?a\b"
        r"|\bundergraduate degree\b|\bb\.s\.?(?!\w)|\bbs\s+(?:in|degree)\b|\bb\.e\.?(?![a-z])|\bbsn\b"
        r"|(?<!post)\bgraduate\b(?!\s+(?:school|program|programme|trainee|engineer))"),
    "mba": r"(?i)\bmba\b",
    "masters": (
        r"(?i)\bmaster'?s\b(?!\s+data)|\bmaster\s+(?:of|degree)\b|\bm\.?sc\b|\bm\.s\.?(?!\w)"
        r"|(?<!\d)(?<!\d )\bms\b(?!\s*(?:excel|office|word|sql|access|teams|project|visio|power|azure|dynamics"
        r"|outlook|powerpoint|365|fabric|sharepoint|-|\d))"),
    "phd": r"(?i)\bph\.?d\b|\bdoctorate\b",
}
MODE_PATTERNS = {
    "remote": r"(?i)\b(?:fully\s+)?remote\b",
    "hybrid": r"(?i)\bhybrid\b",
    "onsite": r"(?i)\bon-?site\b|\bin[\s-]?office\b|\bin person\b|\bwork from office\b|\bwfo\b|\boffice[\s-]based\b",
}
NO_SPONSORSHIP = (
    r"(?i)(?:sponsorship|visa)[^.\n]{0,60}(?:not (?:be )?available|cannot|can not|unable|do(?:es)? not (?:provide|offer|sponsor))"
    r"|(?:we do not|will not)[^.\n]{0,30}sponsor|no (?:visa )?sponsorship"
    r"|(?:unable to|not able to|cannot|can not|do not|does not|will not|won't)\s+(?:provide\s+)?sponsor"
    r"|must (?:currently |already )?(?:be )?(?:based|residing|located|living|reside) in[^.\n]{0,40}valid[^.\n]{0,20}visa"
    r"|(?:valid|own|existing) (?:\w+ )?(?:residence |residency |employment |work )?visa (?:is )?(?:required|mandatory|a must)"
    r"|candidates? (?:must|should) (?:hold|have|possess) (?:a )?valid (?:\w+ )?(?:residence |employment |work )?visa")
WORK_AUTH = r"(?i)must be (?:legally )?(?:authori[sz]ed|eligible) to work|right to work|work authori[sz]ation required"
CERTIFICATION = (
    r"(?i)\b(PMP|PRINCE2|CPA|CFA|CMA|CIMA|ACCA|FRM|CISA|CISM|CISSP|CIPP|CCNA|CCNP|CCIE|CSM|CSPO|PSM\s?I{1,3}"
    r"|(?-i:SAFe)(?:\s+\w+)?|ITIL(?:\s+\w+)?|CBAP|PHR|SPHR|SHRM-?(?:CP|SCP)|CIPD|CAMS|(?:PL|DP|AZ|AI|MB|MS)-\d{3}"
    r"|AWS Certified[\w\s]{0,30}"
    r"|Google (?:Professional|Associate|Data Analytics|Cloud|Project Management|UX|IT Support|Digital Marketing)[\w\s]{0,25}"
    r"|Microsoft Certified[\w\s]{0,40}|CompTIA\s+(?:A\+|Network\+|Security\+|Cloud\+|CySA\+|PenTest\+)"
    r"|(?:Lean\s+)?Six Sigma(?:\s+(?:Green|Black|Yellow|White)\s+Belt)?"
    r"|Tableau(?:\s+Desktop)?\s+(?:Specialist|Certified[\w\s]{0,20})|Qlik[\w\s]{0,15}Certified[\w\s]{0,20}"
    r"|Databricks Certified[\w\s]{0,30}|Snowflake[\w\s]{0,15}Certified[\w\s]{0,30}|Oracle Certified[\w\s]{0,30}"
    r"|SAP Certified[\w\s]{0,40}|Salesforce Certified[\w\s]{0,40}|Teradata Certified[\w\s]{0,30}"
    r"|Alteryx Certified[\w\s]{0,30}|(?-i:Certified(?:\s+[A-Z][\w+]*){1,4}))(?![A-Za-z0-9])")
SENIORITY = (
    r"(?i)\b(intern|trainee|junior|jr\.?|associate|senior|sr\.?|staff" + tx.LADDER +
    r"|principal|lead(?!\s+generation)|head of|director|vp|manager)\b")
TITLE_LABEL = r"(?i)^(?:job\s*title|role|position)\s*[:\-]"
LOCATION = (
    r"(?i)\b(?:location|based in|located in|office in|situated in|work from)\s*[:\-]?\s*([A-Za-z][A-Za-z .,'’&]{2,50})")
SALARY_CONTEXT = (
    r"(?i)\b(?:salary|compensation|ctc|pay(?:\s+range|\s+scale)?|paying|per annum|annually|lpa|lakhs?|per month|monthly|budget(?:ed)?"
    r"|INR|USD|GBP|EUR|AED|SAR|QAR|CAD|SGD|AUD)\b|[₹$£€]")
AMOUNT = (
    r"(?i)([₹$£€])?\s*(\d[\d,]*(?:\.\d+)?)\s*(?:(lpa|lakhs?|lacs?|million|k|m)(?![a-z]))?(?=(.{0,10}))")
YEARS_NEXT = r"(?i)^\s*\+?\s*(?:years?|yrs?)\b"
CURRENCY_CODE = (
    r"(?<![A-Za-z])(US\$|C\$|S\$|A\$|Rs\.?|INR|USD|GBP|EUR|AED|SAR|QAR|KWD|BHD|OMR|CAD|SGD|AUD|NZD|CHF|JPY|HKD|ZAR)(?![A-Za-z])")
LAKH_WORDS = ("lpa", "lakh", "lakhs", "lac", "lacs")
LINE_UNIT = r"(?i)\b(lpa|lakhs?|lacs?|million)\b"

# What a line must contain for the patterns above to match at all: most lines are ruled out by these before a pattern is tried.
YEARS_CUES = ("year", "yr")
DEGREE_CUE = r"(?i)\b(?:diploma|doctorate|b[.abst]|undergraduate|graduate|m(?:ba|aster|[.s])|ph\.?d)"
MODE_CUES = ("remote", "hybrid", "site", "office", "person", "wfo")
SPONSOR_CUES = ("sponsor", "visa")
AUTH_CUES = ("to work", "work authori")
LOCATION_CUES = ("location", "based in", "located in", "office in", "situated in", "work from")


# ------------------------------------------------------------------ one filter each

def cued(lines: Column, cues: tuple[str, ...]) -> Column:
    """The lines that contain one of the cues, in any case."""
    return F.filter(lines, lambda s: ar.let(F.lower(s["line"]), lambda low: tx.any_of([F.contains(low, F.lit(c)) for c in cues])))


def years_floor(lines: Column) -> Column:
    """struct<value, line>: lowest figure under requirements, else lowest anywhere; softened lines ignored."""
    def figures(s: Column) -> Column:
        floors = F.array_compact(F.array(*[tx.first_match(s["line"], p, 1).cast("double") for p in YEAR_PATTERNS]))
        usable = F.when(~tx.matches(s["line"], YEARS_SOFT), floors).otherwise(F.array().cast("array<double>"))
        return F.transform(usable, lambda v: F.struct(
            v.alias("value"), s["line_no"].alias("line_no"), s["line"].alias("line"), s["section"].alias("section")))

    return ar.let(F.flatten(F.transform(cued(lines, YEARS_CUES), figures)), lambda rows: F.coalesce(
        F.array_min(F.filter(rows, lambda r: r["section"] == "hard")), F.array_min(rows)))


def degree_in(clause: Column) -> Column:
    """Lowest degree a clause names."""
    chain = None
    for level, pattern in DEGREE_PATTERNS.items():
        chain = F.when(tx.matches(clause, pattern), level) if chain is None else chain.when(tx.matches(clause, pattern), level)
    return chain


def degree_floor(lines: Column) -> Column:
    """struct<rank, .., level, line, mandatory>: lowest mandatory clause, else lowest softened one."""
    def named(s: Column) -> Column:
        parts = F.transform(F.split(s["line"], r";|\.\s", -1), lambda c, i: ar.let(degree_in(c), lambda level: F.struct(
            tx.lookup(V.DEGREE_RANK, level).alias("rank"), s["line_no"].alias("line_no"), i.alias("clause_no"),
            level.alias("level"), s["line"].alias("line"), (~tx.matches(c, DEGREE_SOFT)).alias("mandatory"))))
        return F.filter(parts, lambda p: p["level"].isNotNull())

    able = F.filter(lines, lambda s: tx.matches(s["line"], DEGREE_CUE))
    return ar.let(F.flatten(F.transform(able, named)), lambda rows: F.coalesce(
        F.array_min(F.filter(rows, lambda r: r["mandatory"])), F.array_min(rows)))


def certifications(lines: Column) -> Column:
    """array<struct<cert, line, mandatory>>, first spelling of each, in reading order."""
    found = F.flatten(F.transform(lines, lambda s: F.transform(tx.find_all(s["line"], CERTIFICATION, 1), lambda c: F.struct(
        tx.strip(c).alias("cert"), s["line_no"].alias("line_no"), s["line"].alias("line"),
        (~tx.matches(s["line"], DEGREE_SOFT)).alias("mandatory")))))
    return ar.let(found, lambda rows: ar.distinct_by(rows, lambda r: F.lower(r["cert"])))


def work_modes(lines: Column) -> Column:
    """array<struct<mode, line>>; office wording on a hybrid line is not a second mode."""
    def modes(s: Column) -> Column:
        hybrid = tx.matches(s["line"], MODE_PATTERNS["hybrid"])
        hits = [
            F.when(tx.matches(s["line"], p) & (~hybrid if mode == "onsite" else F.lit(True)), F.lit(mode))
            for mode, p in MODE_PATTERNS.items()
        ]
        return F.transform(F.array_compact(F.array(*hits)), lambda m: F.struct(
            m.alias("mode"), s["line_no"].alias("line_no"), s["line"].alias("line")))

    return ar.let(F.flatten(F.transform(cued(lines, MODE_CUES), modes)), lambda rows: ar.distinct_by(rows, lambda r: r["mode"]))


def first_line(lines: Column, pattern: str, cues: tuple[str, ...]) -> Column:
    return ar.first(F.filter(cued(lines, cues), lambda s: tx.matches(s["line"], pattern)))


def salary_in(line: Column) -> Column:
    """struct<min, max, currency> stated on one pay line, null where no amount can be placed."""
    cells = F.arrays_zip(*[tx.find_all(line, AMOUNT, g).alias(n) for g, n in ((1, "cur"), (2, "amt"), (3, "unit"), (4, "tail"))])
    money = F.transform(
        F.filter(cells, lambda m: ~tx.matches(m["tail"], YEARS_NEXT)),
        lambda m: F.struct(m["cur"].alias("cur"), F.replace(m["amt"], F.lit(","), F.lit("")).cast("double").alias("amt"),
                           F.lower(m["unit"]).alias("unit")))

    def read(rows: Column) -> Column:
        code = F.upper(tx.rstrip(tx.first_match(line, CURRENCY_CODE, 1), "."))
        symbol = F.get(F.filter(ar.field(rows, "cur"), lambda c: c != ""), 0)
        lakh = F.exists(rows, lambda m: m["unit"].isin(*LAKH_WORDS)) | tx.matches(line, r"(?i)\b(?:lpa|lakhs?|lacs?)\b")
        currency = F.coalesce(tx.lookup(V.CURRENCY_SPELLINGS, code, code), tx.lookup(V.CURRENCY_SYMBOLS, symbol), F.when(lakh, "INR"))
        line_unit = F.coalesce(F.lower(tx.first_match(line, LINE_UNIT, 1)), F.lit(""))
        a, b = F.get(rows, 0), F.get(rows, 1)
        given = lambda *units: F.coalesce(*[F.nullif(u, F.lit("")) for u in units], F.lit(""))
        scaled = lambda amt, unit: amt * (
            F.when(unit.isin(*LAKH_WORDS), 100_000.0).when(unit.isin("m", "million"), 1_000_000.0)
            .when(unit == "k", 1_000.0).otherwise(1.0))
        low, high = scaled(a["amt"], given(a["unit"], b["unit"], line_unit)), scaled(b["amt"], given(b["unit"], a["unit"], line_unit))
        one = scaled(a["amt"], given(a["unit"], line_unit))
        upper = tx.matches(line, r"(?i)\bup to\b")
        lower = tx.matches(line, r"(?i)\b(?:from|starting(?: at)?|minimum(?: of)?)\b") | tx.matches(line, r"\d[\d,]*(?:\.\d+)?\s*\+")
        pair = lambda x, y: F.struct(x.cast("double").alias("min"), y.cast("double").alias("max"), currency.alias("currency"))
        nothing = F.lit(None)
        return (F.when(F.size(rows) >= 2, pair(F.least(low, high), F.greatest(low, high)))
                .when((F.size(rows) == 1) & upper, pair(nothing, one))
                .when((F.size(rows) == 1) & lower, pair(one, nothing)))

    return ar.let(money, read)


def salary(lines: Column) -> Column:
    """struct<min, max, currency, line> from the first pay line that states a usable figure."""
    read = F.transform(F.filter(lines, lambda s: tx.matches(s["line"], SALARY_CONTEXT)),
                       lambda s: F.struct(salary_in(s["line"]).alias("pay"), s["line"].alias("line")))
    return ar.first(F.filter(read, lambda r: r["pay"].isNotNull()))


def money_text(amount: Column) -> Column:
    return F.when(amount.isNotNull(), F.format_string("%.2f", amount)).otherwise("")


def location(lines: Column) -> Column:
    """struct<place, line> from the first location phrase."""
    return ar.let(first_line(lines, LOCATION, LOCATION_CUES), lambda s: F.when(s.isNotNull(), F.struct(
        F.btrim(F.get(F.split(F.regexp_extract(s["line"], LOCATION, 1), r"\.\s", 2), 0), F.lit(" .,-")).alias("place"),
        s["line"].alias("line"))))


def title_line(lines: Column) -> Column:
    labelled = F.filter(F.slice(lines, 1, 6), lambda s: tx.matches(s["line"], TITLE_LABEL))
    return F.coalesce(F.get(labelled, 0)["line"], F.get(lines, 0)["line"])


def seniority_in(line: Column) -> Column:
    return tx.rstrip(F.lower(tx.first_match(line, SENIORITY, 1)), ".")


def seniority_rank(label: Column) -> Column:
    key = tx.rstrip(tx.strip(F.lower(F.coalesce(label, F.lit("")))), ".")
    return tx.lookup(V.SENIORITY_RANK, key, F.lit(3))


def education_rank(level: Column) -> Column:
    return tx.lookup(V.EDUCATION_RANK, tx.strip(F.lower(F.coalesce(level, F.lit("")))), F.lit(0))


# ------------------------------------------------------------------ DataFrame operators

def requirement_parts(postings: DataFrame, *, text: str = "jd_text", key: str = "jd_id") -> DataFrame:
    """One row per posting with each filter and the line behind it."""
    lines = postings.select(key, text, ex.sectioned_lines(F.col(text)).alias("_l"))
    ls = F.col("_l")
    return lines.select(
        key,
        years_floor(ls).alias("years"), degree_floor(ls).alias("degree"), certifications(ls).alias("certs"),
        work_modes(ls).alias("modes"), first_line(ls, NO_SPONSORSHIP, SPONSOR_CUES)["line"].alias("no_sponsor_line"),
        first_line(ls, WORK_AUTH, AUTH_CUES)["line"].alias("work_auth_line"), salary(ls).alias("salary"), location(ls).alias("location"),
        tx.countries_in(F.col(text)).alias("countries"), title_line(ls).alias("title_line"),
    )


def jd_requirements(postings: DataFrame, *, text: str = "jd_text", key: str = "jd_id") -> DataFrame:
    """The wide requirement record."""
    return requirement_parts(postings, text=text, key=key).select(
        key,
        F.col("years.value").alias("min_years"), F.col("degree.level").alias("min_degree"),
        F.coalesce("degree.mandatory", F.lit(True)).alias("degree_mandatory"),
        ar.field(F.col("certs"), "cert").alias("certifications"), ar.field(F.col("modes"), "mode").alias("work_modes"),
        F.col("no_sponsor_line").isNotNull().alias("sponsorship_unavailable"),
        F.col("work_auth_line").isNotNull().alias("work_auth_required"),
        F.coalesce(seniority_in(F.col("title_line")), F.lit("")).alias("seniority"),
        F.col("salary.pay.min").alias("salary_min"), F.col("salary.pay.max").alias("salary_max"),
        F.col("salary.pay.currency").alias("salary_currency"),
        F.coalesce("location.place", F.lit("")).alias("jd_location"), "countries",
        F.coalesce(tx.clean_title(F.col("title_line")), F.lit("")).alias("jd_title"),
        "certs", "modes", F.col("years.line").alias("years_line"), F.col("degree.line").alias("degree_line"),
        "no_sponsor_line", "work_auth_line", F.col("salary.line").alias("salary_line"),
        F.col("location.line").alias("location_line"), "title_line",
    )


def requirement_evidence(postings: DataFrame, *, text: str = "jd_text", key: str = "jd_id") -> DataFrame:
    """(key, item_no, kind, value, source_line, mandatory) in the order the filters are read."""
    def item(kind: str, value: Column, line: Column, mandatory: Column = F.lit(True)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), line.alias("source_line"), mandatory.alias("mandatory"))

    def maybe(present: Column, entry: Column) -> Column:
        return F.when(present, F.array(entry)).otherwise(F.filter(F.array(entry), lambda _: F.lit(False)))

    level = seniority_in(F.col("title_line"))
    pay = F.concat_ws("|", money_text(F.col("salary.pay.min")), money_text(F.col("salary.pay.max")), F.coalesce("salary.pay.currency", F.lit("")))
    place = F.coalesce("location.place", F.lit(""))
    entries = F.concat(
        maybe(F.col("years").isNotNull(), item("min_years", F.format_string("%.0f", "years.value"), F.col("years.line"))),
        maybe(F.col("degree").isNotNull(), item("min_degree", F.col("degree.level"), F.col("degree.line"), F.col("degree.mandatory"))),
        F.transform("certs", lambda c: item("certification", c["cert"], c["line"], c["mandatory"])),
        F.transform("modes", lambda m: item("work_mode", m["mode"], m["line"])),
        maybe(F.col("no_sponsor_line").isNotNull(), item("sponsorship_unavailable", F.lit("true"), F.col("no_sponsor_line"))),
        maybe(F.col("work_auth_line").isNotNull(), item("work_auth_required", F.lit("true"), F.col("work_auth_line"))),
        maybe(F.col("salary").isNotNull(), item("salary", pay, F.col("salary.line"), F.lit(False))),
        maybe(F.col("location").isNotNull(), item("location", F.col("location.place"), F.col("location.line"), F.lit(False))),
        maybe(F.size("countries") > 0, item(
            "countries", F.array_join("countries", "|"),
            F.when(place != "", place).otherwise("country mentioned in the JD"), F.lit(False))),
        maybe(level.isNotNull(), item("seniority", level, F.col("title_line"))),
    )
    parts = requirement_parts(postings, text=text, key=key)
    numbered = F.transform(entries, lambda e, i: F.struct(
        (i + 1).alias("item_no"), *[e[n].alias(n) for n in ("kind", "value", "source_line", "mandatory")]))
    return ar.unpack(parts, [key], numbered, "kind")


def first_citation(evidence: DataFrame, *, key: str = "jd_id") -> DataFrame:
    """First cited line per (posting, kind)."""
    return evidence.groupBy(key, "kind").agg(F.min_by("source_line", "item_no").alias("source_line"))
