"""Writing review: line findings per document, computed inside the document's row."""
from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import terms as tm
from hiresift.functions import text as tx

# ---- fixed patterns
BULLET = r"^\s*(?:[-*•●▪◦–➢►]|o)\s+"
SKILLS_HEADING = (
    r"(?i)^(?:(?:technical |key |core )?skills(?: (?:and|&) (?:technologies|tools))?|core competencies|tech stack"
    r"|tools(?: (?:and|&) technologies)?|technologies)(?:\s*:\s*.*)?$")
OTHER_HEADING = (
    r"(?i)^(?:(?:work |professional |relevant )?experience|employment(?: history)?|work history|education"
    r"|(?:personal |academic |key )?projects|(?:professional )?summary|profile|objective|certifications?|achievements"
    r"|awards|publications|interests):?$")
ROLE_TITLE = (
    r"(?i)\b(?:analyst|engineer|developer|manager|director|consultant|specialist|associate|intern|lead|officer"
    r"|coordinator|designer|researcher|assistant|administrator)\b")
DATED = r"(?i)\b(?:19|20)\d{2}\b|\bPresent\b"
CONNECTOR = r"\b(?:the|a|an|of|and|for|to|in|with|on|by|using)\s*$"
RULES = {
    "generic_phrase": (
        r"(?i)\b(?:results[- ]driven|dynamic professional|highly motivated|proven track record|synerg(?:y|ies)"
        r"|detail[- ]oriented|team player|self[- ]starter|hard[- ]working|passionate)\b", False),
    "unclear_contribution": (
        r"(?i)^(?:(?:was )?responsible for|helped with|worked on|assisted with|involved in|participated in|duties included)\b", True),
}
OPENER_REPEATS = 3
PHONE = r"(?U)(?<!\w)(?:\+?\d|\(\d)[\d()+. \t-]{7,}\d(?!\w)"
CALENDAR = (
    r"\b(?:19|20)\d{2}[-/]\d{1,2}(?:[-/]\d{1,2})?\b|\b\d{1,2}[-/]\d{1,2}[-/](?:19|20)\d{2}\b|\b\d{1,2}[-/](?:19|20)\d{2}\b")
METRIC = r"(?iU)(?<!\w)\d[\d,]*(?:\.\d+)?(?:%|mn|cr|[kmbxl])?(?!\w)"
TRIPLE = r"(?i)[a-z][a-z-]*, [a-z][a-z-]*,? and [a-z][a-z-]*"


# ------------------------------------------------------------------ lines

def role_boundary(excerpt: Column) -> Column:
    parts = F.split(excerpt, r"\s*[,|/]\s*", -1)
    labelled = (F.size(parts) == 2) & F.exists(parts, lambda p: tx.matches(p, ROLE_TITLE))
    return tx.matches(excerpt, SKILLS_HEADING) | tx.matches(excerpt, OTHER_HEADING) | tx.matches(excerpt, DATED) | labelled


def short_role_header(excerpt: Column, previous: Column, following: Column) -> Column:
    return (tx.matches(excerpt, r"^\p{Lu}") & (F.size(tx.words(excerpt)) <= 4) & tx.matches(following, BULLET)
            & ~tx.matches(previous, CONNECTOR))


BLANK, SKILLS, HEADING, BREAKS, BULLETED, FLOWS = "bshtuf"


def line_flags(text: Column) -> Column:
    """array<string>: what each line is by itself and beside its neighbours, a letter for each mark."""
    def flags(raw: Column) -> Column:
        def one(ln: Column, i: Column) -> Column:
            def bits(line: Column) -> Column:
                skills = tx.matches(line, SKILLS_HEADING)
                above, after = tx.strip(F.coalesce(F.get(raw, i - 1), F.lit(""))), F.coalesce(F.get(raw, i + 1), F.lit(""))
                breaks = tx.matches(ln, BULLET) | role_boundary(line) | short_role_header(line, above, after)
                flows = tx.matches(line, r"^\p{Ll}") | tx.matches(ln, r"(?U)^\s")
                marks = ((line == "", BLANK), (skills, SKILLS), (skills | tx.matches(line, OTHER_HEADING), HEADING), (breaks, BREAKS),
                         (tx.matches(line, BULLET), BULLETED), (flows, FLOWS))
                return F.concat(*[F.when(on, F.lit(letter)).otherwise("") for on, letter in marks])
            return ar.let(tx.strip(ln), bits)
        return F.transform(raw, one)

    return ar.let(tx.line_array(text), flags)


def islands(lines: list[str]) -> list[tuple[int, int]]:
    """(first, last): runs of lines, from 0, that make one record, by one scan of their marks.

    A line joins the run above when that line is text outside a skills section, nothing breaks here, and either the
    line reads on (lower case, indented) or the run began with a bullet.  Blank lines end a run and belong to none.
    """
    runs, in_skills, open_above, from_bullet = [], False, False, False
    for i, marks in enumerate(lines):
        if BLANK in marks:
            open_above = False
            continue
        in_skills = SKILLS in marks or (in_skills and HEADING not in marks)
        stops = in_skills or HEADING in marks or BREAKS in marks
        if open_above and not stops and (FLOWS in marks or from_bullet):
            runs[-1] = (runs[-1][0], i)
        else:
            runs.append((i, i))
            from_bullet = BULLETED in marks
        open_above = HEADING not in marks and not in_skills
    return runs


def review_records(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, records): wrapped lines joined to the bullet or paragraph above, array<struct<line_no, text, before, after>>.

    Islands of lines, found in one scan; `before` and `after` are the raw neighbours of the first line.
    """
    def record(raw: Column, r: Column) -> Column:
        return F.struct(
            (r["first"] + 1).alias("line_no"),
            F.array_join(F.transform(F.slice(raw, r["first"] + 1, r["last"] - r["first"] + 1), lambda ln: tx.strip(ln)), " ").alias("text"),
            F.coalesce(F.get(raw, r["first"] - 1), F.lit("")).alias("before"), F.coalesce(F.get(raw, r["first"] + 1), F.lit("")).alias("after"))

    given = F.coalesce(F.col(text), F.lit(""))
    rows = ar.scanned(docs.select(F.col(key), given.alias("_text"), line_flags(given).alias("_flags")), "_runs", "array<struct<first:int,last:int>>", "_flags", islands)
    return rows.select(key, ar.let(tx.line_array(F.col("_text")), lambda raw: F.transform("_runs", lambda r: record(raw, r))).alias("records"))


def with_roles(records: DataFrame, key: str) -> DataFrame:
    """(key, rows): array<struct<line_no, text, body, is_bullet, role>>; a role starts at each header-like record."""
    def mark(r: Column) -> Column:
        bullet = tx.matches(r["text"], BULLET)
        header = ~bullet & (role_boundary(r["text"]) | short_role_header(r["text"], r["before"], r["after"])
                            | ((r["line_no"] > 1) & (tx.strip(r["before"]) == "")))
        return F.struct(r["line_no"].alias("line_no"), r["text"].alias("text"), bullet.alias("is_bullet"), header.alias("header"),
                        tx.strip(F.regexp_replace(r["text"], BULLET, "")).alias("body"))

    marked = records.select(key, F.transform("records", mark).alias("_marked"))
    headers = marked.withColumn("_headers", ar.field(F.col("_marked"), "header"))
    counted = ar.scanned(headers, "_roles", "array<int>", "_headers", running)
    return counted.select(key, F.transform("_marked", lambda r, i: F.struct(
        r["line_no"].alias("line_no"), r["text"].alias("text"), r["body"].alias("body"), r["is_bullet"].alias("is_bullet"),
        F.get("_roles", i).alias("role"))).alias("rows"))


def running(flags: list[bool]) -> list[int]:
    """How many of the flags up to each place are set."""
    return list(accumulate(map(int, flags)))


def join_continuations(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    out = F.transform("records", lambda r: F.struct(r["line_no"].alias("line_no"), r["text"].alias("text")))
    return ar.unpack(review_records(docs, key, text), [key], out, "line_no")


# ------------------------------------------------------------------ findings

def _finding(r: Column, rule: str, found: Column) -> Column:
    return F.struct(r["line_no"].alias("line_no"), r["text"].alias("excerpt"), F.lit(rule).alias("rule"), found.alias("matches"))


def rule_hits(rows: Column) -> Column:
    def hits(r: Column) -> Column:
        found = []
        for rule, (pattern, bullets_only) in RULES.items():
            subject = r["body"] if bullets_only else r["text"]
            keep = tx.matches(subject, pattern) & (r["is_bullet"] if bullets_only else F.lit(True))
            found.append(F.when(keep, _finding(r, rule, F.array_join(tx.find_all(subject, pattern), "|"))))
        return F.array_compact(F.array(*found))
    return F.flatten(F.transform(rows, hits))


def often(names: list[str]) -> list[bool]:
    """Whether each of the names, if it isn't empty, stands OPENER_REPEATS times or more among them."""
    n = Counter(names)
    return [x != "" and n[x] >= OPENER_REPEATS for x in names]


def opener(r: Column) -> Column:
    return F.lower(F.regexp_extract(r["body"], "[A-Za-z]+", 0))


def opener_keys(rows: Column) -> Column:
    """One key for each record: role and first word of a bullet, the empty string otherwise."""
    return F.transform(rows, lambda r: F.when(r["is_bullet"] & tx.matches(r["body"], "[A-Za-z]"), F.concat_ws("|", r["role"].cast("string"), opener(r))).otherwise(""))


def opener_hits(rows: Column) -> Column:
    """Bullets whose first word opens three or more bullets of the same role; `_repeated` says which, see `_findings`."""
    return F.transform(F.filter(rows, lambda r, i: F.get("_repeated", i)), lambda r: _finding(r, "repeated_opener", opener(r)))


def promotional(snippet: Column, vocab: V.Vocabulary = V.DEFAULT) -> Column:
    """Three items, at least two of them buzzwords, none a known skill."""
    items = F.filter(F.transform(F.split(F.btrim(snippet, F.lit(" .!?;:")), r",\s*(?:and\s+)?|\s+and\s+", -1), lambda i: tx.strip(i)), lambda i: i != "")

    def test(xs: Column) -> Column:
        buzz = F.size(F.filter(xs, lambda i: tx.among(F.lower(i), V.PROMOTIONAL_ITEMS))) >= 2
        taxonomy = tx.constant_array(vocab.taxonomy)
        known = F.exists(xs, lambda i: tx.among(tm.canonical(i, vocab), vocab.taxonomy) | ar.let(
            tm.alias_normalize(i, vocab), lambda n: F.exists(taxonomy, lambda t: tm.term_in(t, n))))
        return F.when((F.size(xs) == 3) & buzz, ~known).otherwise(False)

    return ar.let(items, test)


def promotional_hits(rows: Column) -> Column:
    return F.flatten(F.transform(rows, lambda r: F.transform(
        F.filter(tx.find_all(r["text"], TRIPLE), lambda s: promotional(s)), lambda m: _finding(r, "promotional_list", m))))


def _findings(docs: DataFrame, key: str, text: str, *makers) -> DataFrame:
    rows = with_roles(review_records(docs, key, text), key)
    if opener_hits in makers:  # openers are counted once for a document
        rows = ar.scanned(rows.withColumn("_openers", opener_keys(F.col("rows"))), "_repeated", "array<boolean>", "_openers", often)
    return ar.unpack(rows, [key], F.concat(*[m(F.col("rows")) for m in makers]), "rule")


def rule_findings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _findings(docs, key, text, rule_hits)


def repeated_openers(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _findings(docs, key, text, opener_hits)


def promotional_lists(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _findings(docs, key, text, promotional_hits)


def review(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All findings of every document."""
    return _findings(docs, key, text, rule_hits, opener_hits, promotional_hits)


def grouped_findings(findings: DataFrame, key: str) -> DataFrame:
    """One row per line with its distinct issues."""
    return findings.groupBy(key, "line_no", "excerpt").agg(F.sort_array(F.collect_set("rule")).alias("issues"))


def count_metrics(text: Column) -> Column:
    """Numeric claims of a document, without phones, dates and years."""
    undated = F.regexp_replace(F.regexp_replace(text, CALENDAR, " "), r"\b(?:19|20)\d{2}\b", " ")

    def mask(line: Column) -> Column:
        contact = tx.matches(line, r"(?i)\b(?:phone|mobile|tel|contact)\b")

        def one(run: Column) -> Column:
            digits = F.length(F.regexp_replace(run, r"[^\d]", ""))
            formatted = tx.matches(run, r"[+().-]|\d[ \t]+\d")
            phone = digits.between(9, 15) & (formatted | contact | (tx.strip(run) == tx.strip(line)))
            return F.when(phone, " ").otherwise(run)

        return tx.substitute(line, PHONE, one)

    counts = F.transform(tx.line_array(undated), lambda ln: F.size(tx.find_all(mask(ln), METRIC)))
    return F.aggregate(counts, F.lit(0), lambda a, n: a + n)
