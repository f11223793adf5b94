"""Writing review over composed applicant documents and the driver's prose."""
from __future__ import annotations

from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import text as tx
from hiresift.operators import writing as wr
from hiresift.plans import common as c
from hiresift.plans import derived as D
from hiresift.plans.q_text import DOC_LINES, RESUME_LINES, TAX

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def records_sql(text):
    """Records of documents (candidate_id, text): islands of lines by windows over break flags, then roles by header flags."""
    def boundary(x):
        parts = f"regexp_split_to_array({x}, '\\s*[,|/]\\s*')"
        return f"(regexp_matches({x}, '{wr.SKILLS_HEADING}') OR regexp_matches({x}, '{wr.OTHER_HEADING}') OR regexp_matches({x}, '{wr.DATED}') OR (len({parts}) = 2 AND len(list_filter({parts}, lambda p: regexp_matches(p, '{wr.ROLE_TITLE}'))) > 0))"

    def short(x, above):
        words = f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
        return f"(regexp_matches({x}, '^\\p{{Lu}}') AND {words} <= 4 AND regexp_matches(after, '{wr.BULLET}') AND NOT regexp_matches({above}, '{wr.CONNECTOR}'))"

    by = "PARTITION BY candidate_id ORDER BY line_no"
    return rf"""l0 AS (SELECT candidate_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM ({text})),
 l1 AS (SELECT *, trim(raw, {c.WS}) AS line, coalesce(lag(raw) OVER ({by}), '') AS before, coalesce(lead(raw) OVER ({by}), '') AS after FROM l0),
 l2 AS (SELECT *, line = '' AS blank, regexp_matches(line, '{wr.SKILLS_HEADING}') AS skills, regexp_matches(line, '{wr.SKILLS_HEADING}') OR regexp_matches(line, '{wr.OTHER_HEADING}') AS heading FROM l1),
 l3 AS (SELECT *, coalesce(last_value(CASE WHEN skills THEN 1 WHEN heading THEN 0 END IGNORE NULLS) OVER ({by} ROWS UNBOUNDED PRECEDING), 0) = 1 AS in_skills FROM l2),
 l4 AS (SELECT *, coalesce(NOT lag(blank) OVER ({by}) AND NOT lag(heading) OVER ({by}) AND NOT lag(in_skills) OVER ({by}), false) AND NOT blank AND NOT heading AND NOT in_skills
  AND NOT regexp_matches(raw, '{wr.BULLET}') AND NOT {boundary('line')} AND NOT {short('line', f'trim(before, {c.WS})')} AS able FROM l3),
 l5 AS (SELECT *, coalesce(able AND (regexp_matches(line, '^\p{{Ll}}') OR regexp_matches(raw, '^\s') OR last_value(CASE WHEN NOT able THEN regexp_matches(line, '{wr.BULLET}') END IGNORE NULLS) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), false) AS joins FROM l4),
 l6 AS (SELECT *, sum(CASE WHEN blank OR joins THEN 0 ELSE 1 END) OVER ({by} ROWS UNBOUNDED PRECEDING) AS island FROM l5 WHERE NOT blank),
 r0 AS (SELECT candidate_id, min(line_no) AS line_no, string_agg(line, ' ' ORDER BY line_no) AS text, arg_min(before, line_no) AS before, arg_min(after, line_no) AS after FROM l6 GROUP BY candidate_id, island),
 r1 AS (SELECT *, regexp_matches(text, '{wr.BULLET}') AS is_bullet, trim(regexp_replace(text, '{wr.BULLET}', ''), {c.WS}) AS body FROM r0),
 rec AS (SELECT *, sum(CASE WHEN NOT is_bullet AND ({boundary('text')} OR {short('text', 'before')} OR (line_no > 1 AND trim(before, {c.WS}) = '')) THEN 1 ELSE 0 END) OVER ({by} ROWS UNBOUNDED PRECEDING) AS role FROM r1)"""


def wrapped(t):
    """Applicant documents with their longer lines broken once, as a page would break them."""
    return c.resumes(t).select("candidate_id", F.regexp_replace("text", WRAP, "$1\n$2").alias("text"))


WRAP = r"(?m)^(.{24,40}) (\S+ .*)$"
WRAPPED = f"SELECT candidate_id, regexp_replace(text, '{WRAP}', '\\1' || chr(10) || '\\2', 'g') AS text FROM ({D.RESUME})"


@query("join_continuations", f"WITH {records_sql(WRAPPED)} SELECT candidate_id, line_no, text FROM rec")
def join_continuations(t):
    return wr.join_continuations(wrapped(t), "candidate_id")


GENERIC, UNCLEAR = wr.RULES["generic_phrase"][0], wr.RULES["unclear_contribution"][0]
BODY = "regexp_replace(line, '^\\s*(?:[-*•●▪◦–➢►]|o)\\s+', '')"


# in the composed documents no finding sits on a wrapped line
@query("rule_findings", f"""SELECT candidate_id, line_no, 'generic_phrase' AS rule, array_to_string(regexp_extract_all(line, '{GENERIC}'), '|') AS matches FROM ({RESUME_LINES}) WHERE regexp_matches(line, '{GENERIC}')
 UNION ALL SELECT candidate_id, line_no, 'unclear_contribution', array_to_string(regexp_extract_all({BODY}, '{UNCLEAR}'), '|') FROM ({RESUME_LINES}) WHERE starts_with(line, '- ') AND regexp_matches({BODY}, '{UNCLEAR}')""")
def rule_findings(t):
    return wr.rule_findings(c.resumes(t), "candidate_id").drop("excerpt")


def two_page(t):
    """Applicant documents with each role's bullets listed twice, so openers repeat."""
    doubled = F.regexp_replace("text", r"(?m)^(- \w+)( .*)$", "$1$2\n$1$2\n$1$2")
    return c.resumes(t).select("candidate_id", doubled.alias("text"))


TWO_PAGE = f"SELECT candidate_id, regexp_replace(text, '(?m)^(- \\w+)( .*)$', '\\1\\2' || chr(10) || '\\1\\2' || chr(10) || '\\1\\2', 'g') AS text FROM ({D.RESUME})"


@query("repeated_openers", f"""WITH {records_sql(TWO_PAGE)}, o AS (SELECT *, lower(regexp_extract(body, '[A-Za-z]+')) AS opener FROM rec WHERE is_bullet AND regexp_matches(body, '[A-Za-z]'))
 SELECT candidate_id, line_no, 'repeated_opener' AS rule, opener AS matches FROM o QUALIFY count(*) OVER (PARTITION BY candidate_id, role, opener) >= {wr.OPENER_REPEATS}""")
def repeated_openers(t):
    return wr.repeated_openers(two_page(t), "candidate_id").drop("excerpt")


@query("count_metrics")
def count_metrics(t):
    return t.documents.select("doc_id", wr.count_metrics(F.col("text")).alias("n_metrics"))


BUZZ = ", ".join(f"'{w}'" for w in V.PROMOTIONAL_ITEMS)
ITEMS = r"list_filter(list_transform(regexp_split_to_array(trim(m, ' .!?;:'), ',\s*(?:and\s+)?|\s+and\s+'), lambda i: trim(i)), lambda i: i <> '')"


@query("promotional_lists", f"""WITH h AS (SELECT candidate_id, line_no, unnest(regexp_extract_all(line, '{wr.TRIPLE}')) AS m FROM ({RESUME_LINES})), x AS (SELECT *, {ITEMS} AS it FROM h)
 SELECT candidate_id, line_no, m AS matches FROM x WHERE len(it) = 3 AND len(list_filter(it, lambda i: lower(i) IN ({BUZZ}))) >= 2 AND len(list_filter(it, lambda i: lower(i) IN ({TAX}))) = 0""")
def promotional_lists(t):
    return wr.promotional_lists(c.resumes(t), "candidate_id").drop("excerpt", "rule")


@query("grouped_findings", f"""WITH f AS (SELECT candidate_id, line_no, line, 'generic_phrase' AS rule FROM ({RESUME_LINES}) WHERE regexp_matches(line, '{GENERIC}')
 UNION ALL SELECT candidate_id, line_no, line, 'unclear_contribution' FROM ({RESUME_LINES}) WHERE starts_with(line, '- ') AND regexp_matches({BODY}, '{UNCLEAR}'))
 SELECT candidate_id, line_no, string_agg(DISTINCT rule, '|' ORDER BY rule) AS issues FROM f GROUP BY 1, 2""")
def grouped_findings(t):
    found = wr.rule_findings(c.resumes(t), "candidate_id")
    return wr.grouped_findings(found, "candidate_id").select("candidate_id", "line_no", c.joined("issues").alias("issues"))


@query("writing_review")
def writing_review(t):
    return wr.review(two_page(t), "candidate_id")
