"""Text scalars: every function takes and returns a Column, all of it JVM-side."""
from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from hiresift import vocab as V

# Line boundaries: CRLF or any single character that ends a line in Unicode text.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0         "
    "       　"
)
WHITESPACE_RUN = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

# Fixed pattern: a "City, ST" region code before a separator.
CITY_REGION = r",\s*[A-Z]{2}\b(?=\s*(?:[-|(–—,]|$))"
# Fixed pattern: clause boundaries inside one line.
CLAUSE_BREAK = r"[;()]|,\s|\s[-–—]\s"
# Fixed pattern: one token, '&' and the like kept inside.
TOKEN = r"[A-Za-z][A-Za-z0-9+.#/&-]{1,}"
TOKEN_TAIL = "+.#/&-"
NUMBER = r"\d[\d,]*(?:\.\d+)?[%+]?"
PLACEHOLDER = r"\[[^\]]*\]"


def strip(c: Column, chars: str = WHITESPACE) -> Column:
    return F.btrim(c, F.lit(chars))


def rstrip(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null when nothing matches."""
    return F.when(matches(c, pattern), F.regexp_extract(c, pattern, group))


def sql_literal(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def constant_array(values) -> Column:
    """A constant array, parsed from one SQL string instead of one call per element."""
    return F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")


_LITERALS: dict = {}


def among(c: Column, values) -> Column:
    """Membership in a constant set; past ten values the optimizer turns it into a hash-set test."""
    key = (id(SparkContext._active_spark_context), tuple(values))
    if key not in _LITERALS:
        _LITERALS[key] = [F.lit(v) for v in key[1]]
    return c.isin(*_LITERALS[key])


def lookup(mapping: dict, key: Column, default: Column | None = None) -> Column:
    """Constant dictionary lookup; the hash-set test keeps the linear map probe off the common path."""
    table = F.expr("map(" + ", ".join(sql_literal(x) for kv in mapping.items() for x in kv) + ")")
    hit = F.when(among(key, mapping), F.element_at(table, key))
    return hit if default is None else F.coalesce(hit, default)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def words(c: Column) -> Column:
    return F.filter(F.split(c, WHITESPACE_RUN, -1), lambda w: w != "")


def squeeze(c: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return strip(F.regexp_replace(c, WHITESPACE_RUN, " "))


def line_array(text: Column) -> Column:
    """All lines, blanks included, in order."""
    return F.split(text, LINE_BREAK, -1)


def kept_lines(text: Column) -> Column:
    """Trimmed non-blank lines as array<struct<line_no, line>>; numbers count every source line."""
    numbered = F.transform(
        line_array(text),
        lambda ln, i: F.struct((i + 1).alias("line_no"), strip(ln).alias("line"), ln.alias("raw")),
    )
    return F.filter(numbered, lambda s: s["line"] != "")


def is_shouting(line: Column) -> Column:
    """At least three words and 70% of them upper-case."""
    from hiresift.functions.arrays import let

    upper = lambda found: F.size(F.filter(found, lambda w: w == F.upper(w)))
    return let(find_all(line, "[A-Za-z]{2,}"), lambda found: (F.size(found) >= 3) & (upper(found) * 10 >= F.size(found) * 7))


def clauses(line: Column) -> Column:
    return F.split(F.regexp_replace(line, CITY_REGION, ""), CLAUSE_BREAK, -1)


def tokens(text: Column) -> Column:
    cleaned = F.transform(find_all(text, TOKEN), lambda t: rstrip(t, TOKEN_TAIL))
    return F.filter(cleaned, lambda t: t != "")


def frequency_tokens(text: Column) -> Column:
    return find_all(F.lower(text), "[a-zA-Z][a-zA-Z0-9+.#/-]{1,}")


def normalize_quote(text: Column) -> Column:
    """Comparison form for quotations: lower case, quotes and dashes folded, other punctuation to a space."""
    folded = F.translate(F.lower(text), "‘’“”\"'`–—−", " " * 10)
    return F.trim(F.regexp_replace(folded, r"(?U)[^\w+#&$₹£€%]+", " "))


def ascii_safe(text: Column) -> Column:
    """Smart punctuation to ASCII."""
    single = F.translate(text, "‐‑‒–—―‘’“” −", "------''\"\" -")
    return F.replace(single, F.lit("…"), F.lit("..."))


def numbers(text: Column) -> Column:
    """Sorted numeric tokens with separators dropped."""
    return F.array_sort(F.transform(find_all(text, NUMBER), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def without_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, "")


def lines_cost(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.size(words(text)) / F.lit(V.WORDS_PER_LINE)).cast("int"))


def ratio_pct(part: Column, whole: Column, scale: int = 1) -> Column:
    """part/whole as a percentage, null when there is nothing to divide by."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")) * 100, scale)


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "Not scored").when(score >= 80, "Strong").when(score >= 60, "Workable")
        .when(score >= 40, "Weak").otherwise("Very weak")
    )


def log_band(score: Column) -> Column:
    return (
        F.when(score >= 80, "80-100 (Strong)").when(score >= 60, "60-79 (Workable)")
        .when(score >= 40, "40-59 (Weak)").when(score.isNotNull(), "0-39 (Very weak)")
    )


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def display_case(canonical: Column) -> Column:
    short = (F.length(canonical) <= 3) & matches(canonical, r"^(?U)\p{L}+$")
    titled = F.array_join(F.transform(words(canonical), capitalize), " ")
    return lookup(V.DISPLAY, canonical, F.when(short, F.upper(canonical)).otherwise(titled))


# ------------------------------------------------------------------ titles

# Fixed patterns: what makes a line a role title and which words are levels.
ROLE_NOUN = (
    r"(?i)\b(?:analyst|engineer|developer|manager|consultant|specialist|scientist|designer|architect|"
    r"administrator|coordinator|executive|officer|accountant|representative|director|intern|lead|associate|"
    r"strategist|programmer|technician|tester|writer|recruiter|advisor|auditor|controller|owner|partner|head|"
    r"generalist|teacher|nurse|planner|agent|assistant|clerk|therapist|pharmacist|physician|editor|instructor|"
    r"trainer|lecturer|professor|supervisor|operator|technologist|coach)s?\b"
)
LADDER = r"(?=\s+(?:\w+\s+)?(?:engineer|scientist|developer|architect|designer))"
TITLE_LEVEL = (
    r"(?i)\b(?:senior|sr\.?|junior|jr\.?|principal|intern(?=\s*[-–—:]|$)|trainee|staff" + LADDER +
    r"|^\s*lead(?=\s+(?!generation)\w)|entry[\s-]level|mid[\s-]level|[iv]{1,3})\b\.?"
)
TITLE_PREFIX = r"(?i)^\s*(?:job\s*title|role|position)\s*[:\-]\s*"


def clean_title(line: Column) -> Column:
    """The searchable role in a title line; '' when the line names no role."""
    from hiresift.functions.arrays import let

    bare = F.regexp_replace(F.regexp_replace(line, TITLE_PREFIX, ""), r"\(.*?\)|\[.*?\]", " ")
    head = F.get(F.split(bare, r"\s[-–—|]\s|\s@\s|,", -1), 0)
    plain = F.regexp_replace(F.regexp_replace(head, TITLE_LEVEL, " "), r"[^A-Za-z0-9&/+.# ]", " ")
    kept = lambda title: (title != "") & (F.size(words(title)) <= 6) & matches(title, ROLE_NOUN)
    return let(F.lower(squeeze(plain)), lambda title: F.when(kept(title), title).otherwise(""))


# ------------------------------------------------------------------ places

def _alternation(aliases) -> str:
    return "|".join(a.replace(".", r"\.") for a in aliases)


COUNTRY_PATTERNS = {c: f"(?i)(?<![a-z])(?:{_alternation(a)})(?![a-z])" for c, a in V.COUNTRY_ALIASES.items()}


def countries_in(text: Column) -> Column:
    """Canonical countries named by country or city, in table order.  A country's pattern is tried where one of its names
    stands at all, within another word or not."""
    from hiresift.functions.arrays import let

    def named(low: Column) -> Column:
        stands = lambda c: any_of([F.contains(low, F.lit(a)) for a in V.COUNTRY_ALIASES[c]])
        return F.array_compact(F.array(*[F.when(stands(c) & matches(text, p), F.lit(c)) for c, p in COUNTRY_PATTERNS.items()]))

    return let(F.lower(text), named)


def normalize_country(name: Column) -> Column:
    """Whole-name match first, then containment, else the name itself."""
    s = F.lower(strip(F.coalesce(name, F.lit(""))))
    exact = {a: c for c, aliases in V.COUNTRY_ALIASES.items() for a in aliases}
    contained = F.get(countries_in(s), 0)
    return F.when(s == "", "").otherwise(F.coalesce(lookup(exact, s), contained, s))


# ------------------------------------------------------------------ employers

def _host_in(host: Column, hosts) -> Column:
    return any_of([(host == h) | host.endswith("." + h) for h in hosts])


def slug_name(slug: Column) -> Column:
    s = F.regexp_replace(slug, "[^A-Za-z0-9_-]", "")
    parts = F.filter(F.split(s, "[-_]+", -1), lambda w: w != "")
    upper = lambda w: (w == F.upper(w)) & (w != F.lower(w))
    name = F.array_join(F.transform(parts, lambda w: F.when(upper(w), w).otherwise(capitalize(w))), " ")
    useless = (s == "") | among(F.lower(s), V.GENERIC_HOST_LABELS) | matches(s, "^[0-9]+$") | (name == "")
    return F.when(~useless, name)


def company_from_url(url: Column) -> Column:
    """Employer named by a posting URL; null on job boards and uninformative hosts."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    rest = F.regexp_replace(full, "^[^:]*://", "")
    authority = F.get(F.split(rest, "[/?#]", 2), 0)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))
    path = F.get(F.split(F.substring(rest, F.length(authority) + 1, F.lit(1_000_000)), "[?#;]", 2), 0)
    segments = F.filter(F.split(path, "/", -1), lambda p: p != "")
    labels = F.split(host, r"\.", -1)
    label = lambda n: F.try_element_at(labels, F.lit(-n))
    country_site = (F.size(labels) >= 3) & (F.length(label(1)) == 2) & (F.length(label(2)) <= 3)
    site = F.when(country_site, label(3)).when(F.size(labels) >= 2, label(2)).otherwise(label(1))
    slug = (
        F.when(_host_in(host, V.PATH_SLUG_HOSTS) & (F.size(segments) > 0), F.get(segments, 0))
        .when(any_of([host.endswith("." + h) for h in V.SUBDOMAIN_SLUG_HOSTS]), F.get(labels, 0))
        .otherwise(site)
    )
    return F.when((F.coalesce(url, F.lit("")) != "") & (host != "") & ~_host_in(host, V.BOARD_HOSTS), slug_name(slug))


def company_from_posting(text: Column) -> Column:
    """Employer from a 'Company: X' line, else from an 'About X' heading."""
    edge = " -*\t"
    stated_pattern = r"(?im)^\W*(?:company|employer|organi[sz]ation)\s*(?:name)?\s*[:\-]\s*([^\n]{2,60})$"
    about_pattern = r"(?im)^\W*about\s+(?:us\s*[:\-–—]\s*)?([^\n:.,;!?]{2,60})"
    stated = strip(first_match(text, stated_pattern, 1), edge)

    def heading(name: Column) -> Column:
        parts = words(name)
        first = F.substring(name, 1, 1)
        capital = (first == F.upper(first)) & (first != F.lower(first))
        return capital & ~F.coalesce(F.lower(F.get(parts, 0)), F.lit("")).isin(*V.ABOUT_SKIP) & (F.size(parts) <= 5)

    about = F.filter(F.transform(find_all(text, about_pattern, 1), lambda n: strip(n, edge)), heading)
    return F.when(stated.isNotNull(), F.nullif(stated, F.lit(""))).otherwise(F.get(about, 0))


# ------------------------------------------------------------------ web pages

def html_to_text(html: Column) -> Column:
    """Page to plain text with its line structure."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)[^>]*>.*?</\1>", " ")
    broken = F.regexp_replace(bare, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/section)[^>]*>", "\n")
    plain = unescape(F.regexp_replace(broken, r"(?s)<[^>]+>", " "))
    lines = F.transform(line_array(plain), lambda ln: strip(F.regexp_replace(ln, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda ln: ln != ""), "\n")


#: the standard's names; a reference ends with a semicolon here
ENTITIES = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
ENTITY = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
WESTERN = {str(n): bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


def _code_point(code: Column) -> Column:
    """A code point as a one-character string, by the rules of HTML: what stands for no character is replaced, and
    128-159 are read as Windows-1252."""
    octets = F.unhex(F.lpad(F.hex(code), 8, "0"))
    sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.coalesce(lookup(WESTERN, code.cast("string")), F.when(sound, F.decode(octets, "utf-32")), F.lit(REPLACEMENT))


def _entity(token: Column) -> Column:
    digits = F.regexp_replace(token, "^&#[xX]?0*|;$", "")
    base = F.when(matches(token, "^&#[xX]"), 16).otherwise(10)
    code = F.when(digits == "", 0).when(F.length(digits) > 8, -1).when(base == 16, F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))
    return F.when(token.startswith("&#"), _code_point(code)).otherwise(F.coalesce(lookup(ENTITIES, F.regexp_replace(token, "^&|;$", "")), token))


def substitute(text: Column, pattern: str, rewrite) -> Column:
    """One left-to-right pass replacing each match by `rewrite(match)`; output is never re-matched."""
    from hiresift.functions.arrays import let

    def one(t: Column) -> Column:
        hits = F.transform(find_all(t, pattern), rewrite)
        pairs = F.zip_with(F.split(t, pattern, -1), hits, lambda p, h: F.concat(F.coalesce(p, F.lit("")), F.coalesce(h, F.lit(""))))
        return F.when(matches(t, pattern), F.array_join(pairs, "")).otherwise(t)

    return let(text, one)


def unescape(text: Column) -> Column:
    return substitute(text, ENTITY, _entity)
