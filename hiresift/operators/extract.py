"""Weighted terms from postings.

A posting is one row of bounded text, so sections, clauses, offers and the per-term maximum are array
expressions over that row: extraction reads each posting once, adds no shuffle, and runs the same on a stream.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import terms as tm
from hiresift.functions import text as tx

# Fixed patterns.
BULLET_START = r"^\s*(?:[-*•·▪◦‣–—>]|\d+[.)])\s*"
SOFTENED = r"(?i)\bpreferred\b|\bnice[\s-]to[\s-]have\b|\ba plus\b|\bbonus\b|\bdesirable\b|\bideally\b"
ACRONYM = "^[A-Z]{2,6}$"
EXAM_CODE = r"^[A-Z]{2}-\d{3}$"


# ------------------------------------------------------------------ sections

HEADER_LENGTH = 40  # no header is as long, and no pattern of one can match so much
ANY_HEADER = "|".join(p for patterns in V.SECTION_HEADERS.values() for p in patterns)


def header_section(line: Column) -> Column:
    """Section a line opens, null for body lines.  Bullets never open one; one combined pattern rules out most
    lines before the sections are told apart."""
    def looks_like_header(lower: Column) -> Column:
        long_words = F.filter(tx.find_all(line, "[A-Za-z']+"), lambda w: F.length(w) >= 4)
        shouted = (line == F.upper(line)) & (line != F.lower(line))
        titled = ar.let(long_words, lambda ws: (F.size(ws) > 0) & (shouted | F.forall(ws, lambda w: tx.matches(w, "^[A-Z]"))))
        return line.endswith(":") | titled

    def name(lower: Column, headerish: Column) -> Column:
        chain = None
        for section, patterns in V.SECTION_HEADERS.items():
            alt = "|".join(patterns)
            hit = tx.matches(lower, f"^(?:{alt})$") | (headerish & tx.matches(lower, alt))
            chain = F.when(hit, section) if chain is None else chain.when(hit, section)
        return chain

    lower = tx.strip(tx.rstrip(F.lower(line), ":"))
    possible = (F.length(lower) < HEADER_LENGTH) & ~tx.matches(line, BULLET_START) & tx.matches(F.lower(line), ANY_HEADER)
    return F.when(possible, ar.let(lower, lambda lo: ar.let(looks_like_header(lo), lambda h: name(lo, h))))


def sectioned_lines(text: Column) -> Column:
    """array<struct<line_no, line, section>>; body lines inherit the nearest header above."""
    kept = F.transform(tx.kept_lines(text), lambda s: F.struct(
        s["line_no"].alias("line_no"), s["line"].alias("line"), header_section(s["line"]).alias("opens")))

    def place(rows: Column) -> Column:
        heads = F.filter(rows, lambda h: h["opens"].isNotNull())
        return ar.let(heads, lambda hs: F.transform(rows, lambda s: F.struct(
            s["line_no"].alias("line_no"), s["line"].alias("line"),
            F.coalesce(
                F.try_element_at(F.filter(hs, lambda h: h["line_no"] <= s["line_no"]), F.lit(-1))["opens"],
                F.lit("default")).alias("section"))))

    return ar.let(kept, place)


# ------------------------------------------------------------------ offers

def effective_section(clause: Column, section: Column) -> Column:
    """A softened clause of a requirement line counts as nice-to-have."""
    return F.when(section.isin(*V.HARD_SECTIONS) & tx.matches(clause, SOFTENED), "nice").otherwise(section)


def phrase_terms(clause: Column, vocab: V.Vocabulary = V.DEFAULT) -> Column:
    """Multi-word taxonomy terms that occur anywhere in the alias-normalised clause."""
    return ar.let(tm.searchable(clause, vocab), lambda hay: F.filter(tm.phrases_of(vocab), lambda t: F.contains(hay, t)))


def token_terms(clause: Column, shouting: Column, vocab: V.Vocabulary = V.DEFAULT) -> Column:
    """array<struct<token, term, kind, in_phrase>> for the tokens of a clause that can be terms."""
    def classify(toks: Column) -> Column:
        def one(tok: Column, i: Column) -> Column:
            return ar.let(tx.rstrip(tok, tx.TOKEN_TAIL), lambda clean: ar.let(F.lower(clean), lambda low: read(clean, low, i)))

        def read(clean: Column, lower: Column, i: Column) -> Column:
            def shape(low: Column) -> Column:
                blocked = tx.among(low, V.STOPWORDS + V.NON_SKILL_ACRONYMS) | (F.length(low) < 2)
                pair = F.concat(F.lower(F.get(toks, i - 1)), F.lit(" "), low)
                kind = (
                    F.when(blocked, F.lit(None).cast("string"))
                    .when(tx.matches(clean, ACRONYM) & ~shouting, "acronym")
                    .when(tx.matches(clean, EXAM_CODE), "exam_code")
                    .when(tm.is_known(low, vocab), "taxonomy")
                )
                # most tokens are no term: only the others are spelled out
                return ar.let(kind, lambda k: F.when(k.isNotNull() & (clean != ""), F.struct(
                    clean.alias("token"), tx.lookup(vocab.aliases, low, low).alias("term"), k.alias("kind"),
                    F.coalesce((i > 0) & tm.is_phrase(pair, vocab), F.lit(False)).alias("in_phrase"))))
            return ar.let(tm.plural_fold(lower, vocab), shape)

        return F.array_compact(F.transform(toks, one))
    return ar.let(tx.find_all(clause, tx.TOKEN), classify)


def clause_offers(clause: Column, section: Column, shouting: Column, vocab: V.Vocabulary) -> Column:
    bumped = lambda kind: F.when(kind == "taxonomy", 1.0).otherwise(V.ACRONYM_BUMP)

    def offered(placed: Column) -> Column:
        offer = lambda term, bump: F.struct(term.alias("term"), placed.alias("section"), bump.alias("bump"))
        phrases = F.transform(phrase_terms(clause, vocab), lambda t: offer(tm.canonical(t, vocab), F.lit(1.0)))
        singles = F.transform(
            F.filter(token_terms(clause, shouting, vocab), lambda s: ~s["in_phrase"]),
            lambda s: offer(s["term"], bumped(s["kind"])))
        return F.concat(phrases, singles)

    return ar.let(effective_section(clause, section), offered)


def offers(lines: Column, vocab: V.Vocabulary = V.DEFAULT) -> Column:
    """Every term a posting offers, in reading order: array<struct<term, section, bump>>."""
    def of_line(s: Column) -> Column:
        return ar.let(tx.is_shouting(s["line"]), lambda shouting: F.flatten(F.transform(
            tx.clauses(s["line"]), lambda c: clause_offers(c, s["section"], shouting, vocab))))

    return F.flatten(F.transform(lines, of_line))


# ------------------------------------------------------------------ weights

def section_weight(section: Column) -> Column:
    return tx.lookup(V.SECTION_WEIGHTS, section, F.lit(1.0))


def weigh(offered: Column) -> Column:
    """One keyword per term: strongest section (first mention on ties), largest bump, first position;
    employer blurbs dropped.  array<struct<term, weight, section, first_pos>> in first-mention order."""
    placed = F.transform(offered, lambda o, i: F.struct(
        o["term"].alias("term"),
        F.struct(section_weight(o["section"]).alias("w"), (-i).alias("neg"), o["section"].alias("section")).alias("best"),
        o["bump"].alias("bump"), i.alias("pos")))

    def group(rows: Column) -> Column:
        def one(term: Column) -> Column:
            def fold(mine: Column) -> Column:
                bump = F.array_max(ar.field(mine, "bump"))
                return ar.let(F.array_max(ar.field(mine, "best")), lambda best: F.struct(
                    term.alias("term"), F.bround(best["w"] * bump, 2).cast("decimal(6,2)").alias("weight"),
                    best["section"].alias("section"), F.get(mine, 0)["pos"].alias("first_pos")))
            return ar.let(F.filter(rows, lambda r: r["term"] == term), fold)
        return F.transform(F.array_distinct(ar.field(rows, "term")), one)

    return F.filter(ar.let(placed, group), lambda k: k["section"] != "about")


def strongest(keywords: Column, n: int | None) -> Column:
    """Top n by weight, then first mention, then name; all of them without n."""
    ranked = F.sort_array(F.transform(keywords, lambda k: F.struct(
        (-k["weight"]).alias("order"), k["first_pos"].alias("first_pos"), k["term"].alias("term"),
        k["weight"].alias("weight"), k["section"].alias("section"))))
    return F.transform(ranked if n is None else F.slice(ranked, 1, n), lambda k, i: F.struct(
        k["term"].alias("term"), k["weight"].alias("weight"), k["section"].alias("section"),
        k["first_pos"].alias("first_pos"), (i + 1).alias("rank")))


# ------------------------------------------------------------------ alternatives

def _alternation(terms: Column) -> Column:
    by_length = F.sort_array(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.array_join(F.transform(by_length, lambda s: F.concat(F.lit(r"\Q"), s["t"], F.lit(r"\E"))), "|")


def or_lists(terms: Column, lines: Column) -> Column:
    """Term groups written as one either/or list ("A, B or C", "A/B"): array<array<term>>."""
    item = F.concat(F.lit(r"(?:(?:advanced|basic|strong)\s+)?(?:"), _alternation(terms), F.lit(")s?"))
    pattern = F.concat(item, F.lit(r"(?:\s*(?:,\s*or\b|,|/|\bor\b)\s*"), item, F.lit(")+"))

    def members(p: Column) -> Column:
        able = F.filter(lines, lambda s: F.contains(s, F.lit("/")) | tx.matches(s, r"\bor\b"))
        lists = F.flatten(F.transform(able, lambda s: F.regexp_extract_all(s, p, 0)))
        either = F.filter(lists, lambda x: tx.matches(x, r"\bor\b|/"))
        return F.transform(either, lambda x: F.filter(terms, lambda t: tm.term_in(t, x)))

    return ar.let(pattern, members)


def paren_examples(terms: Column, lines: Column) -> Column:
    """"head (X, Y, Z)" with two or more members: array<struct<head, members>>."""
    pattern = F.concat(F.lit("("), _alternation(terms), F.lit(r")s?(?:\s+\w+)?\s*\(([^)]*)\)"))

    def found(p: Column) -> Column:
        def read(able: Column) -> Column:
            heads = F.flatten(F.transform(able, lambda s: F.regexp_extract_all(s, p, 1)))
            bodies = F.flatten(F.transform(able, lambda s: F.regexp_extract_all(s, p, 2)))
            groups = F.zip_with(heads, bodies, lambda h, b: F.struct(
                h.alias("head"), F.filter(terms, lambda t: (t != h) & tm.term_in(t, b)).alias("members")))
            return F.filter(groups, lambda g: F.size(g["members"]) >= 2)

        return ar.let(F.filter(lines, lambda s: F.contains(s, F.lit("("))), read)

    return ar.let(pattern, found)


def alternatives_of(term: Column, either: Column, examples: Column) -> Column:
    """Lists link both ways; a parenthesis links head to members and members to each other, never back."""
    linked = F.concat(
        F.flatten(F.filter(either, lambda g: F.array_contains(g, term))),
        F.flatten(F.transform(
            F.filter(examples, lambda g: (g["head"] == term) | F.array_contains(g["members"], term)),
            lambda g: g["members"])))
    return F.array_sort(F.array_remove(F.array_distinct(linked), term))


# ------------------------------------------------------------------ DataFrame operators

def posting_lines(postings: DataFrame, text: str = "jd_text", key: str = "jd_id") -> DataFrame:
    return ar.unpack(postings, [key], sectioned_lines(F.col(text)), "line")


def posting_offers(postings: DataFrame, text: str = "jd_text", key: str = "jd_id",
                   vocab: V.Vocabulary = V.DEFAULT) -> DataFrame:
    placed = F.transform(offers(sectioned_lines(F.col(text)), vocab), lambda o, i: F.struct(
        i.alias("pos"), o["term"].alias("term"), o["section"].alias("section"), o["bump"].alias("bump")))
    return ar.unpack(postings, [key], placed, "term")


def keywords_of(text: Column, **options) -> Column:
    """array<struct<term, weight, section, first_pos, rank, alternatives>> of one posting."""
    return ar.let(sectioned_lines(text), lambda lines: keywords_in(lines, **options))


def keywords_in(lines: Column, *, top_n: int | None = 40, alternatives: bool = True,
                vocab: V.Vocabulary = V.DEFAULT) -> Column:
    """The same from the posting's sectioned lines.

    Every intermediate is bound once with `let`: a column merely named in an outer projection would be inlined
    into the lambda that uses it and evaluated per element.
    """
    none = F.array().cast("array<string>")

    def finish(k: Column, alts: Column) -> Column:
        return F.struct(k["term"].alias("term"), k["weight"].alias("weight"), k["section"].alias("section"),
                        k["first_pos"].alias("first_pos"), k["rank"].alias("rank"), alts.alias("alternatives"))

    def linked(top: Column, every: Column, lines: Column) -> Column:
        norm = F.transform(lines, lambda s: tm.searchable(s["line"], vocab))
        return ar.let(norm, lambda n: ar.let(ar.field(every, "term"), lambda terms: ar.let(
            or_lists(terms, n), lambda either: ar.let(paren_examples(terms, n), lambda examples: F.transform(
                top, lambda k: finish(k, alternatives_of(k["term"], either, examples)))))))

    def ranked(every: Column) -> Column:
        top = strongest(every, top_n)
        if not alternatives:
            return F.transform(top, lambda k: finish(k, none))
        plain = F.transform(top, lambda k: finish(k, none))
        return F.when(F.size(every) > 0, ar.let(top, lambda t: linked(t, every, lines))).otherwise(plain)

    return ar.let(weigh(offers(lines, vocab)), ranked)


def with_vocabulary(postings: DataFrame, vocab: V.Vocabulary, vocabulary: DataFrame | None = None, *, key: str = "jd_id",
                    text: str = "jd_text") -> tuple[DataFrame, V.Vocabulary | tm.RowVocabulary]:
    """The rows and the vocabulary to read them with: literals while they are few, else each row's own terms of the table."""
    if vocabulary is None:
        if len(vocab.taxonomy) <= V.MAX_LITERAL_TERMS:
            return postings, vocab
        vocabulary = postings.sparkSession.createDataFrame([(t,) for t in vocab.taxonomy], "term string")
    pieces = F.flatten(F.transform(tx.kept_lines(F.col(text)), lambda s: F.concat(F.array(s["line"]), tx.clauses(s["line"]))))
    own = tm.row_vocabulary(postings, key, pieces, vocabulary, vocab.aliases).withColumnRenamed("terms", "_terms")
    return postings.join(own, key, "left"), tm.RowVocabulary(F.col("_terms"), vocab.aliases)


def keyword_arrays(postings: DataFrame, *, key: str = "jd_id", text: str = "jd_text", vocab: V.Vocabulary = V.DEFAULT,
                   vocabulary: DataFrame | None = None, **options) -> DataFrame:
    """The posting rows plus `keywords`.  `vocabulary` (term) is a taxonomy of any size; `vocab` then gives the aliases."""
    rows, vocab = with_vocabulary(postings, vocab, vocabulary, key=key, text=text)
    return rows.withColumn("keywords", keywords_of(F.col(text), vocab=vocab, **options)).drop("_terms")


def jd_keywords(postings: DataFrame, *, key: str = "jd_id", text: str = "jd_text", vocab: V.Vocabulary = V.DEFAULT,
                vocabulary: DataFrame | None = None, **options) -> DataFrame:
    """Long form: one row per (posting, term)."""
    rows, vocab = with_vocabulary(postings, vocab, vocabulary, key=key, text=text)
    return ar.unpack(rows, [key], keywords_of(F.col(text), vocab=vocab, **options), "term")


def skill_tokens(text: Column, vocab: V.Vocabulary = V.DEFAULT) -> Column:
    """Canonical skills a text shows, sorted."""
    word = r"[A-Za-z][A-Za-z0-9+.#/-]{1,}"

    def known(hay: Column) -> Column:
        phrases = F.filter(tm.phrases_of(vocab), lambda t: F.contains(hay, t))
        folded = F.transform(tx.find_all(hay, "[a-z][a-z0-9+.#/-]{1,}"), lambda t: tm.plural_fold(t, vocab))
        return F.concat(phrases, F.filter(folded, lambda t: tm.in_taxonomy(t, vocab)))

    def shouted(ws: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            pair = F.concat(F.lower(F.get(ws, i - 1)), F.lit(" "), F.lower(w))
            inside = F.coalesce((i > 0) & tm.is_phrase(pair, vocab), F.lit(False))
            return (F.when(tx.matches(w, ACRONYM) & ~inside, tm.canonical(w, vocab))
                    .when(tx.matches(w, EXAM_CODE), F.lower(w)))
        return F.array_compact(F.transform(ws, one))

    return F.array_sort(F.array_distinct(F.concat(
        ar.let(tm.searchable(text, vocab), known), ar.let(tx.find_all(F.coalesce(text, F.lit("")), word), shouted))))


def terms_by_line(postings: DataFrame, terms: str, *, text: str = "jd_text", key: str = "jd_id",
                  vocab: V.Vocabulary = V.DEFAULT) -> DataFrame:
    """(key, line_no, found) for each line naming one or more of the row's own `terms` array."""
    kept = ar.unnest(postings, [key, terms], tx.kept_lines(F.col(text)), "s")
    found = ar.let(tm.searchable(F.col("s.line"), vocab), lambda hay: F.array_sort(
        F.filter(terms, lambda t: tm.term_in(t, hay))))
    return kept.select(key, "s.line_no", found.alias("found")).where(F.size("found") > 0)
