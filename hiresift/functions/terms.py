"""Canonical terms, alias rewriting, and the shared inverted index every match is read from."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import text as tx
from hiresift.session import ship

ALIAS_ESCAPES = re.compile(r"([.+*?()\[\]{}|^$\\/-])")


def literal_pattern(term: str) -> str:
    return ALIAS_ESCAPES.sub(r"\\\1", term)


def alias_pattern(vocab: V.Vocabulary) -> str:
    """Longest alias first.  Aliases are grouped by their first character: most places of a text are then dismissed
    by a look at each group's character, and at one place only aliases of one group can match."""
    groups: dict[str, list[str]] = {}
    for v in sorted(vocab.alias_variants, key=lambda v: (-len(v), v)):
        groups.setdefault(v[0].lower() if v[0].isascii() else v[0], []).append(v[1:])
    each = (literal_pattern(first) + "(?:" + "|".join(map(literal_pattern, rest)) + ")" for first, rest in groups.items())
    return r"(?i)(?<![a-z0-9.])(?:" + "|".join(each) + r")(?![a-z0-9]|\.[a-z0-9])"


# ------------------------------------------------------------------ vocabularies, as literals or as a row's own

@dataclass(frozen=True)
class RowVocabulary:
    """The terms of a large vocabulary that can matter to a row, as an array column beside it (see row_vocabulary)."""

    terms: Column
    aliases: dict

    @property
    def alias_variants(self) -> dict:
        return dict(self.aliases)


def in_taxonomy(c: Column, vocab: V.Vocabulary | RowVocabulary) -> Column:
    return F.array_contains(vocab.terms, c) if isinstance(vocab, RowVocabulary) else tx.among(c, vocab.taxonomy)


def is_known(c: Column, vocab: V.Vocabulary | RowVocabulary) -> Column:
    """A term, or an alias of one."""
    if isinstance(vocab, RowVocabulary):
        return F.array_contains(vocab.terms, c) | F.array_contains(vocab.terms, tx.lookup(vocab.aliases, c, c))
    return tx.among(c, vocab.known)


def is_phrase(c: Column, vocab: V.Vocabulary | RowVocabulary) -> Column:
    """A term of several words."""
    if isinstance(vocab, RowVocabulary):
        return F.contains(c, F.lit(" ")) & F.array_contains(vocab.terms, c)
    return tx.among(c, vocab.multiword)


def phrases_of(vocab: V.Vocabulary | RowVocabulary) -> Column:
    """Terms of several words, longest first."""
    if not isinstance(vocab, RowVocabulary):
        return tx.constant_array(vocab.multiword)
    long = F.filter(vocab.terms, lambda t: F.contains(t, F.lit(" ")))
    return ar.field(F.array_sort(F.transform(long, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), "t")


def canonical(term: Column, vocab: V.Vocabulary = V.DEFAULT) -> Column:
    return ar.let(F.lower(tx.strip(term)), lambda t: tx.lookup(vocab.aliases, t, t))


def alias_normalize(text: Column, vocab: V.Vocabulary = V.DEFAULT) -> Column:
    """Every alias to its canonical spelling in one pass."""
    table = vocab.alias_variants
    return tx.substitute(text, alias_pattern(vocab), lambda m: tx.lookup(table, F.lower(m)))


def searchable(text: Column, vocab: V.Vocabulary = V.DEFAULT) -> Column:
    return alias_normalize(F.lower(F.coalesce(text, F.lit(""))), vocab)


def plural_fold(token: Column, vocab: V.Vocabulary = V.DEFAULT) -> Column:
    stem = F.left(token, F.length(token) - 1)
    folds = (F.length(token) > 3) & token.endswith("s") & in_taxonomy(stem, vocab)
    return F.when(folds, stem).otherwise(token)


def term_in(term: Column, haystack: Column) -> Column:
    """Boundary test for one (term, text) pair, tolerant of a plural 's'.  For pairs already narrowed
    to candidates; whole tables go through `term_index`.  A text without the term is not worth a pattern of its own."""
    plural = F.when(term.endswith("s") | (F.length(term) <= 2), "").otherwise("s?")
    quoted = F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))
    bounded = F.regexp_like(haystack, F.concat(F.lit("(?<![a-z0-9])"), quoted, plural, F.lit("(?![a-z0-9])")))
    return F.contains(haystack, term) & bounded


# ------------------------------------------------------------------ inverted index

RUN = "[a-z0-9]+"
PIECES = re.compile(f"({RUN})")
BATCH_SPANS = 200_000  # spans that a task hands over at once
MAX_KEYS = 200_000  # up to so many spans of a vocabulary go to the tasks, which then hand over no others
MAX_JOINTS = 1000
MARK, STAND_IN = "\x01", "\x02"
PARTS = r"(?s)^([^a-z0-9]*)(.*?)([^a-z0-9]*)$"


@dataclass(frozen=True)
class Shape:
    """What a vocabulary asks of the index: its longest term in words, the longest gap between two words of a
    term, whether any term starts or ends with symbols ("c++", ".net core"), and, where they are few, what stands
    between the words of its terms and the symbols right before or behind one: spans with anything else are in no term."""

    words: int = 1
    gap: int = 0
    symbols: bool = False
    joints: tuple[str, ...] | None = None
    edges: tuple[str, str] | None = None


PLAIN_WORDS = Shape()


def shape_of(vocabulary: DataFrame, term: str = "term") -> Shape:
    """Small aggregates over the vocabulary, so that the index covers every term in it and no more."""
    part = lambda i: F.regexp_extract(F.col(term), PARTS, i)
    inner = F.filter(F.split(part(2), RUN, -1), lambda g: g != "")
    parts = vocabulary.select(
        part(1).alias("lead"), part(3).alias("trail"), F.array_join(inner, MARK).alias("j"), (part(2) != F.col(term)).alias("symbols"),
        F.size(tx.find_all(F.col(term), RUN)).alias("words"), F.array_max(F.transform(inner, F.length)).alias("gap"))
    facts = parts.agg(F.max("words").alias("words"), F.max("gap").alias("gap"), F.bool_or("symbols").alias("symbols"),
                      F.bool_or((F.col("lead") != "") & (tx.strip(F.col("lead")) == "") | (F.col("trail") != "") & (tx.strip(F.col("trail")) == "")).alias("blank")).first()
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("x")) for k, c in (("joint", F.col("j")), ("lead", F.right("lead", F.lit(1))), ("trail", F.left("trail", F.lit(1))))])
    few = {}
    for kind, x in parts.select(F.explode(listed).alias("l")).select("l.*").where("x <> ''").distinct().limit(MAX_JOINTS + 1).collect():
        few.setdefault(kind, []).append(x)
    if sum(map(len, few.values())) > MAX_JOINTS:
        return Shape(facts.words or 1, facts.gap or 0, bool(facts.symbols))
    # a term that begins or ends with nothing but blanks is met wherever a blank stands, the ends of a text among them
    edges = None if facts.blank else tuple("".join(sorted(few.get(k, ()))) for k in ("lead", "trail"))
    return Shape(facts.words or 1, facts.gap or 0, bool(facts.symbols), tuple(sorted(few.get("joint", ()))), edges)


def spans_of(shape: Shape) -> Callable[[str], set[str]]:
    """A reader of the distinct word spans of a text.

    Where terms have symbols at an end, a span beside such a symbol comes a second time with what a boundary test needs:
    the symbols before and after and what it runs into, joined by a mark, and one mark more where it opens the text.
    """
    sizes = range(2, shape.words + 1)
    known = None if shape.joints is None else {n: {tuple(j.split(MARK)) for j in shape.joints if j.count(MARK) == n - 2} for n in sizes}
    lead, trail = map(set, shape.edges or ("", ""))

    def starts(inner: list[str], n: int) -> list[int]:
        between = enumerate(zip(*(inner[k:] for k in range(n - 1))))
        if known is None:
            return [i for i, gaps in between if max(map(len, gaps)) <= shape.gap]
        wanted = known[n]
        return [i for i, gaps in between if gaps in wanted] if wanted else []

    def read(text: str) -> set[str]:
        pieces = PIECES.split(text.replace(MARK, STAND_IN))
        gaps, runs = pieces[::2], pieces[1::2]
        inner, found = gaps[1:-1], set(runs)
        at = {n: starts(inner, n) for n in sizes}
        for n, places in at.items():
            found.update(["".join(pieces[2 * i + 1:2 * (i + n)]) for i in places])
        if shape.symbols:
            before = [shape.edges is None or g[-1:] in lead for g in gaps]
            after = [shape.edges is None or g[:1] in trail for g in gaps]
            if any(before) or any(after):
                for n, places in ((1, range(len(runs))), *at.items()):
                    for i in places:
                        if before[i] or after[i + n]:
                            found.add(_in_context("".join(pieces[2 * i + 1:2 * (i + n)]), i, n, gaps, runs))
        return found

    return read


def known_spans(keys: list[tuple[str, str, str]]) -> Callable[[str], set[str]]:
    """The same reader for a vocabulary whose spans are known, each with the symbol right before and behind it in a term
    ("" where it ends in words): it gives those that the text has and no others."""
    plain: set[str] = set()
    edged: dict[str, set[tuple[str, str]]] = {}
    sizes: dict[str, set[int]] = {}  # by first word, where a span has several or stands beside symbols
    for span, lead, trail in keys:
        if lead or trail:
            # blanks are told apart by the test that follows, which sees gaps of nothing but blanks as one
            edged.setdefault(span, set()).add((lead.strip(), trail.strip()))
        else:
            plain.add(span)
        runs = PIECES.findall(span)
        if len(runs) > 1 or lead or trail:
            sizes.setdefault(runs[0], set()).add(len(runs))

    def read(text: str) -> set[str]:
        pieces = PIECES.split(text.replace(MARK, STAND_IN))
        gaps, runs = pieces[::2], pieces[1::2]
        found = plain.intersection(runs)
        for i in [i for i, run in enumerate(runs) if run in sizes]:
            for n in sizes[runs[i]]:
                if i + n <= len(runs):
                    span = "".join(pieces[2 * i + 1:2 * (i + n)])
                    if span in plain:
                        found.add(span)
                    for lead, trail in edged.get(span, ()):
                        if gaps[i].endswith(lead) and gaps[i + n].startswith(trail):
                            found.add(_in_context(span, i, n, gaps, runs))
        return found

    return read


def _in_context(span: str, i: int, n: int, gaps: list[str], runs: list[str]) -> str:
    """A span of n words from the i-th, the symbols before and after it and whether it runs into no word, a plural "s" or
    another ("x"): one span for all places that a boundary test cannot tell apart."""
    into = runs[i + n] if i + n < len(runs) else ""
    return MARK.join((span, gaps[i], gaps[i + n], into if into in ("", "s") else "x")) + (MARK if i == 0 else "")


def spans(docs: DataFrame, key: list[str], haystack: Column, reader: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
    """(key..., span): the distinct word spans of each row's text, one pass over its words in Arrow batches."""
    texts = docs.select(*key, haystack.alias("span"))
    ship(texts.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(len(key))):
                mine = read(text.as_py()) if text.is_valid else ()
                rows += [row] * len(mine)
                found.extend(mine)
                if len(found) >= BATCH_SPANS or row + 1 == batch.num_rows:
                    taken = pa.array(rows, pa.int32())
                    columns = [*(c.take(taken) for c in batch.columns[:-1]), pa.array(found, batch.schema.field(len(key)).type)]
                    yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                    rows, found = [], []

    return texts.mapInArrow(apply, texts.schema)


def with_skeleton(vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """Split each term into leading symbols, word span, trailing symbols; add the plural spelling as a key."""
    part = lambda i: F.regexp_extract(F.col(term), PARTS, i)
    base = vocabulary.select(term).distinct().select(
        F.col(term).alias("term"), part(1).alias("lead"), part(2).alias("core"), part(3).alias("trail")).where(F.col("core") != "")
    foldable = ~F.col("term").endswith("s") & (F.length("term") > 2)
    keys = F.when(foldable & (F.col("trail") == ""), F.array("core", F.concat("core", F.lit("s")))).otherwise(F.array("core"))
    return base.withColumn("foldable", foldable).withColumn("span", F.explode(keys))


def term_index(docs: DataFrame, key: list[str], haystack: Column, vocabulary: DataFrame,
               shape: Shape | None = None) -> DataFrame:
    """(key..., term) for every vocabulary term a document contains.

    A hash equi-join on word spans, then an exact symbol check on the few surviving rows.  The text itself
    never enters the shuffle.  Which side is broadcast is left to the optimizer's size estimates and to AQE's
    measured sizes, so a vocabulary that has outgrown memory falls back to a shuffled join.  The spans of a smaller one
    are sent along with the texts' tasks, which drop the others before they meet the join.
    """
    skeleton = with_skeleton(vocabulary).withColumn("edged", (F.col("lead") != "") | (F.col("trail") != ""))
    keys = [tuple(r) for r in skeleton.select("span", F.right("lead", F.lit(1)), F.left("trail", F.lit(1))).distinct().limit(MAX_KEYS + 1).collect()]
    if len(keys) <= MAX_KEYS:
        symbols, reader = any(lead or trail for _, lead, trail in keys), lambda: known_spans(keys)
    else:
        shape = shape or shape_of(vocabulary)
        symbols, reader = shape.symbols, lambda: spans_of(shape)
    rows = spans(docs, key, haystack, reader)
    if symbols:
        # met by the word span alone; a term with symbols only where they may stand, which is read from the rows that met it
        rows = rows.withColumnRenamed("span", "_s").withColumns({"span": F.substring_index("_s", MARK, 1), "edged": F.contains("_s", F.lit(MARK))})
        met = rows.join(skeleton, ["span", "edged"])
        around = met.withColumn("_a", F.split("_s", MARK, -1)).withColumns({n: F.get("_a", i) for i, n in ((1, "before"), (2, "after"), (3, "next"))})
        opens = F.size("_a") == 5
        # gaps of nothing but blanks are one blank, and a blank ends what a word could run into
        folded = lambda gap: F.when(tx.strip(F.col(gap)) == "", F.lit(" ")).otherwise(F.col(gap))
        around = around.withColumns({"before": folded("before"), "after": folded("after")})
        next_word = F.when(F.trim(F.left("after", F.lit(1))) == "", "").otherwise(F.col("next"))
        clean_lead = (F.col("lead") == "") | (
            F.endswith("before", "lead") & ((F.length("before") > F.length("lead")) | opens))
        clean_trail = (F.col("trail") == "") | (
            F.startswith("after", "trail")
            & ((F.col("after") != F.col("trail")) | (next_word == "") | (F.col("foldable") & (next_word == "s"))))
        hit = around.where(~F.col("edged") | clean_lead & clean_trail)
    else:
        hit = rows.join(skeleton.select("span", "term"), "span")
    # one shuffle by document: the distinct here, and any per-document aggregate or window after it, reuse it
    return hit.select(*key, "term").repartition(*key).distinct()


# ------------------------------------------------------------------ phrase index

REST = 3  # characters after a phrase's first word that its key holds


def _key(kind: str, c: Column) -> Column:
    return F.xxhash64(F.lit(kind), c)


def vocabulary_keys(vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """(probe, term): a term's own key, and of a phrase its first word with the characters behind it."""
    space = F.instr(F.col(term), " ")
    phrase = _key("p", F.left(F.col(term), space + REST))
    return vocabulary.select(F.col(term).alias("term")).distinct().select(
        F.explode(F.when(F.instr("term", " ") > 0, F.array(_key("e", F.col("term")), phrase)).otherwise(F.array(_key("e", F.col("term"))))).alias("probe"), "term")


def phrase_probes(hay: Column) -> Column:
    """Keys of every phrase that a text could contain: a phrase may begin inside a word and end inside one, so each
    end of a word before a blank is tried with the next characters."""
    def pairs(words: Column) -> Column:
        def at(word: Column, i: Column) -> Column:
            rest = F.left(F.array_join(F.slice(words, i + 2, REST + 1), " "), F.lit(REST))
            ends = F.when((F.length(word) > 0) & (i + 1 < F.size(words)), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word))), lambda n: F.right(word, n)))
            return ar.let(rest, lambda r: F.flatten(F.transform(ends, lambda e: F.array(*[_key("p", F.concat(e, F.lit(" "), F.left(r, F.lit(n)))) for n in range(1, REST + 1)]))))
        return F.flatten(F.array_compact(F.transform(words, at)))

    return F.array_distinct(ar.let(F.split(hay, " ", -1), pairs))


def phrase_index(docs: DataFrame, key: list[str], haystack: Column, vocabulary: DataFrame) -> DataFrame:
    """(key..., term) for every phrase of the vocabulary that stands anywhere in a text, within words too.

    The vocabulary is a table of any size: texts and phrases meet as hashed keys, and what meets is held against the
    text by id.  Terms of one word have no blank to meet at and are not found here.  Null texts hold nothing.
    """
    hay = docs.select(*key, F.coalesce(haystack, F.lit("")).alias("_hay"))
    probes = ar.unnest(hay, key, phrase_probes(F.col("_hay")), "probe")
    may = probes.join(vocabulary_keys(vocabulary), "probe").where(F.contains("term", F.lit(" "))).groupBy(*key).agg(F.collect_set("term").alias("_may"))
    return ar.unnest(hay.join(may, key), key, F.filter("_may", lambda t: F.contains(F.col("_hay"), t)), "term").distinct()


def row_vocabulary(docs: DataFrame, key: str, pieces: Column, vocabulary: DataFrame, aliases: dict) -> DataFrame:
    """(key, terms): the terms of a vocabulary table that can matter to each row, a superset of those it shows.

    `pieces` is the array of texts (clauses, lines) that will be read.  A row's terms are bounded by its own text, so
    with them the literal operators give what they would give with the whole vocabulary.
    """
    small = RowVocabulary(F.array().cast("array<string>"), aliases)

    def probes(piece: Column) -> Column:
        def tokens(toks: Column) -> Column:
            def one(tok: Column, i: Column) -> Column:
                low = F.lower(tx.rstrip(tok, tx.TOKEN_TAIL))
                pair = F.concat(F.lower(F.get(toks, i - 1)), F.lit(" "))
                def of(x: Column) -> Column:
                    stem = F.left(x, F.length(x) - 1)
                    names = [x, stem, tx.lookup(aliases, x, x), tx.lookup(aliases, stem, stem)]
                    return F.array(*[_key("e", n) for n in names], *[_key("e", F.concat(pair, n)) for n in (x, stem)])
                return ar.let(low, of)
            return F.flatten(F.transform(toks, one))
        raw = ar.let(F.concat(tx.find_all(piece, tx.TOKEN), F.array(F.lit(""))), tokens)
        normal = ar.let(searchable(piece, small), lambda hay: F.concat(phrase_probes(hay), ar.let(F.concat(tx.find_all(hay, tx.TOKEN), F.array(F.lit(""))), tokens)))
        return F.concat(raw, normal)

    rows = ar.unnest(docs, [key], F.array_distinct(F.flatten(F.transform(pieces, probes))), "probe")
    held = rows.join(vocabulary_keys(vocabulary), "probe").groupBy(key).agg(F.collect_set("term").alias("terms"))
    return docs.select(key).distinct().join(held, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
