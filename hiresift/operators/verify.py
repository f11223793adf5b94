"""Rewrite checks: set algebra on text pairs, one row per rewrite, no shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import terms as tm
from hiresift.functions import text as tx
from hiresift.operators import extract as ex

MIN_RATIO, MAX_RATIO = 0.4, 3.0
QUOTE_RATIO = 0.75


def kept_numbers(text: Column) -> Column:
    return F.array_distinct(tx.numbers(tx.without_placeholders(text)))


def named_skills(text: Column, vocab: V.Vocabulary = V.DEFAULT) -> Column:
    return F.array_except(ex.skill_tokens(text, vocab), tx.constant_array(V.NOT_SKILL_IN_REWRITE))


def rewrite_problem(original: Column, rewrite: Column, allowed: Column | None = None,
                    vocab: V.Vocabulary = V.DEFAULT) -> Column:
    """First reason a rewrite is refused, null when it passes.  `allowed` lists the terms it may introduce."""
    before, after = tx.strip(original), tx.strip(F.coalesce(rewrite, F.lit("")))
    ratio = F.length(after) / F.greatest(F.lit(1), F.length(before))
    some = lambda a: F.size(a) > 0
    numbers_checked = lambda old, new: F.when(some(F.array_except(old, new)), "lost number").when(some(F.array_except(new, old)), "added number")

    def skills_checked(old: Column, new: Column) -> Column:
        chain = F.when(some(F.array_except(old, new)), "lost skill")
        if allowed is None:
            return chain
        return chain.when(some(F.array_except(F.array_except(new, old), F.transform(allowed, lambda t: tm.canonical(t, vocab)))), "introduced skill")

    pair = lambda f, body: ar.let(f(original), lambda old: ar.let(f(rewrite), lambda new: body(old, new)))
    basic = (F.when(after == "", "empty rewrite").when(F.lower(after) == F.lower(before), "no change")
             .when(ratio < MIN_RATIO, "truncates the bullet").when(ratio > MAX_RATIO, "balloons the bullet"))
    return F.coalesce(basic, pair(kept_numbers, numbers_checked), pair(lambda t: named_skills(t, vocab), skills_checked))


def tag_claims(tags: Column, term: Column) -> Column:
    """A term is claimed when it is a tag or part of a tag's name."""
    c = tm.canonical(term)
    return ar.let(F.transform(tags, lambda x: tm.canonical(x)), lambda ts: F.array_contains(ts, c) | F.exists(ts, lambda t: tm.term_in(c, t)))


def truthful_problem(original: Column, current: Column, rewrite: Column, tags: Column, jd_terms: Column,
                     extra: Column | None = None) -> Column:
    """Rewrite check, then: no covered posting term lost, no posting term named that the tags do not claim."""
    allowed = F.transform(tags, lambda x: tm.canonical(x))
    if extra is not None:
        allowed = F.concat(allowed, extra)
    covers = lambda text: ar.let(tm.searchable(text), lambda hay: F.filter(jd_terms, lambda t: tm.term_in(t, hay)))

    def covered(now: Column) -> Column:
        return ar.let(covers(current), lambda was: F.when(F.size(F.array_except(was, now)) > 0, "loses a covered term"))

    def claimed(now: Column) -> Column:
        fresh = ar.let(covers(original), lambda first: F.array_except(now, first))
        return F.when(F.exists(fresh, lambda t: ~tag_claims(tags, t)), "names an unclaimed term")

    return F.coalesce(rewrite_problem(original, rewrite, allowed),
                      ar.let(covers(rewrite), lambda now: F.coalesce(covered(now), claimed(now))))


def content_words(text: Column) -> Column:
    return F.array_distinct(tx.find_all(F.replace(tm.searchable(text), F.lit("-"), F.lit(" ")), "[a-z]{3,}"))


def target_scores(tags: Column, text: Column, missing: Column) -> Column:
    """array<struct<term, score>> of the missing terms this bullet may already show, best first, scores > 0."""
    def rank(ts: Column, tag_words: Column, text_words: Column) -> Column:
        def one(term: Column, i: Column) -> Column:
            c = tm.canonical(term)
            score = ar.let(content_words(c), lambda ws: F.when(F.array_contains(ts, c), 100).otherwise(
                F.when(F.arrays_overlap(ws, tag_words), 2).otherwise(0) + F.when(F.arrays_overlap(ws, text_words), 1).otherwise(0)))
            return F.struct((-score).alias("order"), i.alias("i"), term.alias("term"), score.alias("score"))
        return F.array_sort(F.filter(F.transform(missing, one), lambda s: s["score"] > 0))

    tagged = F.transform(tags, lambda x: tm.canonical(x))
    ranked = ar.let(tagged, lambda ts: ar.let(F.array_distinct(F.flatten(F.transform(ts, content_words))), lambda tw: ar.let(
        content_words(text), lambda xw: rank(ts, tw, xw))))
    return F.transform(ranked, lambda s: F.struct(s["term"].alias("term"), s["score"].alias("score")))


def plausible_targets(bullets: DataFrame, keys: list[str], *, cap: int = 4) -> DataFrame:
    """(keys..., rank, term, score) from rows with `skills`, `text`, `missing`."""
    ranked = F.transform(F.slice(target_scores(F.col("skills"), F.col("text"), F.col("missing")), 1, cap), lambda s, i: F.struct(
        (i + 1).alias("rank"), s["term"].alias("term"), s["score"].alias("score")))
    return ar.unpack(bullets, keys, ranked, "term")


def match_quoted_bullet(quotes: DataFrame, bullets: DataFrame, key: list[str], quote_id: str = "quote_id") -> DataFrame:
    """(key, quote_id, bullet_no, ratio): containment first, else best spelling ratio >= 0.75.

    Quotes meet only the bullets of their own document, and the choice is a max-style aggregate.
    """
    q = quotes.withColumn("_q", F.lower(tx.squeeze(F.col("quote")))).where("_q <> ''")
    b = bullets.withColumn("_t", F.lower(tx.squeeze(F.col("text"))))
    rows = q.select(*key, quote_id, "_q").join(b.select(*key, "bullet_no", "_t"), key)
    inside = F.contains(F.col("_t"), F.col("_q")) | F.contains(F.col("_q"), F.col("_t"))
    head = F.left(F.col("_t"), F.length("_q") + 60)
    ratio = 1 - F.levenshtein("_q", head) / F.greatest(F.length("_q"), F.length(head)).cast("double")
    scored = rows.withColumn("ratio", F.when(inside, 2.0).otherwise(ratio)).where(F.col("ratio") >= QUOTE_RATIO)
    return scored.groupBy(*key, quote_id).agg(
        F.max_by("bullet_no", F.struct("ratio", -F.col("bullet_no"))).alias("bullet_no"), F.max("ratio").alias("ratio"))


def apply_accepted(bullets: DataFrame, proposals: DataFrame, ids: list[str], *, auto_accept: bool = False) -> DataFrame:
    """Final text per bullet: an accepted rewrite, else the original.  Auto-accept never covers manager rewrites."""
    yes = F.coalesce("accepted", F.lit(False))
    if auto_accept:
        yes = yes | (F.col("accepted").isNull() & (F.col("source") != "manager-rewrite"))
    taken = proposals.where(yes).groupBy(*ids).agg(F.min_by("rewrite", "proposal_id").alias("_r"))
    return bullets.join(taken, ids, "left").withColumn("final_text", F.coalesce("_r", "text")).withColumn(
        "rewritten", F.col("_r").isNotNull()).drop("_r")
