"""Evidence selection under a line budget.

A bank and a posting meet as one row per pair: an array of bullets (role, cost, covered terms) and an array of
weighted terms.  Greedy selection is arithmetic on that row, so all pairs advance in parallel with no iterative
jobs, no growing lineage and nothing to checkpoint.  Both arrays are inputs of one person and one posting; no
group is collected to build them beyond what the nested bank row already holds.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hiresift import vocab as V
from hiresift.functions import arrays as ar
from hiresift.functions import dates as dt
from hiresift.functions import terms as tm
from hiresift.functions import text as tx
from hiresift.session import shuffled, ship

MAX_LINES, MAX_CURRENT, MAX_OTHER = 26, 5, 3
MIN_CURRENT, MIN_OTHER = 4, 2
SKILLS_SHOWN = 15

BULLET = ("struct<bullet_id:int,role_rank:int,role_no:int,bullet_no:int,is_current:boolean,cost:int,n_tags:int,"
          "n_chars:int,covers:array<string>>")


# ------------------------------------------------------------------ bullets and what they cover

def reviewed_only(bullets: DataFrame) -> DataFrame:
    return bullets.where("reviewed")


def reviewed_counts(bullets: DataFrame, key: str = "candidate_id") -> DataFrame:
    return bullets.groupBy(key).agg(F.count_if("reviewed").alias("kept"), F.count_if(~F.col("reviewed")).alias("dropped"))


def jd_weight_map(keywords: DataFrame) -> DataFrame:
    """(jd_id, term, weight, representative): larger weight per canonical term, first spelling kept."""
    return keywords.groupBy("jd_id", tm.canonical(F.col("term")).alias("canonical")).agg(
        F.max("weight").alias("weight"), F.min_by("term", "rank").alias("representative")).withColumnRenamed("canonical", "term")


def bullet_terms(bullets: DataFrame, vocabulary: DataFrame, key: str = "candidate_id", shape: tm.Shape | None = None) -> DataFrame:
    """(key, role_no, bullet_no, term): vocabulary terms a bullet shows in its text or carries as a tag."""
    ids = [key, "role_no", "bullet_no"]
    by_text = tm.term_index(bullets, ids, tm.searchable(F.col("text")), vocabulary, shape)
    tags = ar.unnest(bullets, ids, F.transform("skills", lambda x: tm.canonical(x)), "term")
    by_tag = tags.join(vocabulary.select("term").distinct(), "term", "left_semi").select(*ids, "term")
    return by_text.unionByName(by_tag).distinct()


def bank_rows(bullets: DataFrame, covered: DataFrame, key: str = "candidate_id", *, tagged: bool = False) -> DataFrame:
    """(key, bullets array): the bank of one person as the fold reads it, in role order.

    With `tagged` also `tags`, the canonical skills of each of these bullets; bullets of the same number share theirs.
    """
    ids = [key, "role_no", "bullet_no"]
    terms = covered.groupBy(*ids).agg(F.sort_array(F.collect_set("term")).alias("covers"))
    rows = bullets.join(terms, ids, "left").select(key, F.struct(
        F.col("role_rank"), F.col("bullet_no"), F.col("role_no"), F.col("is_current"), tx.lines_cost(F.col("text")).alias("cost"),
        F.size("skills").alias("n_tags"), F.length("text").alias("n_chars"),
        F.coalesce("covers", F.array().cast("array<string>")).alias("covers"), *([F.col("skills")] if tagged else [])).alias("b"))
    ordered = lambda bs: F.transform(bs, lambda b, i: F.struct(
        i.alias("bullet_id"), b["role_rank"].alias("role_rank"), b["role_no"].alias("role_no"), b["bullet_no"].alias("bullet_no"),
        b["is_current"].alias("is_current"), b["cost"].alias("cost"), b["n_tags"].alias("n_tags"), b["n_chars"].alias("n_chars"),
        b["covers"].alias("covers"))).cast(f"array<{BULLET}>").alias("bullets")
    if not tagged:
        return rows.groupBy(key).agg(ordered(F.sort_array(F.collect_list("b"))))
    number = lambda b: F.struct(b["role_no"], b["bullet_no"])
    own = lambda b: F.filter(F.transform(F.coalesce(b["skills"], F.array().cast("array<string>")), lambda x: tm.canonical(x)), lambda x: x.isNotNull())
    shared = F.transform("_b", lambda b: F.flatten(F.transform(F.filter("_b", lambda other: number(other) == number(b)), own)))
    repeats = ar.let(F.transform("_b", number), lambda ns: F.size(F.array_distinct(ns)) < F.size(ns))
    gathered = rows.groupBy(key).agg(F.sort_array(F.collect_list("b")).alias("_b"))
    return gathered.select(key, ordered(F.col("_b")), F.when(repeats, shared).otherwise(F.transform("_b", own)).alias("tags"))


def with_skills(banks: DataFrame, extras: DataFrame, key: str = "candidate_id", *, how: str = "left") -> DataFrame:
    """Tagged bank rows with `extra`, the skills that a person vouches for beside the bullets, and `names`, how each term
    of the bank is shown.  `extras` is (key, term); with `how` full, persons with extras and no bullets come too."""
    none = F.array().cast("array<string>")
    rows = banks.join(shuffled(extras.groupBy(key).agg(F.collect_set("term").alias("extra"))), key, how).select(
        key, F.coalesce("bullets", F.array().cast(f"array<{BULLET}>")).alias("bullets"), F.coalesce("tags", F.array().cast("array<array<string>>")).alias("tags"),
        F.coalesce("extra", none).alias("extra"))
    every = F.array_distinct(F.concat(F.flatten("tags"), "extra", F.flatten(ar.field(F.col("bullets"), "covers"))))
    return rows.withColumn("names", ar.let(every, lambda ts: F.map_from_arrays(ts, F.transform(ts, lambda t: tx.display_case(t)))))


def with_asked(model: DataFrame, weights: DataFrame) -> DataFrame:
    """The postings with `asked`: their terms by weight, then name."""
    order = F.struct((-F.col("weight")).alias("w"), F.col("term").alias("term"))
    ranked = weights.where("weight IS NOT NULL").groupBy("jd_id").agg(ar.field(F.sort_array(F.collect_list(order)), "term").alias("asked"))
    return model.join(ranked, "jd_id", "left")


def bullet_covers(covered: DataFrame, weights: DataFrame, pairs: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, jd_id, role_no, bullet_no, term, weight) for the posting terms each bullet covers.

    A pair takes its posting's terms to its bank's and both lists are compared there: what moves is one row per pair,
    not one per covered term.  The lists are those of one posting and one person.
    """
    asked = weights.groupBy("jd_id").agg(F.collect_list(F.struct("term", "weight")).alias("_asked"))
    held = covered.groupBy(key).agg(F.collect_list(F.struct("role_no", "bullet_no", "term")).alias("_held"))
    rows = pairs.select(key, "jd_id").join(asked, "jd_id").join(shuffled(held), key)

    def met(both: Column) -> Column:
        wanted = F.filter("_asked", lambda w: F.array_contains(both, w["term"]))
        mine = F.filter("_held", lambda h: F.array_contains(both, h["term"]))
        return ar.let(wanted, lambda ws: F.flatten(F.transform(mine, lambda h: F.transform(
            F.filter(ws, lambda w: w["term"] == h["term"]), lambda w: F.struct(
                h["role_no"].alias("role_no"), h["bullet_no"].alias("bullet_no"), h["term"].alias("term"), w["weight"].alias("weight"))))))

    both = F.array_intersect(ar.field(F.col("_asked"), "term"), ar.field(F.col("_held"), "term"))
    return ar.unpack(rows, [key, "jd_id"], ar.let(both, met), "term")


def marginal_gain(covers: DataFrame, bullets: DataFrame, counts: DataFrame | None = None, key: str = "candidate_id") -> DataFrame:
    """Saturated value of each bullet per estimated line, given how often each term is already covered (term, n int)."""
    ids = [key, "jd_id", "role_no", "bullet_no"]
    if counts is None:
        rows = covers.withColumn("n", F.lit(0))
    else:
        # by pair, so that the sum by bullet after it needs no shuffle of its own; counts that repeat add up
        by_pair = counts.groupBy(key, "jd_id").agg(F.collect_list(F.struct("term", "n")).alias("_n"))
        none = F.array().cast("array<struct<term:string,n:int>>")
        seen = F.aggregate(F.filter(F.coalesce("_n", none), lambda c: c["term"] == F.col("term")), F.lit(0), lambda n, c: n + c["n"])
        rows = covers.join(by_pair, [key, "jd_id"], "left").withColumn("n", seen)
    factor = F.coalesce(F.get(F.array(*[F.lit(s) for s in V.SATURATION]), F.col("n")), F.lit(0.0))
    value = rows.groupBy(*ids).agg(F.sum((F.col("weight") * factor.cast("decimal(3,1)"))).alias("value"))
    costs = bullets.select(key, "role_no", "bullet_no", tx.lines_cost(F.col("text")).alias("cost"))
    return value.join(costs, [key, "role_no", "bullet_no"]).select(
        *ids, "cost", F.col("value").cast("double").alias("value"), F.bround(F.col("value").cast("double") / F.col("cost"), 4).alias("gain_per_line"))


# ------------------------------------------------------------------ greedy selection, one row per pair

SELECTION = "struct<minimums:array<int>,picked:array<int>,lines:int,counts:map<string,int>>"
MOVES = "array<struct<move:string,out_id:int,in_id:int,role_rank:int,gain:double>>"
TENTHS = tuple(round(s * 10) for s in V.SATURATION)  # weights are hundredths: values are whole numbers
STEPS = tuple(after - now for now, after in zip(TENTHS, (*TENTHS[1:], 0), strict=True))  # what one more bullet takes off a term's worth


@dataclass(slots=True)
class Bank:
    """What a choice reads of one bank, made once for all its pairs: terms are numbered in the order they appear."""

    roles: list[int]
    current: list[bool]
    cost: list[int]
    names: list[str]
    own: list[list[int]]
    holders: list[list[int]]
    groups: list[tuple[list[int], int]]
    place: list[int]

    @classmethod
    def of(cls, roles: list[int], current: list[bool], cost: list[int], tags: list[int], chars: list[int], covers: list[list[str]]) -> Bank:
        number: dict[str, int] = {}
        own = [[number.setdefault(t, len(number)) for t in terms] for terms in covers]
        holders: list[list[int]] = [[] for _ in number]
        for b, terms in enumerate(own):
            for t in terms:
                holders[t].append(b)
        members = {role: [b for b in range(len(roles)) if roles[b] == role] for role in sorted(set(roles))}
        groups = [(mine, MIN_CURRENT if any(current[b] for b in mine) else MIN_OTHER) for mine in members.values()]
        place = [0] * len(roles)
        for i, b in enumerate(sorted(range(len(roles)), key=lambda b: (tags[b], -chars[b], -b))):
            place[b] = i
        return cls(roles, current, cost, list(number), own, holders, groups, place)


def chosen_from(bank: Bank, weight: list[int | None], max_lines: int, max_current: int, max_other: int) -> tuple[list[int], list[int], int, dict[int, int]]:
    """(first picks of the roles, all picks, lines, how often each term is covered) for one pair; terms by their number.

    `weight` has the posting's weight of each of the bank's terms, None for those it does not ask for.  Bullets stand in
    role order.  Each role's minimum comes first: its largest value, then most tags, then shortest text, then first in
    the bank; a role's first bullet is kept even over budget.  Then the best value per line anywhere, within role caps
    and the budget, until nothing gains.  A pick changes the value of bullets that share one of its terms and of no
    others, so only those are valued again.
    """
    roles, cost, own, holders, place = bank.roles, bank.cost, bank.own, bank.holders, bank.place
    n = len(roles)
    value = [TENTHS[0] * sum([w for t in terms if (w := weight[t]) is not None]) for terms in own]
    counts: dict[int, int] = {}
    gone, taken, picked, lines = [False] * n, dict.fromkeys(roles, 0), [], 0

    def take(b: int) -> None:
        nonlocal lines
        gone[b] = True
        taken[roles[b]] += 1
        picked.append(b)
        lines += cost[b]
        for t in own[b]:
            w = weight[t]
            if w is not None:
                seen = counts.get(t, 0)
                counts[t] = seen + 1
                if seen < len(STEPS):
                    change = w * STEPS[seen]
                    for other in holders[t]:
                        value[other] += change

    for mine, least in bank.groups:
        for slot in range(least):
            left = [b for b in mine if not gone[b]]
            pool = [b for b in left if lines + cost[b] <= max_lines] or (left if slot == 0 else left[:0])
            if not pool:
                break
            best = pool[0]
            for b in pool:
                if value[b] > value[best] or (value[b] == value[best] and place[b] > place[best]):
                    best = b
            take(best)
    first = list(picked)
    free = [b for b in range(n) if not gone[b]]
    while True:
        # lines and roles only fill up: a bullet that no longer fits never does again
        free = [b for b in free if not gone[b] and lines + cost[b] <= max_lines and taken[roles[b]] < (max_current if bank.current[b] else max_other)]
        best, most = -1, (0.0, 0)
        for b in free:
            if value[b] > 0:
                rate = (value[b] / cost[b], value[b])
                if best < 0 or rate > most:
                    best, most = b, rate
        if best < 0:
            return first, picked, lines, counts
        take(best)


def choose(roles: list[int], current: list[bool], cost: list[int], tags: list[int], chars: list[int], covers: list[list[str]],
           weights: dict[str, int], max_lines: int, max_current: int, max_other: int) -> tuple[list[int], list[int], int, dict[str, int]]:
    """`chosen_from` for a single pair, its terms by name."""
    bank = Bank.of(roles, current, cost, tags, chars, covers)
    first, picked, lines, counts = chosen_from(bank, [weights.get(t) for t in bank.names], max_lines, max_current, max_other)
    return first, picked, lines, {bank.names[t]: c for t, c in counts.items()}


def moves_from(bank: Bank, weight: list[int | None], picked: list[int], lines: int, max_lines: int, max_current: int, max_other: int) -> list[tuple[int, int, int]]:
    """(bullet out or -1 for an addition, bullet in, gain in hundredths) of every same-role swap and allowed addition;
    `weight` as in `chosen_from`.

    With the number of picks that cover each term, what a bullet adds is the weight of its uncovered terms and what
    one takes away that of terms only it covers, less what the two share: a move costs one pass over its terms.
    """
    roles, cost, own = bank.roles, bank.cost, bank.own
    counts: dict[int, int] = {}
    for b in picked:
        for t in own[b]:
            if weight[t] is not None:
                counts[t] = counts.get(t, 0) + 1
    by_role: dict[int, list[tuple[int, int, dict[int, int]]]] = {}
    for c in sorted(picked):
        only = {t: weight[t] for t in own[c] if counts.get(t) == 1}
        by_role.setdefault(roles[c], []).append((c, lines - cost[c], only, sum(only.values())))
    out, chosen = [], set(picked)
    for b in range(len(roles)):
        same = by_role.get(roles[b])
        if same is None or b in chosen:
            continue
        mine, more = own[b], cost[b]
        gain = sum([w for t in mine if t not in counts and (w := weight[t]) is not None])
        for c, left, only, loss in same:
            if left + more <= max_lines:
                out.append((c, b, gain + sum([only[t] for t in mine if t in only]) - loss if only else gain))
        if len(same) < (max_current if bank.current[b] else max_other) and lines + more <= max_lines:
            out.append((-1, b, gain))
    return out


def moves_of(roles: list[int], current: list[bool], cost: list[int], covers: list[list[str]], weights: dict[str, int], picked: list[int],
             lines: int, max_lines: int, max_current: int, max_other: int) -> list[tuple]:
    """`moves_from` for a single pair, its terms by name: (move, bullet out or -1, bullet in, role, gain)."""
    bank = Bank.of(roles, current, cost, [0] * len(roles), [0] * len(roles), covers)
    found = moves_from(bank, [weights.get(t) for t in bank.names], picked, lines, max_lines, max_current, max_other)
    return [("add" if c < 0 else "swap", c, b, roles[b], gain / 100.0) for c, b, gain in found]


def _coded(keywords: Column, bullets: Column, fields: tuple[str, ...]) -> list[Column]:
    """The arrays that a pair's arithmetic reads, in order: bullet fields, terms, weights in hundredths."""
    return [*(ar.field(bullets, f) for f in fields), ar.field(keywords, "term"), F.transform(keywords, lambda k: (k["weight"] * 100).cast("int"))]


def weight_map(keywords: Column) -> Column:
    """Keyword array -> map<term, hundredths>."""
    return F.map_from_entries(F.transform(ar.distinct_by(keywords, lambda k: k["term"]), lambda k: F.struct(k["term"], (k["weight"] * 100).cast("int"))))


def _spans(array: pa.Array) -> list[int]:
    """Where each list of the array begins and ends in `array.flatten()`; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
    return [0, *np.cumsum(sizes).tolist()]


def _asked_weights(terms: pa.Array, weights: pa.Array) -> Callable[[int, int, Bank], list[int | None]]:
    """A reader of the weight that row i's posting gives each of its bank's terms, the first of a term that comes twice."""
    spans, coded, worth = _spans(terms), terms.flatten().dictionary_encode(), weights.flatten().to_pylist()
    of, code = coded.indices.to_pylist(), {t: i for i, t in enumerate(coded.dictionary.to_pylist())}
    codes: list[int] = []
    last = -1

    def read(i: int, number: int, bank: Bank) -> list[int | None]:
        nonlocal last, codes
        if number != last:
            last, codes = number, [code.get(t, -1) for t in bank.names]
        lo, hi = spans[i], spans[i + 1]
        asked = dict(zip(of[lo:hi][::-1], worth[lo:hi][::-1], strict=True))
        return [asked.get(c) for c in codes]

    return read


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for row in rows for x in row], pa.int32()))


def select_evidence(pairs: DataFrame, banks: DataFrame, model: DataFrame, *, max_lines: int = MAX_LINES,
                    max_current: int = MAX_CURRENT, max_other: int = MAX_OTHER, every: bool = False, key: str = "candidate_id") -> DataFrame:
    """(key, jd_id, bank_no, bullets, keywords, minimums, picked, lines, counts) for every pair; keywords are (term, weight).

    Pairs meet their posting first and take along its terms and weights; banks, the wider side, then move once to the
    pairs and not with them.  A bank's pairs follow one another after that join, so a bank is read once for all of them.
    What else the banks hold goes along, and the postings' `asked` terms: what is written of a pair's choice later needs
    no join of its own.  With `every`, pairs of unknown postings or banks stay, with nothing chosen.
    """
    ship(pairs.sparkSession)

    @F.arrow_udf(SELECTION)
    def chosen(bank_no: pa.Array, roles: pa.Array, current: pa.Array, cost: pa.Array, tags: pa.Array, chars: pa.Array, covers: pa.Array, terms: pa.Array, weights: pa.Array) -> pa.Array:
        parts, weight_of = (roles, current, cost, tags, chars, covers), _asked_weights(terms, weights)
        firsts, picks, lines, sizes, covered, times = [], [], [], [0], [], []
        last = -1
        for i, number in enumerate(bank_no.to_pylist()):
            if number != last:
                last, bank = number, Bank.of(*(c[i].as_py() or [] for c in parts))
            first, picked, n, counts = chosen_from(bank, weight_of(i, number, bank), max_lines, max_current, max_other)
            firsts.append(first)
            picks.append(picked)
            lines.append(n)
            covered += [bank.names[t] for t in counts]
            times += counts.values()
            sizes.append(len(covered))
        found = pa.MapArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(covered, pa.string()), pa.array(times, pa.int32()))
        return pa.StructArray.from_arrays([_lists(firsts), _lists(picks), pa.array(lines, pa.int32()), found], names=["minimums", "picked", "lines", "counts"])

    how, along = "left" if every else "inner", [*(c for c in banks.columns if c not in (key, "bullets")), *({"asked"} & {*model.columns})]
    asked = model.select("jd_id", F.transform("keywords", lambda k: F.struct(k["term"].alias("term"), k["weight"].alias("weight"))).alias("keywords"), *({"asked"} & {*model.columns}), F.lit(True).alias("_known"))
    rows = pairs.select(key, "jd_id").join(asked, "jd_id", how).join(shuffled(banks.withColumn("bank_no", F.monotonically_increasing_id())), key, how)
    fields = ("role_rank", "is_current", "cost", "n_tags", "n_chars", "covers")
    done = rows.withColumn("_s", chosen(F.col("bank_no"), *_coded(F.col("keywords"), F.col("bullets"), fields)))
    picks = {n: F.col(f"_s.{n}") for n in ("minimums", "picked")}
    if every:
        picks = {n: F.when(F.col("_known"), c).otherwise(F.array().cast("array<int>")) for n, c in picks.items()}
    return done.select(key, "jd_id", "bank_no", "bullets", "keywords", *(c.alias(n) for n, c in picks.items()), "_s.lines", "_s.counts", *along)


def selection_rows(selected: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Long form, render order: roles current to newest, picks strongest first."""
    picks = ar.let(F.col("bullets"), lambda bs: F.transform("picked", lambda p, i: ar.let(F.get(bs, p), lambda b: F.struct(
        (i + 1).alias("pick_no"), b["role_rank"].alias("role_rank"), b["role_no"].alias("role_no"), b["bullet_no"].alias("bullet_no"),
        b["cost"].alias("cost"), F.size(b["covers"]).alias("n_covers")))))
    return ar.unpack(selected, [key, "jd_id"], picks, "pick_no")


def times_covered(selected: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, jd_id, term, n): how many picks cover each term, read from the pair's own row; a pair that comes twice has its terms twice."""
    shown = ar.let(F.col("bullets"), lambda bs: F.flatten(F.transform("picked", lambda p: F.get(bs, p)["covers"])))
    counted = ar.let(shown, lambda ts: F.transform(F.array_distinct(ts), lambda t: F.struct(
        t.alias("term"), F.size(F.filter(ts, lambda x: x == t)).alias("n"))))
    return ar.unpack(selected, [key, "jd_id"], counted, "term")


def with_listed(banks: DataFrame, skills: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Bank rows with the skills list of their person, (key, skills array), which their pairs then take along."""
    return banks.join(shuffled(skills), key)


def selection_summary(selected: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Terms covered by bullets, only by the `skills` list that the pairs bear of their bank, and not at all."""
    by_bullets = F.map_keys("counts")
    wanted = ar.field(F.col("keywords"), "term")
    listed = F.array_intersect(wanted, F.col("skills"))
    return selected.select(
        key, "jd_id", F.col("lines").alias("total_lines"), F.sort_array(by_bullets).alias("covered_by_bullets"),
        F.sort_array(F.array_except(listed, by_bullets)).alias("covered_by_skills"),
        F.array_except(F.array_except(wanted, by_bullets), listed).alias("uncovered"))


def swap_add_moves(selected: DataFrame, *, max_lines: int = MAX_LINES, max_current: int = MAX_CURRENT,
                   max_other: int = MAX_OTHER, key: str = "candidate_id") -> DataFrame:
    """Every same-role swap or allowed addition, with its change in plain weighted coverage."""
    ship(selected.sparkSession)

    @F.arrow_udf(MOVES)
    def moves(bank_no: pa.Array, roles: pa.Array, current: pa.Array, cost: pa.Array, covers: pa.Array, terms: pa.Array, weights: pa.Array, picked: pa.Array, lines: pa.Array) -> pa.Array:
        weight_of = _asked_weights(terms, weights)
        taken, picks, used = _spans(picked), picked.flatten().to_pylist(), lines.to_pylist()
        sizes, ranks, found, last = [0], [], [], -1
        for i, number in enumerate(bank_no.to_pylist()):
            if number != last:
                last, parts = number, [c[i].as_py() or [] for c in (roles, current, cost, covers)]
                none = [0] * len(parts[0])
                bank = Bank.of(*parts[:3], none, none, parts[3])
            new = moves_from(bank, weight_of(i, number, bank), picks[taken[i]:taken[i + 1]], used[i], max_lines, max_current, max_other)
            ranks += [bank.roles[b] for _, b, _ in new]
            found += new
            sizes.append(len(found))
        outs, ins, gains = zip(*found, strict=True) if found else ((), (), ())
        outs = pa.array(outs, pa.int32())
        rows = pa.StructArray.from_arrays(
            [pc.if_else(pc.less(outs, 0), "add", "swap"), outs, pa.array(ins, pa.int32()), pa.array(ranks, pa.int32()), pc.divide(pa.array(gains, pa.float64()), 100.0)],
            names=["move", "out_id", "in_id", "role_rank", "gain"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)

    fields = ("role_rank", "is_current", "cost", "covers")
    found = selected.withColumn("_m", moves(F.col("bank_no"), *_coded(F.col("keywords"), F.col("bullets"), fields), F.col("picked"), F.col("lines")))
    return ar.unpack(found, [key, "jd_id"], F.col("_m"), "move")


def best_move(moves: DataFrame, key: str = "candidate_id") -> DataFrame:
    """The most gainful move per pair; additive aggregate, so no window over a pair's moves.  Only moves that gain are
    gathered: where any does, the best one does."""
    order = F.struct(F.col("gain"), F.when(F.col("move") == "add", 1).otherwise(0), -F.col("in_id"), -F.col("out_id"))
    return moves.where("gain > 0").groupBy(key, "jd_id").agg(F.max_by(F.struct("move", "out_id", "in_id", "gain"), order).alias("m")).select(key, "jd_id", "m.*")


def objective_score(visibility: Column, keyword: Column, hr: Column) -> Column:
    """Weighted mean of the three offline measures, renormalised over those present."""
    parts = list(zip((visibility, keyword, hr), (45, 35, 20)))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0) for c, w in parts), F.lit(0))
    return F.bround(F.coalesce(F.try_divide(total, weight.cast("double")), F.lit(0.0)), 2)


# ------------------------------------------------------------------ rendering

def ordered_skills(selected: DataFrame, key: str = "candidate_id", n: int = SKILLS_SHOWN, *, once: bool = False) -> DataFrame:
    """The pairs with `skills`, array<struct<skill_no, term, shown>>: covered by weight then name, other bullet skills,
    extras; at most n.

    Pairs bear what their bank (`with_skills`) and posting (`with_asked`) hold, so a line is made in the pair's row.  A
    pair that comes more than once has the skills of all its choices; with `once` none does, and no row moves for that.
    """
    none = F.array().cast("array<string>")
    tags = F.array_distinct(F.flatten(F.transform("picked", lambda p: F.coalesce(F.get("tags", p), none))))
    rows = selected.withColumns({"_tags": tags, "_asked": F.coalesce("asked", none), "_extra": F.coalesce("extra", none)})
    if not once:
        rows = rows.withColumn("_tags", F.array_distinct(F.flatten(F.collect_list("_tags").over(W.partitionBy(key, "jd_id")))))
    line = F.concat(F.array_intersect("_asked", F.array_union("_tags", "_extra")), F.sort_array(F.array_except("_tags", "_asked")),
                    F.sort_array(F.array_except(F.array_except("_extra", "_tags"), "_asked")))
    skills = F.transform(F.slice(line, 1, n), lambda t, i: F.struct((i + 1).alias("skill_no"), t.alias("term"), F.try_element_at("names", t).alias("shown")))
    return rows.withColumn("skills", skills).drop("_tags", "_asked", "_extra")


def join_and(items: Column) -> Column:
    return F.when(F.size(items) <= 1, F.coalesce(F.get(items, 0), F.lit(""))).otherwise(F.concat(
        F.array_join(F.slice(items, F.lit(1), F.size(items) - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def month_text(month: Column) -> Column:
    name = F.get(F.array(*map(F.lit, V.MONTH_NAMES)), dt.month_of(month) - 1)
    return F.coalesce(F.concat(name, F.lit(" "), dt.year_of(month).cast("string")), F.lit("?"))


CONTACT_LINE = ("email", "phone", "location", "linkedin", "github", "website")
CLAIMS = 5


def with_document_parts(rows: DataFrame, banks: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Bank rows with what all documents of a bank share, written once for its pairs: `headline`, the blocks `top` and
    `end`, the `heads` of its roles, and the role, line and tags of each bullet.

    `banks` is the nested bank.  Bullet numbers are those of the whole bank, confirmed or not.  The contact line has those
    of CONTACT_LINE that the bank holds; without a headline the first role's title heads the summary.
    """
    from hiresift.sources.bank import clean_roles

    first_title = tx.strip(F.coalesce(F.get(F.col("roles"), 0)["title"], F.lit("")))
    head = F.when(tx.strip(F.coalesce("headline", F.lit(""))) != "", tx.strip(F.col("headline"))).otherwise(first_title)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    held = [f for f in CONTACT_LINE if f in banks.schema["contact"].dataType.names]
    contact = F.array_join(F.filter(F.array(*[F.col(f"contact.{f}") for f in held]), lambda c: ~blank(c)), " | ")
    header = F.filter(F.array(F.col("contact.name"), contact), lambda x: ~blank(x))
    schools = F.transform("education", lambda e: F.concat(
        F.array_join(F.filter(F.array(e["degree"], e["institution"]), lambda x: ~blank(x)), " - "),
        F.when(blank(e["year"]), "").otherwise(F.concat(F.lit(" ("), e["year"], F.lit(")")))))
    certs = F.filter("certifications", lambda c: ~blank(c))
    listed = F.when(F.size(certs) > 0, F.concat(F.array(F.lit(""), F.lit("Certifications")), certs)).otherwise(F.array().cast("array<string>"))

    def title(r: Column) -> Column:
        dates = F.concat(F.lit(" ("), month_text(r["start_month"]), F.lit(" - "),
                         F.when(r["past"], month_text(r["end_month"])).otherwise("Present"), F.lit(")"))
        return F.concat(r["title"], F.lit(" - "), r["company"], dates)

    texts = banks.select(
        key, head.alias("headline"), F.concat(header, F.array(F.lit(""), F.lit("Summary"))).alias("top"),
        F.concat(F.array(F.lit("Education")), schools, listed).alias("end"), clean_roles(F.col("roles")).alias("_roles"))
    texts = texts.select(key, "headline", "top", "end", F.transform("_roles", title).alias("heads"), ar.field(F.col("_roles"), "bullets").alias("_said"))
    said = lambda b: F.get(F.get("_said", b["role_rank"] - 1), b["bullet_no"] - 1)
    return rows.join(shuffled(texts), key).withColumns({
        "places": ar.field(F.col("bullets"), "role_rank"), "said": F.transform("bullets", lambda b: F.concat(F.lit("- "), said(b)["text"])),
        "claimed": F.transform("bullets", lambda b: F.transform(said(b)["skills"], lambda x: tm.canonical(x)))}).drop("_said")


def assemble_documents(selected: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, jd_id, document): the rendered plain-text document of each pair.

    Pairs bear the parts of their bank (`with_document_parts`) and their `ordered_skills`.  Without covered terms the
    chosen bullets' own tags are claimed, in the order shown.
    """
    rows = selected.withColumns({"_terms": ar.field(F.col("keywords"), "term"), "_worth": F.transform("keywords", lambda k: (k["weight"] * 100).cast("int")), "_met": F.map_keys("counts")})
    worth = lambda t: F.coalesce(F.get("_worth", F.array_position("_terms", t).cast("int") - 1), F.lit(0))
    covered = ar.field(F.sort_array(F.transform("_met", lambda t: F.struct((-worth(t)).alias("w"), t.alias("t")))), "t")
    in_order = F.sort_array(F.transform("picked", lambda p, i: F.struct(F.get("places", p).alias("r"), i.alias("i"), p.alias("p"))))
    own_tags = F.array_distinct(F.flatten(F.transform(in_order, lambda s: F.get("claimed", s["p"]))))
    backed = F.when(F.size("_met") > 0, covered).otherwise(own_tags)
    claims = F.transform(F.slice(backed, 1, CLAIMS), lambda t: F.coalesce(F.try_element_at("names", t), tx.display_case(t)))
    summary = ar.let(claims, lambda cs: F.when(F.size(cs) > 0, F.concat(
        F.col("headline"), F.lit(" with hands-on experience in "), join_and(cs), F.lit("."))).otherwise(
        F.concat(F.col("headline"), F.lit(" with professional experience delivering reporting and analysis."))))

    def block(head: Column, i: Column) -> Column:
        return ar.let(F.filter("picked", lambda p: F.get("places", p) == i + 1), lambda mine: F.when(
            F.size(mine) > 0, F.concat(F.array(head), F.transform(mine, lambda p: F.get("said", p)), F.array(F.lit("")))))

    line = F.coalesce(F.array_join(ar.field(F.col("skills"), "shown"), ", "), F.lit(""))
    doc = F.concat("top", F.array(summary, F.lit(""), F.lit("Skills"), line, F.lit(""), F.lit("Experience")), F.flatten(F.array_compact(F.transform("heads", block))), "end")
    return rows.select(key, "jd_id", F.array_join(doc, "\n").alias("document"))


# ------------------------------------------------------------------ gaps

GAP_ORDER = {"nothing-in-bank": 0, "unconfirmed": 1, "not-shown": 2}


def declared_terms(banks: DataFrame, vocabulary: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, term): vocabulary terms that a bank's extras and certifications name, without a bullet."""
    listed = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("skills_extra", "certifications")])
    rows = banks.select(key, F.posexplode(listed).alias("bullet_no", "text")).select(key, F.lit(0).alias("role_no"), "bullet_no", "text", F.array("text").alias("skills"))
    return bullet_terms(rows, vocabulary, key).select(key, "term").distinct()


def truth_gaps(missing: DataFrame, confirmed: DataFrame, unconfirmed: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Why each missing term is missing.  `missing` is (key, jd_id, term, weight, section); the others (key, term)."""
    c = confirmed.select(key, "term").distinct().withColumn("_c", F.lit(True))
    u = unconfirmed.select(key, "term").distinct().withColumn("_u", F.lit(True))
    rows = missing.join(c, [key, "term"], "left").join(u, [key, "term"], "left")
    status = F.when(F.col("_c"), "not-shown").when(F.col("_u"), "unconfirmed").otherwise("nothing-in-bank")
    return rows.select(key, "jd_id", "term", "weight", F.col("section").isin(*V.HARD_SECTIONS).alias("required"), status.alias("status")).withColumn(
        "status_order", tx.lookup(GAP_ORDER, F.col("status")))
