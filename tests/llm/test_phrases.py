"""Phrase mining against its SQL and plain counting, with forged fingerprints and long texts."""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from hiresift.llm import phrases, queries
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


def plain(rows, least, most, top, share):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        frequent = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        inside = {}
        for w, a in frequent.items():
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    inside[w[i:i + m]] = max(inside.get(w[i:i + m], 0), a)
        kept = []
        for w, a in frequent.items():
            if 100 * inside.get(w, 0) >= share * a:
                continue
            score, k = min((1000000 * a * a // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    words = ["New", "york", "city", "é", "Ünder", "a", "b\xa0c", "<x>", "the"]
    gaps = [" ", " ", "  ", "\t", ", ", ".\n", " \x0b", "; ", " "]
    def text(n):
        return "".join(words[i] + gaps[j] for i, j in zip(rng.integers(0, 9, n), rng.integers(0, 9, n), strict=True))
    out = [(i, ["en", "de", None, "und"][i % 4], text(int(rng.integers(0, 60)))) for i in range(60)]
    return out + [(100, "en", None), (101, "en", ""), (102, "en", text(5000)), (103, None, "x" * 3000 + " new york"), (1, "en", text(20)), (1, "en", "the end"), (1, "en", "the end"), (None, "de", text(30))]


@pytest.mark.parametrize(("block", "bits", "most"), [(1 << 20, 20, 3), (64, 15, 3), (300, 15, 4), (1 << 20, 15, 2)])
def test_phrases_equal_plain_counting(spark, rows, block, bits, most):
    docs = spark.createDataFrame([(*r, 1, "w", "p") for r in rows], "doc_id long, lang string, text string, f int, words string, phrase string").repartition(3)
    got = phrases.collocations(docs, 3, most, 50, 50, bits, block).drop("first_doc_id").collect()
    assert sorted(map(tuple, got)) == plain([(lang, t) for _, lang, t in rows], 3, most, 50, 50)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


def test_runs_of_one_fingerprint_are_told_apart_by_their_text():
    held = phrases.block_of([b"aa bb aa cc aa bb", b"bb aa"], [1, 1], 0)
    forged = phrases.Block(held.raw, held.doc_of_word, held.seed, held.piece, held.starts, held.ends, np.full(len(held.word), 7, np.uint64), 0)
    rep = phrases.same_words(forged)
    words = [held.raw[a:b] for a, b in zip(held.starts, held.ends, strict=True)]
    assert [words[r] for r in rep] == words and len(set(rep.tolist())) == 3
    at = forged.grams(2)
    pointer, hits = phrases.entries_of(forged, at, np.full(len(at), 5, np.uint64), 2, rep)
    got = {(words[p], words[p + 1]): n for p, n in zip(pointer.tolist(), hits.tolist(), strict=True)}
    assert got == {(b"aa", b"bb"): 2, (b"bb", b"aa"): 2, (b"aa", b"cc"): 1, (b"cc", b"aa"): 1}


def test_fingerprints_do_not_depend_on_the_place():
    one, two = phrases.block_of([b"x y z"], [3], 0), phrases.block_of([b"some more text", b"and x  y\tz"], [9, 3], 0)
    for m in (1, 2, 3):
        a = set(one.fingerprints(one.grams(m), m).tolist())
        assert a <= set(two.fingerprints(two.grams(m), m).tolist())


def test_query_equals_its_sql(spark):
    ok, note = compare(spark, connect(SF), SF, "op12", queries.op12_phrase_collocations, queries.ORACLES["op12_phrase_collocations"])
    assert ok, note
