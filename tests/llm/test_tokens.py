"""Token files, packing and section counts against the library's own encoding of whole texts."""
from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from hiresift.llm import packing, token_counts, token_file
from hiresift.llm.common import public_tokenizer
from hiresift.llm.tokens import WordEncoder

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer(NAME))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False)


def test_words_give_the_library_s_ids_and_spans(library):
    rng = random.Random(3)
    letters = "abcÀéßİΣσς ﬁ漢字0٣²’'.,!?<|>-_\n\t\x1c ́e"
    texts = ["", "don't we'll <|endoftext|> a.b.c", "BİTTİ. Ali ALİ, geldi", *(f"Aİ{a}{b} İ{a}" for a in ".,;:!?" for b in ("", ".", "x")), *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300))]
    for memo in (0, 5, 10_000):
        encoder = WordEncoder(public_tokenizer(NAME), memo)
        for _ in range(2):
            got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
            assert got == [library(t).ids for t in texts]
            assert [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in encoder.spans(texts)] == [library(t).offsets for t in texts]


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 127, 128, 129, 5000):
        for bits in (1, 3, 9, 16, 31, 60, 64):
            ids = rng.integers(0, 1 << 63, n, np.uint64) >> np.uint64(64 - bits) if bits < 64 else rng.integers(0, (1 << 64) - 1, n, np.uint64)
            assert (token_file.decode_ids(*token_file.encode_ids(ids), n) == ids).all()
    mixed = np.concatenate([np.zeros(200), [2**63], np.arange(70_000, 70_300), np.ones(90)]).astype(np.uint64)
    words, blocks, escapes = token_file.encode_ids(mixed)
    assert len(escapes) == 1 and (token_file.decode_ids(words, blocks, escapes, len(mixed)) == mixed).all()


def test_token_file_in_id_order(texts, library):
    rows = token_file.read_token_file(token_file.write_token_file(texts, NAME, 1, segment_ids=50)).collect()
    want = sorted(((r.doc_id if r.doc_id is not None else -1), len(library(r.text).ids) + 1, zlib.crc32(np.array([*library(r.text).ids, 1], "<u4"))) for r in texts.collect())
    got = sorted(rows, key=lambda r: r.start)
    assert [((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.ids_crc32) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert token_file.read_token_file(token_file.write_token_file(texts.limit(0), NAME, 1)).count() == 0


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 3.0}])
def test_packing_is_whole_gapless_and_in_proportion(texts, library, weights):
    window, quantum = 64, 8
    rows = packing.pack(texts, NAME, 2, window, quantum, weights, with_ids=True).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == r.length and zlib.crc32(ids.astype("<u4")) == r.ids_crc32
        windows[r.sequence_id].append((r.offset, r.length, r.queue))
        pieces[r.doc_id].append((r.start, ids.tolist()))
    for number, held in windows.items():
        ends = np.cumsum([0, *[n for _, n, _ in sorted(held)]])
        assert [o for o, _, _ in sorted(held)] == ends[:-1].tolist()
        assert ends[-1] == window or number == max(windows)
    assert sorted(windows) == list(range(len(windows)))
    for r in texts.where("doc_id <> 5").collect():
        assert [i for _, ids in sorted(pieces[r.doc_id]) for i in ids] == [*library(r.text).ids, 2]
    total = sum(len(library(r.text).ids) + 1 for r in texts.collect())
    assert sum(r.length for r in rows) == total
    if weights is None:
        share = sum(r.length for r in rows if r.queue == "a") / total
        served = 0
        for number in sorted(windows)[:-1]:
            served += sum(n for _, n, q in windows[number] if q == "a")
            assert abs(served - share * window * (number + 1)) <= 3 * quantum


def test_sections_count_each_token_by_the_rule(texts, library):
    got = defaultdict(list)
    for r in token_counts.count_tokens(texts.where("doc_id <> 5"), NAME).collect():
        got[r.doc_id].append(r)
    for r in texts.where("doc_id <> 5").collect():
        offsets = library(r.text).offsets
        assert sum(x.n_tokens for x in got[r.doc_id]) == len(offsets)
        for x in got[r.doc_id]:
            assert x.section < 0 or x.n_tokens == sum(x.start <= a < x.end for a, _ in offsets)
    starts, ends = np.array([0, 4, 9]), np.array([4, 9, 12])
    assert token_counts.allocate(starts, ends, [(0, 6), (6, 10)], "first")[0].tolist() == [2, 1]
    assert token_counts.allocate(starts, ends, [(0, 6), (6, 10)], "most")[0].tolist() == [1, 2]
    assert token_counts.allocate(starts, ends, [(0, 6), (6, 10)], "each")[0].tolist() == [2, 2]
    assert token_counts.allocate(starts, ends, [(5, 6)], "first")[1] == 3


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 3.0}])
def test_packing_is_the_same_with_more_sources_than_queues(texts, weights):
    def rows(most):
        return sorted(map(tuple, packing.pack(texts.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).coalesce(1).sortWithinPartitions("doc_id"), NAME, 2, 64, 8, weights, max_queues=most, with_ids=True).collect()))

    assert rows(1) == rows(4096)
