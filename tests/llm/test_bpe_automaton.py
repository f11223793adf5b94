"""The tokenization automaton against plain merging, the gadget on an explicit graph, and the library itself."""
from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

from hiresift.llm import bpe_automaton as bpe
from hiresift.llm.common import public_tokenizer

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizer(NAME))


@pytest.fixture(scope="module")
def coder():
    path = public_tokenizer(NAME)
    return bpe.Coder(bpe.compile_tokenizer(path), path)


def merged(word, merges):
    """Each merge in turn, from left to right."""
    parts = list(word)
    for a, b in merges:
        i = 0
        while i + 1 < len(parts):
            if (parts[i], parts[i + 1]) == (a, b):
                parts[i:i + 2] = [a + b]
            i += 1
    return tuple(parts)


def explicit(symbols, merges):
    """The gadgets applied to a graph held arc by arc."""
    arcs = [{s: 0 for s in symbols}]
    for a, b in merges:
        ends = {q for out in arcs if a in out for q in [out[a]] if b in arcs[q]}
        copies, behind = {}, {q: arcs[q][b] for q in ends}
        for q in sorted(ends):
            copies[q] = len(arcs)
            arcs.append({k: v for k, v in arcs[q].items() if k != b})
        for out in arcs:
            if a in out and out[a] in copies:
                q = out[a]
                out[a], out[a + b] = copies[q], behind[q]
    return arcs


def random_merges(rng, letters, n):
    tokens, merges = list(letters), []
    while len(merges) < n:
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    return merges


@pytest.mark.parametrize("seed", range(12))
def test_the_only_path_of_a_word_is_its_encoding(seed):
    rng = random.Random(seed)
    merges = random_merges(rng, "ab" if seed % 2 else "abc", 12)
    state, label, arcs = bpe.compile_merges(merges[0][0][:1] + "abc", merges)
    graph = explicit("abc", merges)

    def paths(word, q=0, at=0):
        if at == len(word):
            yield ()
        for end in range(at + 1, len(word) + 1):
            t = word[at:end]
            if t in state and arcs[q, label[t]]:
                yield from ((t, *rest) for rest in paths(word, state[t], end))

    def graph_paths(word, q=0, at=0):
        if at == len(word):
            yield ()
        for end in range(at + 1, len(word) + 1):
            if (t := word[at:end]) in graph[q]:
                yield from ((t, *rest) for rest in graph_paths(word, graph[q][t], end))

    for n in range(1, 7):
        for word in map("".join, itertools.product("abc", repeat=n)):
            assert list(paths(word)) == [merged(word, merges)] == list(graph_paths(word))


def test_two_merges_to_one_token_are_refused():
    with pytest.raises(ValueError, match="two merges"):
        bpe.compile_merges("abc", [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])


def test_texts_give_the_library_s_ids_and_decode_to_its_text(library, coder):
    rng = random.Random(3)
    letters = "abcÀéßİΣσς ﬁ漢字0٣²’'.,!?<|>-_\n\t\x1c\x85\xa0 ́e"
    texts = ["", " \n", "don't we'll <|endoftext|> a.b.c x<|endoftext|>y<|startoftext|>É́", "BİTTİ. ALİ, geldi İ! İ? İ; İ:", "a" * 5000, "ab" * 3000 + "!" * 400, "word " * 20_000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    vocabulary = sorted(library.get_vocab())
    texts += [" ".join(rng.choice(vocabulary).replace("</w>", "") for _ in range(5)) + "".join(rng.choice(vocabulary).replace("</w>", "") for _ in range(3)) for _ in range(3000)]
    for _ in range(2):
        for text, raw, want in zip(texts, coder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            ids = np.frombuffer(raw, "<u4").tolist()
            assert ids == want.ids, text
            assert coder.automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_a_full_memo_changes_nothing(library, coder):
    small = bpe.Coder(coder.automaton, public_tokenizer(NAME), 800)
    text = "some words, some more words and then some Words again " + "x" * 100
    assert [small.encode([text]) for _ in range(3)] == [coder.encode([text])] * 3
    assert small.room >= 0 and 0 < len(small.memo) < 5


def test_query_rows(texts, library):
    rows = bpe.encode_decode(texts, NAME, with_ids=True).collect()
    want = []
    for r in texts.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        raw, decoded = np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), raw, decoded))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids), r.decoded) for r in rows), key=str) == sorted(want, key=str)
    assert bpe.encode_decode(texts.limit(0), NAME).count() == 0
