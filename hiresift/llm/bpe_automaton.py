"""Byte-pair encoding by a tokenization automaton, and decoding by its labels.

The merges are compiled, in order, into a deterministic automaton over tokens.  It begins with one state that any
symbol leads back to.  The gadget of merge (a, b) then changes it so that no path reads a and then b any more, and
every path that did reads the token ab instead: the state behind a is copied without its b arc, a leads to the copy,
and ab leads, from wherever a can be read, to the state behind b.  All arcs of one token end in the same state, so the
automaton is a state for each token, a class for each token as a label, and one bit for each state and class: may a
token of this class be read here?  Tokens share a state or a class until a gadget tells them apart.

After the last merge the only path that spells a word is its encoding, and every prefix of a word has one path at
most.  A word is read along arcs that the tables allow, the longest label first; a place from which the word cannot be
ended is not tried again.  A path's labels, one after another, are the decoded text.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hiresift.llm.common import by_arrow, columns, public_tokenizer, small_batches, text_of
from hiresift.llm.tokens import SEPARATORS

START = 0
END = 0  # in the tree of tokens: the word ends here
TAIL = ".,;:!?"
MEMO_BYTES = 192 << 20
WORD_BYTES = 200  # of a word in the memo beside its characters and ids
MEMO_WORD = 64  # longer words are encoded each time
#: the tokenizer's own split pattern, a fixed value of its file: a word in ASCII letters is one piece
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CODERS: dict[str, "Coder"] = {}


def byte_alphabet() -> str:
    """The printable character that byte-level vocabularies write for each byte: itself where it has a glyph in Latin-1,
    else the next one from U+0100 on."""
    spare = iter(range(256, 512))
    return "".join(chr(b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(spare)) for b in range(256))


class Arcs:
    """The growing bit table of states x label classes, one byte a bit while gadgets are applied."""

    def __init__(self):
        self.bits, self.states, self.classes = np.ones((256, 256), np.uint8), 1, 1

    def copy_state(self, q: int) -> int:
        if self.states == len(self.bits):
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        self.bits[self.states] = self.bits[q]
        self.states += 1
        return self.states - 1

    def copy_class(self, c: int) -> int:
        if self.classes == self.bits.shape[1]:
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)], axis=1)
        self.bits[:self.states, self.classes] = self.bits[:self.states, c]
        self.classes += 1
        return self.classes - 1


def compile_merges(symbols: Iterable[str], merges: Iterable[tuple[str, str]]) -> tuple[dict[str, int], dict[str, int], np.ndarray]:
    """(state behind each token, class of each token as a label, arcs[state, class]) after every merge's gadget.

    State 0 is where a word begins.  A merge whose two tokens can no longer stand side by side adds nothing, and its
    token is not read anywhere.  Two merges that make one token are refused: its arcs would have two ends.
    """
    state, label = dict.fromkeys(symbols, 0), dict.fromkeys(symbols, 0)
    arcs, state_users, class_users = Arcs(), [len(state) + 1], [len(label)]
    for a, b in merges:
        if a + b in state:
            raise ValueError(f"two merges make {a + b!r}")
        if a not in state or b not in state or not arcs.bits[state[a], label[b]]:
            continue
        if class_users[label[b]] > 1:  # b is told apart from the labels it shared a class with
            class_users[label[b]] -= 1
            label[b] = arcs.copy_class(label[b])
            class_users.append(1)
        state[a + b] = state[b]  # the arcs of ab end behind b
        state_users[state[b]] += 1
        if state_users[state[a]] > 1:  # the copy that has lost its b arc; a leads there from now on
            state_users[state[a]] -= 1
            state[a] = arcs.copy_state(state[a])
            state_users.append(1)
        arcs.bits[state[a], label[b]] = 0
        label[a + b] = label[a]  # ab may be read where a may
        class_users[label[a]] += 1
    return state, label, arcs.bits[:arcs.states, :arcs.classes]


class Automaton:
    """Tables of a compiled tokenizer: bounded by its vocabulary, so they may be sent to every executor."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str, special: dict[str, int]):
        symbols = [x for c in byte_alphabet() for x in (c, c + end)]
        state, label, arcs = compile_merges(symbols, merges)
        self.end, self.special, self.row = end, special, -(-arcs.shape[1] // 8)
        self.bits = np.packbits(arcs, axis=1, bitorder="little").tobytes()
        #: token -> (id, the bit and byte of its class, the state behind it)
        self.token = {t: (vocabulary[t], label[t] >> 3, 1 << (label[t] & 7), state[t]) for t in state if t in vocabulary}
        labels = {i: t for t, i in vocabulary.items()} | {i: t for t, i in special.items()}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]

    def nbytes(self) -> int:
        return len(self.bits)

    def trie(self) -> dict:
        """The tokens as a tree of symbols; under None the token that ends there, under END one that ends the word."""
        root: dict = {}
        for t, entry in self.token.items():
            node = root
            ends = t.endswith(self.end) and t != self.end
            for c in t.removesuffix(self.end) if ends else t:
                node = node.setdefault(c, {})
            node[END if ends else None] = entry
        return root

    def encode(self, word: str, trie: dict) -> list[int]:
        """ids of one pre-split word, written in the byte alphabet.

        From each place the longest token is tried first.  A prefix has one path at most, so a place that led nowhere
        once never leads anywhere.
        """
        bits, row, n, dead = self.bits, self.row, len(word), set()
        at, state, ids, back = 0, START, [], []
        options = None
        while True:
            if options is None:
                options, node = [], trie
                for end in range(at, n):
                    node = node.get(word[end])
                    if node is None:
                        break
                    if None in node:
                        options.append((end + 1, node[None]))
                else:
                    if END in node:
                        options.append((-1, node[END]))
            while options:
                end, (one, byte, bit, behind) = options.pop()
                if end < 0:
                    if bits[state * row + byte] & bit:
                        ids.append(one)
                        return ids
                elif end < n and end not in dead and bits[state * row + byte] & bit:
                    back.append((at, state, options))
                    ids.append(one)
                    at, state, options = end, behind, None
                    break
            else:
                if not back:
                    raise ValueError(f"no path spells {word!r}")
                dead.add(at)
                at, state, options = back.pop()
                ids.pop()

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs that the ids name, with a space between them, as the library writes them."""
        return " ".join(map(self.labels.__getitem__, ids))


def compile_tokenizer(path: str) -> Automaton:
    """The automaton of a tokenizer file whose words are lower-cased, split by SPLIT and end in a suffix."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    kinds = [x["type"] for x in file["normalizer"]["normalizers"]]
    split = file["pre_tokenizer"]["pretokenizers"][0]
    if kinds != ["NFC", "Replace", "Lowercase"] or split.get("pattern", {}).get("Regex") != SPLIT or not model.get("end_of_word_suffix") or file.get("decoder"):
        raise ValueError("this tokenizer does not split and decode words the way the automaton does")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Automaton(model["vocab"], merges, model["end_of_word_suffix"], {t["content"]: t["id"] for t in file["added_tokens"]})


class Coder:
    """Whole texts through an automaton, with a memo of words bounded in bytes; special strings keep their own ids.

    A word of letters below U+0250 with punctuation behind it is two pieces, known apart; any other word is normalised
    and split by the tokenizer file's own rules.
    """

    def __init__(self, automaton: Automaton, path: str, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.automaton, self.trie, self.memo, self.room = automaton, automaton.trie(), {}, memo_bytes
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(automaton.special, key=len, reverse=True))) + ")") if automaton.special else None
        rules, alphabet = Tokenizer.from_file(path), byte_alphabet()
        self.normalise, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.written = {i: "".join(alphabet[b] for b in chr(i).encode()) for i in range(0x300)}

    def _ruled(self, word: str) -> list[int]:
        ids = []
        for i, part in enumerate(self.special.split(word) if self.special else [word]):
            if i % 2:
                ids.append(self.automaton.special[part])
            else:
                for piece, _ in self.split(self.normalise(part)):
                    ids.extend(self.automaton.encode(piece, self.trie))
        return ids

    def _learn(self, words: Iterable[str]) -> list[str]:
        """Put words into the memo; returns every key added."""
        memo, added, encode, written, trie = self.memo, [], self.automaton.encode, self.written, self.trie
        for word in words:
            core = word.rstrip(TAIL)
            low = core.lower()
            if core.isalpha() and max(low) < "\u0250" and max(core) < "\u0250" and len(low) == len(core):
                ids = b""
                for piece in (low, word[len(core):]):
                    if piece:
                        known = memo.get(piece)
                        if known is None:
                            known = memo[piece] = array("I", encode(piece.translate(written), trie)).tobytes()
                            added.append(piece)
                        ids += known
                if word != low:
                    memo[word] = ids
                    added.append(word)
            elif word not in memo:
                memo[word] = array("I", self._ruled(word)).tobytes()
                added.append(word)
        return added

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of whole texts as little-endian 32-bit integers.  White space ends a word and is not read."""
        words = [[t] if SEPARATORS.search(t) else t.split() for t in texts]
        added = self._learn(set().union(*words).difference(self.memo))
        get = self.memo.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        for word in added:
            cost = WORD_BYTES + 2 * len(word) + len(self.memo[word])
            if len(word) > MEMO_WORD or cost > self.room:
                del self.memo[word]
            else:
                self.room -= cost
        return out


def encode_decode(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; `with_ids` adds ids and the decoded text.

    A null text is empty: no token, the digests of nothing.  Rows are answered one by one, so repeated ids, null ids
    and repeated rows each keep their row; columns of other names are left behind.  Map-only: the compiled tables are
    all that the executors are sent, and the vocabulary bounds them.
    """
    def place() -> str:
        return public_tokenizer(tokenizer) if "/" not in tokenizer else tokenizer

    shared = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(place()))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = shared.value
        if tokenizer not in _CODERS:  # one memo for each worker process
            _CODERS[tokenizer] = Coder(compiled, place())
        coder = _CODERS[tokenizer]
        for batch in small_batches(batches, 200):
            rows = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            kept, decoded = [], []
            for ids in coder.encode(text_of(batch.column("text"))):
                words = compiled.decode(np.frombuffer(ids, "<u4").tolist())
                rows["n_tokens"].append(len(ids) // 4)
                rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(words.encode()).hexdigest())
                if with_ids:
                    kept.append(ids)
                    decoded.append(words)
            rows["n_tokens"] = pa.array(rows["n_tokens"], pa.int64())
            yield pa.RecordBatch.from_pydict(rows | ({"ids": pa.array(kept, pa.binary()), "decoded": pa.array(decoded, pa.string())} if with_ids else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")
    plain = columns(docs, "doc_id", "text")
    return by_arrow(plain.select(plain["doc_id"].cast("long").alias("doc_id"), "text"), digests, schema)
