"""Encoding with the tokenizers library, each distinct word of a batch once.

A tokenizer whose rules drop white space and never join what stands on both sides of it gives a text the ids of its
words, one after another.  Arrow splits a batch into words and numbers the distinct ones; what a word is made of, a
core of letters and the punctuation behind it, is numbered again, and only those pieces are encoded by the library.
Texts are put together by position.  The ids are those that the library gives for the whole text, and a worker holds
no more than one batch.
"""
from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hiresift.llm.common import public_tokenizer

#: Python's split() takes these for white space, the tokenizers' patterns do not.
SEPARATORS = re.compile("[\x1c-\x1f]")
TAIL = ".,;:!?"
WHOLE = re.compile(r"\S+")
MEMO_WORDS = 700_000
BATCH_BYTES = 16 << 20
JOINED = 4000
#: letters that are lowered one by one to letters (not the dotted capital I): a run of them is one piece, and so is the tail
CORE_AND_TAIL = "^(?P<core>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<tail>[.,;:!?]*)$"
_ENCODERS: dict[str, "WordEncoder"] = {}


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about `size` bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


class WordEncoder:
    """ids and places of whole texts; `memo_words` bounds the words whose places are remembered."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        rules = json.loads(self.library.to_str())
        if [x["type"] for x in rules["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in rules["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"]:
            raise ValueError("words are split, lowered and encoded apart: this tokenizer has other rules")
        self.bare = Tokenizer(self.library.model)  # for lowered words of letters: nothing is left to normalise or split
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.library.get_vocab_size()
        wide = size > 65536
        self.code, self.dtype = ("I", np.dtype("<u4")) if wide else ("H", np.dtype("<u2"))
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        if not suffix:
            raise ValueError("words are told apart by the suffix of their last token: this tokenizer has none")
        self.ends_word = np.array([(self.library.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.places: dict[str, bytes] = {}
        self.memo_words = memo_words

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has), text by text."""
        ids = [array(self.code, e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.frombuffer(b"".join(x.tobytes() for x in ids), self.dtype), np.array([len(x) for x in ids], np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for lowered cores, many in one text: each ends with the only token of its own that ends a word."""
        parts = [np.array(self.bare.encode_batch_fast([" ".join(pieces[i:i + JOINED])], add_special_tokens=False)[0].ids, self.dtype) for i in range(0, len(pieces), JOINED)]
        ids = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        return ids, np.diff(ends, prepend=0)

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a column's texts end to end, len + 1 offsets); null as the empty text, `end_id` behind each text."""
        given = pc.fill_null(column.cast(pa.string()), "")
        odd = np.flatnonzero(pc.match_substring_regex(given, SEPARATORS.pattern).to_numpy(zero_copy_only=False))
        plain = given
        if len(odd):
            mask = np.zeros(len(given), bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), "", given)
        split = pc.utf8_split_whitespace(plain)
        words = split.flatten().dictionary_encode()
        split_ends = split.offsets.to_numpy().astype(np.int64)
        distinct, word = words.dictionary, words.indices.to_numpy()
        parts = pc.extract_regex(distinct, CORE_AND_TAIL)
        known = parts.is_valid().to_numpy(zero_copy_only=False)
        cores, tails = (pc.struct_field(parts, i).filter(pa.array(known)) for i in (0, 1))
        numbered = [pc.utf8_lower(cores).dictionary_encode(), tails.dictionary_encode()]
        others = distinct.filter(pa.array(~known))
        encoded = [self._pieces(numbered[0].dictionary.to_pylist()), self._texts(numbered[1].dictionary.to_pylist()), self._texts(others.to_pylist()), self._texts(given.take(pa.array(odd)).to_pylist())]
        flat = np.concatenate([ids for ids, _ in encoded])
        counts = np.concatenate([n for _, n in encoded])
        # every distinct word is two pieces: core and tail, or itself (the empty string, which split() gives an empty text, is itself) and none
        n_core, n_tail, n_other = (len(n) for _, n in encoded[:3])
        counts = np.append(counts, 0)
        first, second = np.empty(len(distinct), np.int64), np.full(len(distinct), len(counts) - 1)
        first[known] = numbered[0].indices.to_numpy()
        second[known] = n_core + numbered[1].indices.to_numpy()
        first[~known] = n_core + n_tail + np.arange(n_other)
        pieces = np.stack([first[word], second[word]], axis=1).ravel()
        ends_at = 2 * (split_ends[1:] - split_ends[0])
        if len(odd):  # their only word is the empty string: the whole text's ids take its place
            pieces[ends_at[odd] - 2] = n_core + n_tail + n_other + np.arange(len(odd))
        starts = np.cumsum(counts) - counts
        size = counts[pieces]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[pieces] - (ends - size), size) + np.arange(total)]
        offsets = np.concatenate([[0], np.append(0, ends)[ends_at]]).astype(np.int64)
        if end_id is None:
            return ids, offsets
        return np.insert(ids, offsets[1:], end_id).astype(self.dtype), offsets + np.arange(len(offsets))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian bytes of `dtype`."""
        ids, offsets = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text the first and the past-the-last character of every token, as the library gives them."""
        out = []
        for t in texts:
            if SEPARATORS.search(t):
                pairs = np.array(self.library.encode(t, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            else:
                found = [(m.start(), m[0]) for m in WHOLE.finditer(t)]
                local = [self._local(w) for _, w in found]
                pairs = np.frombuffer(b"".join(local), "<u4").astype(np.int64).reshape(-1, 2)
                pairs = pairs + np.repeat(np.array([at for at, _ in found], np.int64), [len(x) // 8 for x in local])[:, None]
            out.append((pairs[:, 0], pairs[:, 1]))
        return out

    def _local(self, word: str) -> bytes:
        """Token spans inside a word; a core in letters and its tail are looked up apart, as in `_learn`."""
        known = self.places.get(word)
        if known is not None:
            return known
        core = word.rstrip(TAIL)
        low = core.lower()
        if core.isalpha() and max(core) < "ɐ" and len(low) == len(core) and (low, core) != (core, word):
            tail = np.frombuffer(self._local(word[len(core):]), "<u4") + np.uint32(len(core)) if len(core) < len(word) else np.zeros(0, "<u4")
            value = self._local(low) + tail.astype("<u4").tobytes()
        else:
            value = np.array(self.library.encode(word, add_special_tokens=False).offsets, "<u4").tobytes()
        if len(self.places) < self.memo_words:
            self.places[word] = value
        return value


def word_encoder(name: str) -> WordEncoder:
    """One encoder per worker process and tokenizer file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(public_tokenizer(name) if "/" not in name else name)
    return _ENCODERS[name]
