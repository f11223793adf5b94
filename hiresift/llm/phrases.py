"""Phrases that occur together: Rabin-Karp fingerprints of every run of words.

A task reads its texts in blocks of bytes.  Prefix sums of byte values times powers of a base give every word's
fingerprint by one subtraction, prefix sums over the words' fingerprints give every run's.  Only fingerprints are
counted over the corpus at first: of one and two words, then length by length of runs whose two shorter runs are
frequent, so that a phrase's text is not written before the phrase is known to be frequent.  Which fingerprints are
frequent goes to the tasks as a bitmap of fixed size: it never misses one, and what it lets through too much is
dropped at the end.

A last pass holds the frequent runs against the text.  In a block, each word is compared byte by byte with the
first word of its fingerprint and each run word by word with the run that its fingerprint points to; runs that differ
get entries of their own.  An entry is a pointer to an occurrence with the text that stands there and a count, and
entries are added up by text, so that two phrases of one fingerprint never share a count.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiresift.llm.common import by_arrow, columns, small_batches, written

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2000
SHARE = 50  # percent of a phrase's occurrences inside one longer phrase, from which on it is dropped
MAP_BITS = 27  # 16 MB, whatever the corpus
BLOCK = 4 << 20
SALTS = 64
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(GAPS)], KIND[list(BREAKS)] = 1, 2
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
GAP_OR_BREAK, MANY_GAPS = re.compile(rb"[ \t.,;:!?\n-\r]"), re.compile(rb"[ \t]+")
BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit: sums modulo 2**64 are weak in their low bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2**64; kept for as long as a block."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if len(known) <= BLOCK + (1 << 16):
            _POWERS[int(base)] = known
    return known[:n]


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial of values[start:end] for each start, all lifted to the same power."""
    power = powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * power[len(values) - starts]


def lifted(fingerprint: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """The same value for the same run in blocks of any length: the common power taken out again."""
    inverse = pow(int(base), -length, 1 << 64)
    return fingerprint * np.uint64(inverse)


@dataclass
class Block:
    """Texts of a task, end to end with a line break between them, and their words."""
    raw: bytes
    doc_of_word: np.ndarray
    seed: np.ndarray
    piece: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word: np.ndarray
    counted: int  # words before this one were counted with the window before

    def grams(self, m: int) -> np.ndarray:
        """First words of all runs of m words in one piece."""
        at = np.arange(max(len(self.starts) - m + 1, 0))
        at = at[max(self.counted - m + 1, 0):]
        return at[self.piece[at] == self.piece[at + m - 1]]

    def fingerprints(self, at: np.ndarray, m: int) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.uint64)
        sums = lifted(runs(self.word, at, at + m, WORD_BASE), len(self.word), WORD_BASE)
        return mix(sums + self.seed[self.doc_of_word[at]] + np.uint64(m))


def block_of(texts: list[bytes], seeds: list[int], counted: int) -> Block:
    low = b"\n".join(texts).translate(LOWER)
    raw = np.frombuffer(low, np.uint8)
    kind = KIND[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    doc_ends = np.cumsum([len(t) + 1 for t in texts])
    word = mix(lifted(runs(VALUES[raw], starts, ends, BASE), len(raw), BASE) + (ends - starts).astype(np.uint64)) if len(raw) else np.zeros(0, np.uint64)
    return Block(low, np.searchsorted(doc_ends, starts, side="right"), np.array(seeds, np.uint64), piece, starts, ends, word, counted)


def windows(text: bytes, size: int, context: int) -> Iterator[tuple[bytes, int]]:
    """(part, words at its start that the part before has counted) of a text too long for one block.

    Parts end between words, and begin with the last `context` words of the piece that the part before ended in.
    """
    begin, counted, at = 0, 0, 0
    while True:
        found = GAP_OR_BREAK.search(text, at + size) if at + size < len(text) else None
        cut = found.start() if found else len(text)
        yield text[begin:cut], counted
        if cut == len(text):
            return
        at = begin = cut
        counted, floor = 0, max(text.rfind(bytes([b]), 0, cut) for b in BREAKS) + 1
        while counted < context:
            end = begin
            while end > floor and text[end - 1] in GAPS:
                end -= 1
            if end <= floor:
                break
            begin, counted = max(floor, text.rfind(b" ", floor, end) + 1, text.rfind(b"\t", floor, end) + 1), counted + 1


def blocks(batches: Iterator[pa.RecordBatch], size: int, context: int) -> Iterator[tuple[Block, list[int], list[str]]]:
    """(block, doc_id and lang of each of its texts) of a task's rows (doc_id, lang, text)."""
    def seeded(texts: list[bytes], ids: list[int], langs: list[str], counted: int = 0):
        seed = {lang: xxhash.xxh64_intdigest(lang) for lang in set(langs)}
        return block_of(texts, [seed[x] for x in langs], counted), ids, langs

    held, weight = [], 0
    for batch in small_batches(batches, 200):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for doc_id, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts, strict=True):
            text = text or b""
            if len(text) > size:
                for part, counted in windows(text, size, context):
                    yield seeded([part], [doc_id], [lang], counted)
                continue
            held.append((text, doc_id, lang))
            weight += len(text)
            if weight >= size:
                yield seeded(*map(list, zip(*held, strict=True)))
                held, weight = [], 0
    if held:
        yield seeded(*map(list, zip(*held, strict=True)))


class Bitmap:
    """Which fingerprints may be frequent: one bit for the top `bits` bits of a fingerprint."""

    def __init__(self, bits: int, data: bytes):
        self.shift, self.data = np.uint64(64 - bits), np.frombuffer(data, np.uint8)

    def has(self, fingerprints: np.ndarray) -> np.ndarray:
        slot = (fingerprints >> self.shift).astype(np.int64)
        return (self.data[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(fingerprints: DataFrame, bits: int) -> bytes:
    """Bits of a column `fp`, put together on the executors; 2 ** bits bits reach the driver, however many rows there are."""
    slot = F.shiftrightunsigned("fp", 64 - bits) + 1
    rows = fingerprints.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
    for row in rows.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def frequent(docs: DataFrame, lengths: tuple[int, ...], known: Bitmap | None, min_count: int, block: int, context: int, name: str) -> DataFrame:
    """(fp) of runs of `lengths` words that occur often enough, of those whose two shorter runs are in `known`."""
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, *_ in blocks(batches, block, context):
            found = []
            for m in lengths:
                at = held.grams(m)
                if shared is not None:
                    at = at[shared.value.has(held.fingerprints(at, m - 1))]
                    at = at[shared.value.has(held.fingerprints(at + 1, m - 1))]
                found.append(held.fingerprints(at, m))
            fp, hits = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"fp": fp.view(np.int64), "hits": hits.astype(np.int64)})

    entries = by_arrow(docs, count, "fp long, hits long")
    return written(entries.groupBy("fp").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= min_count).select("fp"), name)


def same_words(held: Block) -> np.ndarray:
    """For each word the number of the first word in the block with the same bytes: fingerprints, held against the text."""
    _, first, of = np.unique(held.word, return_index=True, return_inverse=True)
    rep = first[of]
    size = held.ends - held.starts
    raw = np.frombuffer(held.raw, np.uint8)
    differ = size != size[rep]
    for lo in range(0, len(rep), 1 << 18):
        part = slice(lo, lo + (1 << 18))
        n = np.where(differ[part], 0, size[part])
        own = np.repeat(held.starts[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        unlike = raw[own] != raw[own + np.repeat(held.starts[rep[part]] - held.starts[part], n)]
        if unlike.any():
            differ[lo + np.repeat(np.arange(len(n)), n)[unlike]] = True
    if differ.any():  # words that share a fingerprint: told apart by their bytes
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(of, np.unique(of[differ]))).tolist():
            rep[i] = seen.setdefault(held.raw[held.starts[i]:held.ends[i]], i)
    return rep


def entries_of(held: Block, at: np.ndarray, fp: np.ndarray, m: int, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence, hits) of each distinct run among `at`: runs of one fingerprint whose words differ are kept apart."""
    order = np.argsort(fp, kind="stable")
    at, fp = at[order], fp[order]
    new = np.ones(len(at), bool)
    new[1:] = fp[1:] != fp[:-1]
    group = np.cumsum(new) - 1
    pointer = at[new][group]
    unlike = np.zeros(len(at), bool)
    for k in range(m):
        unlike |= rep[at + k] != rep[pointer + k]
    if unlike.any():
        words = np.stack([group, *(rep[at + k] for k in range(m))])
        order = np.lexsort(words[::-1])
        at, words = at[order], words[:, order]
        new = np.ones(len(at), bool)
        new[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
    edges = np.append(np.flatnonzero(new), len(at))
    return at[edges[:-1]], np.diff(edges)


def counted_phrases(docs: DataFrame, known: Bitmap, max_words: int, min_count: int, block: int) -> DataFrame:
    """(lang, words, phrase, f, doc_id) of every phrase that occurs often enough, and with 0 words each lang's word count."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def texts_at(held: Block, pointer: np.ndarray, m: int) -> list[bytes]:
        begin, end = held.starts[pointer], held.ends[pointer + m - 1]
        plain, raw = np.ones(len(pointer), bool), np.frombuffer(held.raw, np.uint8)
        for k in range(1, m):  # words one blank apart stand there as the phrase is written
            gap = held.ends[pointer + k - 1]
            plain &= (held.starts[pointer + k] - gap == 1) & (raw[gap] == 32)
        out = [held.raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        for i in np.flatnonzero(~plain).tolist():
            out[i] = MANY_GAPS.sub(b" ", out[i])
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, doc_ids, langs in blocks(batches, block // 2, max_words - 1):
            if not len(held.starts):
                continue
            rep, lang_of, id_of = same_words(held), pa.array(langs, pa.string()), pa.array(doc_ids, pa.int64())
            words = np.bincount(held.doc_of_word[held.counted:], minlength=len(langs))
            yield pa.RecordBatch.from_pydict({"lang": lang_of, "words": np.zeros(len(langs), np.int32), "phrase": pa.array([""] * len(langs)), "hits": words.astype(np.int64), "doc_id": id_of})
            for m in range(1, max_words + 1):
                at = held.grams(m)
                fp = held.fingerprints(at, m)
                keep = shared.value.has(fp)
                pointer, hits = entries_of(held, at[keep], fp[keep], m, rep)
                doc = pa.array(held.doc_of_word[pointer])
                phrase = pa.array(texts_at(held, pointer, m), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict({"lang": lang_of.take(doc), "words": np.full(len(pointer), m, np.int32), "phrase": phrase, "hits": hits.astype(np.int64), "doc_id": id_of.take(doc)})

    # words, runs and their texts are held at once here: blocks of half the size
    entries = by_arrow(docs, count, "lang string, words int, phrase string, hits long, doc_id long")
    added = entries.groupBy("lang", "words", "phrase").agg(F.sum("hits").alias("f"), F.min("doc_id").alias("doc_id"))
    return added.where((F.col("f") >= min_count) | (F.col("words") == 0))


def scored(counts: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, first_doc_id) of the candidates that stay, by their lowest-scoring cut.

    Scores are whole numbers in decimals of 38 digits: counts up to 10 ** 14 give them exactly.
    """
    long = counts.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), "doc_id")
    word = F.split("phrase", " ")
    def joined(first, length):
        return F.array_join(F.slice(word, first, length), " ")

    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    known = counts.where("words >= 1").select("lang", "phrase", "f")
    cuts = cuts.join(known.toDF("lang", "head", "l"), ["lang", "head"]).join(known.toDF("lang", "tail", "r"), ["lang", "tail"])
    score = F.expr("(CAST(a AS DECIMAL(14, 0)) * CAST(a AS DECIMAL(14, 0)) * CAST(1000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(14, 0)) * CAST(r AS DECIMAL(14, 0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "doc_id").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = long.where("words >= 3").select("lang", "a", "words", word.alias("word"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "word", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("at"))
    longer = inner.groupBy("lang", F.array_join(F.slice("word", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True)))
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return kept.join(n, "lang").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), F.col("doc_id").alias("first_doc_id"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, share: int = SHARE, map_bits: int = MAP_BITS, block: int = BLOCK) -> DataFrame:
    """Each lang's `top` phrases of 2 to `max_words` words: (lang, rank, phrase, a, l, r, n, score, first_doc_id).

    A null text is empty, a null lang is `und`; repeated rows and ids count as often as they stand; very long texts
    are read in parts that overlap by the words a phrase can span; columns of other names are left behind; no phrase
    is frequent in an empty table, which gives no rows.  Ties are ordered by a, then by the phrase's bytes.
    first_doc_id is the least id of a document in which the phrase stands, null if only rows without an id have it.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    given = columns(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    context = max_words - 1
    found = frequent(given, (1, 2), None, min_count, block, context, "phrases-12")
    latest = every = found
    for m in range(3, max_words + 1):
        latest = frequent(given, (m,), Bitmap(map_bits, bitmap_of(latest, map_bits)), min_count, block, context, f"phrases-{m}")
        every = every.unionByName(latest)
    counts = written(counted_phrases(given, Bitmap(map_bits, bitmap_of(every, map_bits)), max_words, min_count, block), "phrases-counts")
    phrases = scored(counts, share)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc_id")


def oracle(min_count: int = MIN_COUNT, top: int = TOP, share: int = SHARE) -> str:
    """DuckDB SQL of the given query, for phrases of two and three words."""
    return f"""WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT doc_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 g AS (SELECT doc_id, lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS m) x),
 c AS (SELECT lang, m, phrase, count(*) AS f, min(doc_id) AS doc_id FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {min_count}),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
 k AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE m >= 2),
 cut AS (SELECT k.*, x.k, array_to_string(w[1:x.k], ' ') AS head, array_to_string(w[x.k + 1:m], ' ') AS tail FROM k JOIN (SELECT unnest([1, 2]) AS k) x ON x.k < k.m),
 s AS (SELECT cut.lang, cut.phrase, cut.f AS a, cut.doc_id, cut.k, h.f AS l, t.f AS r, CAST(CAST(cut.f AS HUGEINT) * cut.f * 1000000 // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score FROM cut JOIN c h ON h.lang = cut.lang AND h.phrase = cut.head JOIN c t ON t.lang = cut.lang AND t.phrase = cut.tail),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 o AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, array_to_string(w[1:2], ' ') AS phrase FROM k WHERE m = 3 UNION ALL SELECT lang, f, array_to_string(w[2:3], ' ') FROM k WHERE m = 3) x GROUP BY 1, 2),
 r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * o.f < {share} * a)
 SELECT r.lang, rank, phrase, a, l, r, n, score, doc_id AS first_doc_id FROM r JOIN n ON n.lang = r.lang WHERE rank <= {top}"""
