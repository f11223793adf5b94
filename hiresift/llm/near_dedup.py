"""Near copies by Order MinHash: sketches of sampled shingles in text order, verified by banded alignment.

A text's k-mers are its five-word shingles, each labelled with how often it occurred before.  A sketch is the `PICK`
k-mers of the smallest hashes under one hash function, in the order in which they stand in the text; two texts of
similarity s agree on one with probability s ** PICK or less, less if their order differs.  Texts that agree on a sketch
are candidates, and candidates are linked if the alignment of their k-mer sequences within a band matches
matched / (a + b - matched) >= SIMILARITY of them: a Jaccard similarity that follows the order.

Exact copies are one node from the start.  A group of candidates is not expanded into pairs: its members are first
verified against one of them, another in each group, and the links are joined to components; members that are still
apart are verified against the one that shares most of their sketches.  Only members of different components are then
compared, all of them, in blocks, by their `SAMPLE` smallest k-mers: a pair is verified once, in the first group
that it shares, if the Jaccard similarity of the samples isn't too small.  The samples of texts of up to SAMPLE k-mers
are whole and so is the comparison; longer ones are given four standard deviations.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import WORD, by_arrow, columns, small_batches, text_of, written
from hiresift.llm.components import components

K = 5
SKETCHES = 20
PICK = 3
SIMILARITY = 0.8
SAMPLE = 512
#: members of a group of candidates that one task compares with as many others
BLOCK = 512
#: sketches that a member shares with the one it is verified against before all pairs are compared
CLOSE = 6
MEMO_WORDS = 50_000
ODD = np.random.default_rng(11).integers(1 << 62, (1 << 63) - 1, (3, max(SKETCHES, K, PICK)), np.int64).astype(np.uint64) | np.uint64(1)


class _Hashes(dict):
    """64-bit hash of a word, remembered for the words seen first."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO_WORDS:
            self[word] = value
        return value


HASHES = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def kmers(text: str) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles in text order; fewer than K words make one shingle, none make none."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - K + 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(K, len(h))):
        s += h[j:j + n] * ODD[0, j]
    s = mixed(s)
    order = np.argsort(s, kind="stable")
    run = np.append(True, s[order][1:] != s[order][:-1])
    starts = np.flatnonzero(run)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = np.arange(n) - starts[np.cumsum(run) - 1]
    return mixed(s + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketches(s: np.ndarray) -> np.ndarray:
    """SKETCHES signed 64-bit values; the number of the hash function enters each.

    A text of fewer k-mers than PICK repeats its last one.
    """
    values = s[None, :] * ODD[1, :SKETCHES, None]
    values ^= values >> np.uint64(32)
    if len(s) > PICK:
        picked = np.sort(np.argpartition(values, PICK - 1, axis=1)[:, :PICK], axis=1)
    else:
        picked = np.tile(np.minimum(np.arange(PICK), len(s) - 1), (SKETCHES, 1))
    return mixed((s[picked] * ODD[2, :PICK]).sum(axis=1, dtype=np.uint64) + ODD[1, :SKETCHES]).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Similarity of two sequences by their longest common subsequence within the band that `similarity` allows.

    Similar enough sequences have at most d unmatched items, so their alignment never leaves the diagonal by more than
    d.  Rows are bit vectors of the band's columns: a zero bit is a column where one more item is matched.
    """
    if not len(a) or not len(b):
        return 0.0
    total = len(a) + len(b)
    least = similarity * total / (1 + similarity)
    if min(len(a), len(b)) < least - 1e-9:
        return 0.0
    x, y = a.tolist(), b.tolist()
    at = {}
    for i, v in enumerate(x):
        at.setdefault(v, []).append(i)
    if sum(map(at.__contains__, y)) < least - 1e-9:
        return 0.0
    d = int(total - 2 * least) + 1
    width = 2 * d + 1
    top, mask = 1 << (width - 1), (1 << width) - 1
    v, matched = mask, 0
    for j, item in enumerate(y):
        low = j - d  # the band's first column
        m = 0
        for i in at.get(item, ()):
            if 0 <= i - low < width:
                m |= 1 << (i - low)
        if m:
            v = ((v + (v & m)) | (v & ~m)) & mask
        matched += not v & 1
        v = (v >> 1) | top
    matched += width - v.bit_count()
    return matched / (total - matched)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, the text's 128-bit name (h, g), k-mer count n, sketches, samples and k-mers (low 32 bits) of every document."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = text_of(batch.column("text"))
            all_kmers = [kmers(t) for t in texts]
            samples = [np.sort(k.astype("<u4"))[:SAMPLE].tobytes() for k in all_kmers]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "h": batch.column("h"), "g": batch.column("g"), "n": pa.array([len(s) for s in all_kmers], pa.int32()), "sketches": pa.array([sketches(k) if len(k) else [] for k in all_kmers], pa.list_(pa.int64())), "samples": pa.array(samples, pa.binary()), "kmers": pa.array([s.astype("<u4").tobytes() for s in all_kmers], pa.binary())})

    text = F.coalesce(F.col("text"), F.lit(""))
    named = columns(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text, F.length(text)).alias("g"))
    return by_arrow(named, apply, "doc_id long, h long, g long, n int, sketches array<long>, samples binary, kmers binary")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, salt) whose alignment reaches the similarity.

    A text may stand in very many pairs: its k-mers are copied once for each salt of its pairs and meet them by text
    and salt, so that no text is one key.
    """
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = [aligned(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4"), similarity) >= similarity - 1e-9 for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def copies(side: str, kmers: str) -> DataFrame:
        wanted = pairs.select(F.col(side).alias("node"), "salt").distinct()
        return wanted.join(texts, "node").select(F.col("node").alias(side), "salt", F.col("kmers").alias(kmers))

    sides = pairs.join(copies("a", "x"), ["a", "salt"]).join(copies("b", "y"), ["b", "salt"])
    return by_arrow(sides.select("a", "b", "x", "y"), apply, "a long, b long")


def rivals(cell: list[dict], similarity: float) -> list[tuple[int, int]]:
    """The pairs of a cell that are worth verifying: of different components and similar lengths, whose first common
    sketch is the cell's own and whose samples are alike.  Members of the largest component are no rivals."""
    component, n = np.array([r["component"] for r in cell]), np.array([r["n"] for r in cell])
    names, counts = np.unique(component, return_counts=True)
    main = names[np.argmax(counts)]
    rest = np.flatnonzero(component != main)
    if not len(rest):
        return []
    node, side = np.array([r["node"] for r in cell]), np.array([r["side"] for r in cell])
    marks = np.array([r["sketches"] for r in cell], np.int64)
    samples = [np.frombuffer(r["samples"], "<u4") for r in cell]
    size = np.array(list(map(len, samples)))
    values = np.full((len(cell), SAMPLE), 1 << 33, np.int64)
    for k, x in enumerate(samples):
        values[k, :len(x)] = x
    reach = np.where(size < n, values[np.arange(len(cell)), size - 1], 1 << 32)  # what a sample says nothing beyond
    at, crossed, out = cell[0]["function"], side.min() != side.max(), []
    for i in rest.tolist():
        fit = (component != component[i]) & ((component == main) | (node > node[i])) & (n * (similarity - 1e-9) <= n[i]) & (n[i] * (similarity - 1e-9) <= n)
        if crossed:
            fit &= side != side[i]
        others = np.flatnonzero(fit)
        others = others[np.argmax(marks[others] == marks[i], axis=1) == at] if len(others) else others
        if not len(others):
            continue
        own, theirs = values[i, :size[i]], values[others]
        upto = np.minimum(reach[i], reach[others])
        within = theirs <= upto[:, None]
        both = (within & (own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs)).sum(axis=1)
        union = within.sum(axis=1) + np.searchsorted(own, upto, "right") - both
        margin = np.where(upto >= 1 << 32, 1e-9, 4 * np.sqrt(similarity * (1 - similarity) / np.maximum(union, 1)))
        out += [(min(int(node[i]), k), max(int(node[i]), k)) for k in node[others[both >= (similarity - margin) * union]].tolist()]
    return out


def closest(cell: list[dict]) -> list[tuple[int, int]]:
    """Each member outside the largest component with the one of another component that shares most of its sketches, if
    at least CLOSE: a pair for a member, most of which are links."""
    component, node = np.array([r["component"] for r in cell]), np.array([r["node"] for r in cell])
    names, counts = np.unique(component, return_counts=True)
    marks = np.array([r["sketches"] for r in cell], np.int64)
    out = set()
    for i in np.flatnonzero(component != names[np.argmax(counts)]).tolist():
        shared = np.where(component != component[i], (marks == marks[i]).sum(axis=1), 0)
        if shared[k := int(np.argmax(shared))] >= CLOSE:
            out.add((min(int(node[i]), int(node[k])), max(int(node[i]), int(node[k]))))
    return sorted(out)


def by_cell(cells: DataFrame, find: Callable[[list[dict]], list[tuple[int, int]]]) -> DataFrame:
    """Pairs (a, b, salt) that `find` makes of each cell (sketch, low, high), the salt naming the cell; a task holds one
    cell at a time."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cell: list[dict]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if (found := find(cell)) else ((), ())
            salt = xxhash.xxh3_64_intdigest(repr(now)) >> 1
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "salt": pa.array([salt] * len(a), pa.int64())})

        cell, now = [], None
        for batch in small_batches(batches):
            for row in batch.to_pylist():
                if cell and (row["sketch"], row["low"], row["high"]) != now:
                    yield pairs(cell)
                    cell = []
                now = (row["sketch"], row["low"], row["high"])
                cell.append(row)
        if cell:
            yield pairs(cell)

    return by_arrow(cells.repartition("sketch", "low", "high").sortWithinPartitions("sketch", "low", "high"), apply, "a long, b long, salt long")


def blocked(members: DataFrame, block: int) -> DataFrame:
    """Members with the number of their group's blocks, of about `block` members each, and their own block."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    return members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", "sketch"), F.col("blocks")).cast("int"))


def closest_pairs(members: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b, salt) of `closest`, each block of a group for itself, from members (sketch, node, component, size, sketches)."""
    cells = blocked(members, block).select("sketch", F.col("own").alias("low"), F.col("own").alias("high"), "node", "component", "sketches")
    return by_cell(cells, closest).groupBy("a", "b").agg(F.min("salt").alias("salt"))


def rival_pairs(members: DataFrame, similarity: float, block: int) -> DataFrame:
    """Pairs (a, b, salt) of `rivals`, from members (sketch, function, node, n, component, size, sketches, samples).

    A group of more than `block` members is dealt into blocks, and each pair of its blocks is a cell.
    """
    dealt = blocked(members, block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    cells = dealt.select("sketch", "low", "high", (F.col("own") == F.col("high")).cast("int").alias("side"), "function", "node", "n", "component", "sketches", "samples")
    return by_cell(cells, lambda cell: rivals(cell, similarity))


def split_groups(grouped: DataFrame, parts: DataFrame) -> DataFrame:
    """Members, with their components, of the groups that hold several components and more than the pair verified first."""
    placed = grouped.where("size > 2").join(parts, "node", "left").select("sketch", "function", "node", "n", "size", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("sketch").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("sketch")
    return placed.join(split, "sketch")


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components that links make of earlier ones."""
    return components(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id and class size of every document: one row for each row of `docs`.

    The class id is the smallest id of the class.  Exact copies share a class whatever their length; texts without a
    word (empty or null among them) are near nothing but their exact copies.  Rows of one id are one document and share
    a class; rows without an id are classed by their text, alone under a hash of it.
    """
    rows = written(sketched(docs), "sketches")
    names = written(rows.groupBy("h", "g").agg(F.coalesce(F.min("doc_id"), F.min("h")).alias("node")), "text-names")
    nodes = rows.select("h", "g", "doc_id").join(names, ["h", "g"])
    signed = rows.where("n > 0").select("h", "g", "n", "sketches", "samples").dropDuplicates(["h", "g"]).join(names, ["h", "g"])
    member = signed.select("node", "n", F.posexplode("sketches").alias("function", "sketch"))
    heads = member.groupBy("sketch").agg(F.min_by("node", F.xxhash64("node", "sketch")).alias("head"), F.count("*").alias("size")).where("size > 1")
    grouped = written(member.join(heads, "sketch"), "sketch-groups")
    share = F.when(F.col("size") > block, F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block))).otherwise(0)
    stars = grouped.where("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"), share.alias("salt"))
    near = written(stars.groupBy("a", "b").agg(F.max("salt").alias("salt")), "stars")
    wanted = names.join(grouped.select("node").distinct(), "node", "left_semi")
    kept = written(rows.where("n > 0").select("h", "g", "kmers").join(wanted, ["h", "g"]).dropDuplicates(["h", "g"]).select("node", "kmers"), "candidate-texts")
    links = written(verified(near, kept, similarity), "links")

    parts = written(components(links), "components")
    first = split_groups(grouped, parts).join(signed.select("node", "sketches"), "node")
    likely = written(closest_pairs(first, block).join(near, ["a", "b"], "left_anti"), "closest")
    parts = written(joined(parts, verified(likely, kept, similarity)), "components")
    members = split_groups(grouped, parts).join(signed.select("node", "sketches", "samples"), "node")
    tried = near.select("a", "b").unionByName(likely.select("a", "b"))
    rest = written(rival_pairs(members, similarity, block).join(tried, ["a", "b"], "left_anti"), "rivals")
    classes = joined(parts, verified(rest, kept, similarity)).select("node", F.col("component").alias("class_id"))
    out = nodes.select("doc_id", "node").join(classes, "node", "left").select("doc_id", F.coalesce("class_id", "node").alias("class_id"))
    sizes = out.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return out.join(sizes, "class_id").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each class, with the columns they came with.

    The document of the smallest id stays; of rows that repeat its id one stays; rows without an id stay.
    """
    classes = near_copies(docs.select("doc_id", "text"))
    dropped = written(classes.where("doc_id <> class_id").select("doc_id").distinct(), "dropped")
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
