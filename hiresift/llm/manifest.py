"""Merkle manifest of a dataset: checkpoint-and-recompute.

A tree joins every 8 consecutive nodes of a level into one, until one is left.  Only every STRIDE-th level is stored:
a stored node stands for an aligned subtree of 8 ** STRIDE nodes of the stored level below.  To extract proofs, each
subtree's missing levels are made again from its stored lowest nodes, the siblings of every one of them are emitted
with those of the subtree's top, and the levels are dropped.  So a task holds one subtree (512 digests), whatever the
size of the dataset or of a language, and no text takes part after its leaf is made.

The forest has a tree for each `lang`; the trees' tops, in order of lang, are the lowest nodes of one more such tree.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hiresift.llm.common import by_arrow, columns, written

FANOUT = 8
STRIDE = 3
PATH = "array<struct<left: string, right: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of one row: `-` for a null, else the value's UTF-8 byte count, a colon and the value."""
    written_out = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*written_out), 256)


def levels_of(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes and `height` levels above them; a run of one still makes a node."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest(*below[i:i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def height_of(n: int, stride: int) -> int:
    """Levels from n nodes of a tree up to its next stored level, or up to its top where that is nearer."""
    height = 0
    while n > 1 and height < stride:
        n, height = -(-n // FANOUT), height + 1
    return height


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of node `at` in its run, level by level up to the last but one."""
    out = []
    for level in levels[:-1]:
        run = at - at % FANOUT
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + FANOUT])))
        at //= FANOUT
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left, node, right)
    return node


def placed(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """`rows` with pos, the place within `tree` by `order`, and n, the tree's size; written once.

    Rows are sorted in ranges of (tree, order) and a running number of the row, so that neither a large tree nor many
    rows of one key make a large task; places come from sums over the ranges.
    """
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "_tie"]
    ordered = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sort = written(ordered.drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    parts = sort.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before, whole = Window.partitionBy("tree").orderBy("_part"), Window.partitionBy("tree")
    bases = parts.select("tree", "_part", "_first", (F.sum("_rows").over(before) - F.col("_rows")).alias("_base"), F.sum("_rows").over(whole).alias("n"))
    return sort.join(bases, ["tree", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_base")).drop("_part", "_at", "_first", "_base")


def subtrees(nodes: DataFrame, span: int, *carried: str) -> DataFrame:
    """A row for each aligned subtree: (tree, block, n, nodes in order with what they carry)."""
    held = F.sort_array(F.collect_list(F.struct("pos", "node", *carried)))
    return nodes.groupBy("tree", (F.col("pos") / span).cast("long").alias("block"), "n").agg(held.alias("nodes"))


def stored_levels(lowest: DataFrame, name: str, stride: int = STRIDE) -> list[DataFrame]:
    """Every stored level of all trees, lowest first: (tree, pos, n, node); each written to the shared folder.

    `n` is the number of nodes that the level has in its tree; a tree that has reached its top stands there only once,
    with n = 1, in the level where it did.
    """
    span = FANOUT ** stride

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                top = levels_of([x["node"] for x in row["nodes"]], height_of(row["n"], stride))[-1]
                out.append({"tree": row["tree"], "pos": row["block"], "n": -(-row["n"] // span), "node": top[0]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())]))

    levels = [lowest]
    while not levels[-1].where("n > 1").isEmpty():  # a level has 1 / 512 of the nodes of the one below
        above = by_arrow(subtrees(levels[-1].where("n > 1"), span), tops, "tree string, pos long, n long, node string")
        levels.append(written(above, f"{name}-level{len(levels) * stride}"))
    return levels


def proofs_of(nodes: DataFrame, above: DataFrame, emit: Callable, schema: str, stride: int, *carried: str) -> DataFrame:
    """`emit` for each subtree of a level, given the paths from the tops of its subtrees up to the root.

    `above` is (tree, pos, path) of the stored level above and, for trees that reached their top here, of that top.
    """
    span = FANOUT ** stride
    blocks = subtrees(nodes, span, *carried)
    return by_arrow(blocks.join(above.withColumnRenamed("pos", "block"), ["tree", "block"]), emit, schema)


def paths_down(levels: list[DataFrame], tops: DataFrame, name: str, stride: int = STRIDE) -> DataFrame:
    """(tree, pos, path) for the tops of the lowest level's subtrees; `tops` is (tree, path) of each tree's top.

    Goes down one stored level at a time; the levels between are made again for one subtree and not kept.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels_again = levels_of([x["node"] for x in row["nodes"]], height_of(row["n"], stride))
                up = [(x["left"], x["right"]) for x in row["path"]]
                out = [{"tree": row["tree"], "pos": x["pos"], "path": [{"left": a, "right": b} for a, b in siblings(levels_again, i) + up]} for i, x in enumerate(row["nodes"])]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))]))

    above = None
    for k in range(len(levels) - 1, 0, -1):
        done = levels[k].where("n = 1").select("tree", "pos").join(tops, "tree")
        below = None if above is None else proofs_of(levels[k].where("n > 1"), above, emit, f"tree string, pos long, path {PATH}", stride)
        above = written(done if below is None else done.unionByName(below), f"{name}-paths{k}")
    lone = levels[0].where("n = 1").select("tree", "pos").join(tops, "tree")  # a tree of one node has no level above
    return lone if above is None else above.unionByName(lone)


def top_nodes(levels: list[DataFrame]) -> DataFrame:
    """(tree, top) of every tree."""
    out = None
    for level in levels:
        tops = level.where("n = 1").select("tree", F.col("node").alias("top"))
        out = tops if out is None else out.unionByName(tops)
    return out


def manifest(docs: DataFrame, tampered: Callable[[Column, Column], Column] | None = None, stride: int = STRIDE, with_proof: bool = False) -> DataFrame:
    """Per row its leaf, its language's subroot, the root, and a proof checked by folding.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified); `with_proof` adds the proof itself, the left
    and right siblings of each level.  `tampered(doc_id, text)` is the text that is folded instead of the row's own.

    A null field is written `-`; null langs make a tree of their own, the first; null ids come first in their tree.
    Rows of one (lang, doc_id) stand in the order of their leaves, equal rows side by side, each with a place of its
    own.  Very long texts only enter a digest.  Columns beside FIELDS are left behind, whatever their names; an empty
    table gives no rows.  Two small tables (levels above the leaves) are read again and again, the texts once.
    """
    fields = [F.col(f) for f in FIELDS]
    doc_id, text = F.col("doc_id"), F.col("text")
    other = text if tampered is None else tampered(doc_id, text)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # "" < "=" + any lang, bytewise
    changed = F.when(~other.eqNullSafe(text), leaf([*fields[:-1], other]))
    rows = columns(docs, *FIELDS).select(tree.alias("tree"), doc_id.cast("long").alias("doc_id"), leaf(fields).alias("node"), changed.alias("other"))
    leaves = placed(written(rows, "manifest-leaves"), "manifest", "doc_id", "node")
    forest = stored_levels(leaves, "manifest", stride)
    subroots = written(top_nodes(forest), "manifest-subroots")

    over = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("top").alias("node")), "manifest-langs", "lang")
    crown = stored_levels(over, "manifest-langs", stride)
    root = top_nodes(crown).first()  # one row, none of an empty table
    end = crown[-1].where("n = 1").select("tree", F.array().cast(PATH).alias("path"))
    crown_paths = proofs_of(over, paths_down(crown, end, "manifest-langs", stride), _lang_paths(stride), f"lang string, path {PATH}", stride, "lang")
    lang_paths = written(crown_paths.select(F.col("lang").alias("tree"), "path"), "manifest-lang-paths")

    above = paths_down(forest, lang_paths, "manifest", stride)
    schema = "tree string, doc_id long, leaf string, proof_sha256 string, folded_root string" + (f", proof {PATH}" if with_proof else "")
    checked = proofs_of(leaves, above, _checked(stride, with_proof), schema, stride, "doc_id", "other")
    facts = checked.join(subroots.withColumnRenamed("top", "subroot"), "tree").withColumn("root", F.lit(root["top"] if root else None).cast("string"))
    last = ["proof"] if with_proof else []
    return facts.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *last)


def _lang_paths(stride: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                again = levels_of([x["node"] for x in row["nodes"]], height_of(row["n"], stride))
                up = [(x["left"], x["right"]) for x in row["path"]]
                out = [{"lang": x["lang"], "path": [{"left": a, "right": b} for a, b in siblings(again, i) + up]} for i, x in enumerate(row["nodes"])]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))]))
    return emit


def _checked(stride: int, with_proof: bool) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                again = levels_of([x["node"] for x in row["nodes"]], height_of(row["n"], stride))
                up = [(x["left"], x["right"]) for x in row["path"]]
                upper = "".join(a + b for a, b in up)
                out = {k: [] for k in ("tree", "doc_id", "leaf", "proof_sha256", "folded_root")} | ({"proof": []} if with_proof else {})
                for i, x in enumerate(row["nodes"]):
                    own = siblings(again, i)
                    out["tree"].append(row["tree"])
                    out["doc_id"].append(x["doc_id"])
                    out["leaf"].append(x["node"])
                    out["proof_sha256"].append(digest(*(a + b for a, b in own), upper))
                    out["folded_root"].append(fold(x["other"] or x["node"], own + up))
                    if with_proof:
                        out["proof"].append([{"left": a, "right": b} for a, b in own + up])
                arrays = {k: pa.array(v, pa.int64() if k == "doc_id" else pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])) if k == "proof" else pa.string()) for k, v in out.items()}
                yield pa.RecordBatch.from_pydict(arrays)
    return emit


def lower_cased_thirds(doc_id: Column, text: Column) -> Column:
    """The given tampering: where 3 divides the id's crc32, A-Z become a-z."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False)), F.translate(text, upper, lower)).otherwise(text)


_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
_SHIFT = "list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"


def _encoded(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _levels(name: str, start: str, most: int) -> str:
    """`most` levels over `start`(tree, pos, node, low): a tree that has one node left goes no further."""
    out = [f"{name}0 AS (SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS n FROM {start})"]
    for k in range(1, most + 1):
        out.append(f"{name}{k} AS (SELECT tree, pos, node, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, pos // 8 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {name}{k - 1} WHERE n > 1 GROUP BY 1, 2))")
    return ",\n ".join(out)


def _sides(name: str, k: int) -> str:
    """Left and right siblings of every node of level k."""
    frame = "PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN"
    return f"(SELECT tree, pos, coalesce(string_agg(node, '') OVER ({frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') OVER ({frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)"


def oracle(levels: int = 7, crown: int = 2) -> str:
    """DuckDB SQL of the given query for trees of up to 8 ** levels rows and 8 ** crown languages."""
    sides = [(f"{name}{k}", name, k, tree, pos) for name, most, tree, pos in (("t", levels, "o.tree", "o.pos"), ("c", crown, "''", "o.place")) for k in range(most)]
    joins = " ".join(f"LEFT JOIN {_sides(name, k)} s{at} ON s{at}.tree = {tree} AND s{at}.pos = {pos} // {8 ** k}" for at, name, k, tree, pos in sides)
    inner = "SELECT o.*, " + ", ".join(f"s{at}.l AS l{at}, s{at}.r AS r{at}" for at, *_ in sides) + f" FROM o {joins}"
    for at, *_ in sides:  # one fold for each nested select
        inner = f"SELECT * EXCLUDE (other), CASE WHEN l{at} IS NULL THEN other ELSE sha256(l{at} || other || r{at}) END AS other FROM ({inner})"
    whole = " || ".join(f"coalesce(l{at} || r{at}, '')" for at, *_ in sides)
    body = [_encoded(c) for c in FIELDS]
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tops = " UNION ALL ".join(f"SELECT tree, node FROM t{k} WHERE n = 1" for k in range(levels + 1))
    roots = " UNION ALL ".join(f"SELECT node FROM c{k} WHERE n = 1" for k in range(crown + 1))
    return f"""WITH ct AS (SELECT {_SHIFT} AS tab),
 d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {' || '.join(body)} AS plain, {' || '.join([*body[:-1], _encoded(lowered)])} AS other,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) AS crc FROM documents, ct),
 h AS (SELECT doc_id, tree, sha256(plain) AS leaf, CASE WHEN crc % 3 = 0 THEN sha256(other) ELSE sha256(plain) END AS other FROM d),
 p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
 s AS (SELECT tree, pos, leaf AS node FROM p),
 {_levels('t', 's', levels)},
 sub AS ({tops}),
 lp AS (SELECT tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS pos, node FROM sub),
 cs AS (SELECT '' AS tree, pos, node FROM lp),
 {_levels('c', 'cs', crown)},
 top AS ({roots}),
 o AS (SELECT p.*, lp.pos AS place, lp.node AS subroot, top.node AS root FROM p JOIN lp ON lp.lang = p.tree, top)
 SELECT doc_id, leaf, subroot, root, sha256({whole}) AS proof_sha256, other AS folded_root, other = root AS verified FROM ({inner})"""
