"""The Merkle manifest against a plain tree, its proofs folded by hand, and its SQL."""
from __future__ import annotations

import hashlib
import zlib

import pytest

from hiresift.llm import manifest, queries
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def plain_tree(nodes):
    """(top, proof of each node)"""
    proofs = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p - p % 8
            proofs[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1:run + 8])))
        nodes, at = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], proofs


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    out, tops, paths = [], [], {}
    for lang in langs:
        own = sorted(trees[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        top, proofs = plain_tree([plain_leaf(r, r["text"]) for r in own])
        tops.append(top)
        paths[lang] = (top, list(zip(own, proofs, strict=True)))
    root, upper = plain_tree(tops)
    for lang, up in zip(langs, upper, strict=True):
        top, members = paths[lang]
        for r, proof in members:
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = plain_leaf(r, text)
            for a, b in proof + up:
                node = h(a, node, b)
            out.append((r["doc_id"], plain_leaf(r, r["text"]), top, root, h(*(a + b for a, b in proof + up)), node, node == root))
    return sorted(out, key=str)


def given(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, pos int")


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_manifest_equals_a_plain_tree(spark, stride):
    long = "Word " * 50_000
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(700)] + [(i, None, None, None, "É" if i % 2 else None) for i in range(9)]
    rows += [(5000, "s", "de", 3, "lone"), (6000, "s", "fr", 0, ""), (6001, "s", "fr", 1, long), (None, "s", "fr", 2, "no id"), (None, "s", "fr", 2, "No id")]
    rows += [(7000, "s", "é", 1, "Twice")] * 3 + [(7000, "s", "é", 1, "Other")]
    rows += [(8000 + i, "s", f"lang{i}", 1, "A") for i in range(12)]
    names = ("doc_id", "source", "lang", "n_chars", "text")
    got = manifest.manifest(given(spark, rows), manifest.lower_cased_thirds, stride)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest([dict(zip(names, r, strict=True)) for r in rows])


def test_proofs_fold_to_the_root_and_tampering_shows(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"Text {i}") for i in range(100)]
    whole = manifest.manifest(given(spark, rows), with_proof=True).collect()
    assert all(r.verified for r in whole) and len({r.root for r in whole}) == 1
    assert all(manifest.fold(r.leaf, [(p.left, p.right) for p in r.proof]) == r.root for r in whole)
    assert all(h(*(p.left + p.right for p in r.proof)) == r.proof_sha256 for r in whole)
    bad = {r.doc_id for r in manifest.manifest(given(spark, rows), manifest.lower_cased_thirds).collect() if not r.verified}
    assert bad == {i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 0}


def test_empty_table_and_one_row(spark):
    assert manifest.manifest(given(spark, [(1, "s", "en", 1, "a")]).limit(0)).count() == 0
    one = manifest.manifest(given(spark, [(1, "s", "en", 1, "a")])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h("")


def test_query_equals_its_sql(spark):
    ok, note = compare(spark, connect(SF), SF, "op11", queries.op11_merkle_manifest, queries.ORACLES["op11_merkle_manifest"])
    assert ok, note
