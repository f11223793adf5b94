"""Training on every labelled row, and prefixes of whole conversations."""
from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from hiresift.llm import chat, quality


def test_threshold_equals_the_sorted_scan(spark):
    rng = random.Random(3)
    rows = [(round(rng.gauss(y, 1), 1), y) for y in (0, 1) for _ in range(300)]
    order = sorted({s for s, _ in rows})
    wrong = [sum(y for s, y in rows if s <= at) + sum(1 - y for s, y in rows if s > at) for at in order]
    best = int(np.argmin(wrong))
    expected = (order[best] + order[min(best + 1, len(order) - 1)]) / 2
    assert quality.quantile_threshold(spark.createDataFrame(rows, "s double, y int").repartition(5)) == expected


def test_every_labelled_row_is_in_a_pair(spark):
    data = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 450 == 0).cast("int").alias("y"), F.array_repeat(F.col("id").cast("double"), len(quality.FEATURES)).alias("x"))
    rows = quality.grouped(data, {0: 8980, 1: 20}).collect()
    groups = {r.group for r in rows}
    assert len(groups) == 5 and all({r.y for r in rows if r.group == g} == {0, 1} for g in groups)
    assert len([r for r in rows if r.y == 0]) == 8980 and len({r.x[0] for r in rows}) == 9000
    for g in groups:
        mine = [r for r in rows if r.group == g]
        y, z = np.array([r.y for r in mine]), np.array([[r.x[0], 1.0] for r in mine])
        assert len(quality.pairs_of(g, y, z)) == 4 * (y == 0).sum()


def test_training_reads_rows_past_any_sample(spark):
    """21,000 labelled rows: all of them are counted in the model's means."""
    docs = spark.range(21000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good words in a sentence.").otherwise(F.concat(F.lit("bad bad bad "), F.col("id").cast("string"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    model = quality.train(docs, labels, modulus=None)
    every = np.array([quality.features("good words in a sentence." if i % 2 == 0 else f"bad bad bad {i}") for i in range(21000)])
    assert np.allclose(model.mean, every.mean(axis=0), atol=1e-9)
    p = model.score(every)
    assert (p[::2] >= 0.7).all() and (p[1::2] < 0.7).all()


def test_prefixes_are_rendered_though_probes_append(spark):
    """A template whose turns depend on the turn before, which its probes do not show: only prefixes place its texts."""
    def nodding(turns):
        return chat.chatml([(r, t + "!" if k and turns[k - 1][1] == "hush" else t) for k, (r, t) in enumerate(turns)])

    assert chat.appends(nodding)
    rows = spark.createDataFrame([(5, 0, "user", "hush"), (5, 1, "assistant", "well"), (5, 2, "assistant", "then")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(spark, rows, nodding).collect()}
    assert got[5].loss_chars == 8 and got[5].loss_sha256 == hashlib.sha256(b"wellthen").hexdigest() and got[5].n_turns == 3
