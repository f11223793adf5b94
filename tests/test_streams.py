"""Streams drained slice by slice against batch forms: revived keys, late rows, runs that go on, replayed batches."""
from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hiresift.streaming import jobs

SCHEMA = "ts timestamp, event_id long, app_id long, outcome string, notes string"
DAY0 = datetime(2024, 1, 1)


def event(i, app, hours, outcome="pending", notes=None):
    return (DAY0 + timedelta(hours=hours), i, app, outcome, notes)


def drained(spark, tmp_path, slices, drain):
    """Land slice after slice and drain each before the next."""
    folder, at, out = str(tmp_path / "in"), jobs.Place(str(tmp_path / "out"), str(tmp_path / "state")), None
    for rows in slices:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
        out = drain(jobs.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, "*.parquet"), at)
    return out


def plain_runs(rows, days, until):
    out = []
    for app in {r[2] for r in rows}:
        own = sorted(r for r in rows if r[2] == app)
        for i, r in enumerate(own):
            last = i + 1 == len(own)
            if (own[i + 1][0] - r[0] > timedelta(days=days)) if not last else (r[0] + timedelta(days=days) <= until):
                out.append((app, r[0], "ghosted" if r[3] == "pending" else r[3]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_ghost_timers_equal_the_batch_form(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [event(i, rng.randrange(6), rng.randrange(24 * 40), rng.choice(("pending", "interview"))) for i in range(70)]
    rows = sorted({(r[0], r[2]): r for r in rows}.values())
    slices = [rows[:30], rows[30:45], rows[45:46], rows[46:]]
    out = drained(spark, tmp_path, slices, lambda s, at: jobs.run_stateful(jobs.stream_ghost_timeout(s, days=3, delay="1 hour"), "g", at))
    got = sorted((r.app_id, r.last_ts, r.outcome) for r in out.collect())
    assert got == plain_runs(rows, 3, max(r[0] for r in rows) - timedelta(hours=1))
    assert all(r.closed_at == r.last_ts + timedelta(days=3) for r in out.collect())


def test_a_timer_fires_between_batches_and_the_key_comes_back(spark, tmp_path):
    slices = [[event(1, 7, 0)], [event(2, 8, 200, "offer")], [event(3, 7, 300, "interview")], [event(4, 9, 900)]]
    out = drained(spark, tmp_path, slices, lambda s, at: jobs.run_stateful(jobs.stream_ghost_timeout(s, days=1, delay="1 hour"), "g", at))
    assert sorted((r.app_id, r.outcome) for r in out.collect()) == [(7, "ghosted"), (7, "interview"), (8, "offer")]


def test_upsert_keeps_the_newest_whatever_arrives_late(spark, tmp_path):
    rng = random.Random(3)
    rows = [event(i, rng.randrange(40), rng.randrange(500), rng.choice(("pending", "offer", "nonsense")), rng.choice((None, f"n{i}"))) for i in range(300)]
    rng.shuffle(rows)
    slices = [rows[:100], rows[100:101], rows[101:250], rows[250:]]
    touched = []

    def drain(stream, at):
        out = jobs.run_upsert(jobs.stream_latest_outcome(stream), "u", "app_id", jobs.newest_outcome, buckets=8, at=at)
        table = jobs.UpsertTable(spark, at.out, "app_id", out.schema, jobs.newest_outcome, 8)
        touched.append(set(table.versions().items()))
        return out

    got = {r.app_id: (r.outcome, r.notes) for r in drained(spark, tmp_path, slices, drain).collect()}
    want = {}
    for r in sorted(rows):
        if r[3] != "nonsense":
            want[r[2]] = (r[3], r[4] if r[4] is not None else want.get(r[2], (None, None))[1])
    assert got == want
    assert len(touched[1] - touched[0]) <= 1  # one row rewrites one bucket at most


def test_a_replayed_batch_writes_the_same_again(spark, tmp_path):
    versions = jobs.stream_latest_outcome(spark.createDataFrame([event(1, 1, 5, "offer"), event(2, 2, 6)], SCHEMA))
    table = jobs.UpsertTable(spark, str(tmp_path / "t"), "app_id", versions.schema, jobs.newest_outcome, 4)
    table.upsert(versions, 0)
    later = jobs.stream_latest_outcome(spark.createDataFrame([event(3, 1, 9, "interview")], SCHEMA))
    for _ in range(2):
        table.upsert(later, 1)
    assert sorted((r.app_id, r.outcome) for r in table.read().collect()) == [(1, "interview"), (2, "pending")]


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    slices = [[event(i, 1, h, "offer") for i, h in enumerate((1, 30, 60))], [event(10, 1, 2, "interview"), event(11, 1, 62, "offer")], [event(12, 1, 100, "offer")]]
    out = drained(spark, tmp_path, slices, lambda s, at: jobs.run_append(jobs.stream_funnel_tumbling(s), "f", at))
    assert sorted((r.day.day, r.n) for r in out.withColumn("day", F.col("day")).collect()) == [(1, 1), (2, 1), (3, 2)]
