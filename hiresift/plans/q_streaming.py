"""Streams over files derived from `part` and `events`, drained once and compared with their batch forms."""
from __future__ import annotations

from pyspark.sql import functions as F

from hiresift.functions import terms as tm
from hiresift.functions import text as tx
from hiresift.functions import arrays as ar
from hiresift.plans import common as c
from hiresift.plans import derived as D
from hiresift.plans.q_extract import OFFERS
from hiresift.plans.q_funnel import EVENT, LATEST, POS, RATE
from hiresift.plans.q_text import TAGS, alias_case, raw_tags, scratch
from hiresift import vocab as V
from hiresift.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def arriving(t, df, name, slices=3):
    """Land a frame's rows in so many slices of its first column's hash and stream them, a slice's files to a batch."""
    folder = scratch(t, name)
    rows = df.withColumn("_slice", F.pmod(F.xxhash64(df.columns[0]), F.lit(slices)))
    for k in range(slices):
        rows.where(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(folder)
    return jobs.file_stream(t.spark, folder, df.schema, "*.parquet")


SLICES = 4
#: every fortieth event arrives three days late
ARRIVAL = "CASE WHEN event_id % 40 = 7 THEN ts + INTERVAL 3 DAYS ELSE ts END"


def replay(t, df, arrival, name, drain, slices=SLICES):
    """Land rows in the order they arrive, a slice of equal time at a time, and drain each before the next lands: the
    watermark of what has arrived is in force when a slice is read.  `drain(stream, place)` gives what has come out."""
    folder, at = scratch(t, name), jobs.place(t.spark, name)
    second = F.unix_timestamp(arrival)
    low, high = df.agg(F.min(second), F.max(second)).first()
    rows = df.withColumn("_slice", F.floor((second - low) * slices / (high - low + 1)))
    out = None
    for k in range(slices):
        rows.where(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(folder)
        out = drain(jobs.file_stream(t.spark, folder, df.schema, "*.parquet"), at)
    return out


def events_of(t):
    return c.outcome_events(t).select("ts", "event_id", "app_id", "outcome", "notes")


SLICED = f"ar AS (SELECT *, CAST(floor(epoch({ARRIVAL})) AS BIGINT) AS s FROM ev), bn AS (SELECT *, (s - min(s) OVER ()) * {SLICES} // (max(s) OVER () - min(s) OVER () + 1) AS slice FROM ar)"


@query("stream_extract_terms", f"WITH {OFFERS} SELECT jd_id, term, weight, section FROM top WHERE rank <= 40")
def stream_extract_terms(t):
    stream = arriving(t, c.postings(t).select("jd_id", "jd_text"), "postings")
    return jobs.run_append(jobs.stream_extract_terms(stream).select("jd_id", "term", "weight", "section"), "terms")


@query("stream_dedup_postings", "SELECT DISTINCT text AS jd_text FROM documents")
def stream_dedup_postings(t):
    """Documents arriving over a day; exact repeats are dropped."""
    arrivals = t.documents.select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id") % 86400)).alias("ts"), F.col("text").alias("jd_text"))
    return jobs.run_append(jobs.stream_dedup_postings(arriving(t, arrivals, "documents")), "dedup").select("jd_text")


@query("stream_latest_outcome", LATEST)
def stream_latest_outcome(t):
    """Slices arrive out of event order: late rows find newer versions in the table and leave them as they are."""
    def drain(stream, at):
        return jobs.run_upsert(jobs.stream_latest_outcome(stream), "latest", "app_id", jobs.newest_outcome, at=at)

    return replay(t, events_of(t), F.expr(ARRIVAL), "latest", drain).select("app_id", "outcome", "notes")


@query("stream_ghost_timeout", f"""WITH {EVENT}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY app_id ORDER BY ts) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens FROM ev),
 w AS (SELECT *, sum(opens) OVER (PARTITION BY app_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
 e AS (SELECT app_id, n, arg_max(outcome, (ts, event_id)) AS o, max(ts) AS last_ts FROM w GROUP BY 1, 2)
 SELECT app_id, CASE WHEN o = 'pending' THEN 'ghosted' ELSE o END AS outcome, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts FROM e
  WHERE last_ts + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev) OR EXISTS (SELECT 1 FROM e x WHERE x.app_id = e.app_id AND x.n > e.n)""")
def stream_ghost_timeout(t):
    """A timeout of one day, so that runs close inside the month the events cover, and keys come back."""
    def drain(stream, at):
        return jobs.run_stateful(jobs.stream_ghost_timeout(stream, days=1, delay="1 hour"), "ghosts", at)

    out = replay(t, events_of(t), F.col("ts"), "ghosts", drain)
    return out.select("app_id", "outcome", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query("stream_funnel_tumbling", f"""WITH {EVENT.replace(' FROM events)', " FROM events WHERE " + "event_type <> 'view')")}, {SLICED},
 wm AS (SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS wm FROM bn GROUP BY slice),
 d AS (SELECT date_trunc('day', ts) AS day, outcome, wm IS NOT NULL AND date_trunc('day', ts) + INTERVAL 1 DAY <= wm AS late FROM bn JOIN wm ON wm.slice = bn.slice),
 f AS (SELECT day, count(*) FILTER (NOT late) AS n, count(*) FILTER (NOT late AND outcome IN {POS}) AS reached_human, count(*) FILTER (late) AS late_rows FROM d GROUP BY 1)
 SELECT strftime(day, '%Y-%m-%d') AS day, n, reached_human, {RATE}, late_rows FROM f WHERE n > 0 AND day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)""")
def stream_funnel_tumbling(t):
    """Days the watermark has passed, each as it stood then, with how many of its rows came too late to count."""
    rows = c.outcome_events(t).where("outcome <> 'pending'").select("ts", "event_id", "app_id", "outcome", "notes")

    def drain(stream, at):
        return jobs.run_append(jobs.stream_funnel_tumbling(stream), "funnel", at)

    daily = replay(t, rows, F.expr(ARRIVAL), "funnel", drain)
    landed = rows.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("landed"))
    return daily.join(landed, "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "reached_human", "conversion_pct", "ci_low", "ci_high", (F.col("landed") - F.col("n")).alias("late_rows"))


SOFT = ", ".join(f"'{x}'" for x in V.NOT_SEARCHED)


@query("stream_candidate_counts", f"SELECT term, count(*) AS count FROM (SELECT {alias_case('lower(trim(raw))')} AS term FROM ({TAGS})) WHERE term NOT IN ({SOFT}) GROUP BY 1")
def stream_candidate_counts(t):
    tags = raw_tags(t).select(tm.canonical(F.col("raw")).alias("term"))
    known = t.spark.createDataFrame([(x,) for x in V.NOT_SEARCHED], "term string")
    return jobs.run_keyed(jobs.stream_candidate_counts(arriving(t, tags, "tags"), known), "candidates", "term", mode="complete")
