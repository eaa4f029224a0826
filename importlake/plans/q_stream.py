"""Queries of streams; each has the rows that a batch over the same files would have."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from importlake.operators import history as h
from importlake.plans.q_history import FACTORY, K8, STATUS, joined, same
from importlake.plans.registry import query
from importlake.plans.views import Tables
from importlake.sources.staging import shared_folder
from importlake.streaming import ingest as s

IH = ("import_history",)


def scratch(t) -> str:
    """A new folder that driver and executors share: under the one that the cluster names."""
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


#: Events come in deliveries of six days each; one in ten comes a delivery later than it should.
ARRIVAL = "cast(floor((day({ts}) - 1) / 6.0) as int) + case when event_id % 10 = 3 then 1 else 0 end"
LAST = 5
DELIVERED = f"d as (select *, {ARRIVAL.format(ts='ts')} as arrival from events)"


def delivered(t):
    rows = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumn("arrival", F.expr(ARRIVAL.format(ts="ts")))


def in_turn(t, rows, own, *starts):
    """Put each delivery into a folder that streams read, and run all streams over what is new there before the next one comes."""
    for k in range(LAST + 1):
        rows.where(F.col("arrival") == k).write.mode("append").parquet(f"{own}/feed")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{own}/feed")
        for start in starts:
            start(stream)


D = "coalesce(import_date, process_date)"


def ingested(t):
    """Line items arrive in three deliveries; each batch is joined with the tables as they stand, as the view does. The parts are compacted on the way."""
    out, raw = scratch(t), t.raw("lineitem")

    def records(rows):
        return Tables(rows.sparkSession, t.sf_dir).records(rows)

    for k in range(3):
        raw.where(F.pmod("l_orderkey", F.lit(3)) == k).write.mode("append").parquet(f"{out}/feed")
        s.start_ingest(t.spark.readStream.schema(raw.schema).parquet(f"{out}/feed"), records, out, f"{out}/checkpoint").awaitTermination()
        if k == 1:
            s.compact(t.spark, out)
    return out


@query("n1_incremental_ingest", f""", hist as (select {K8}, count(*) as import_count, min(email) as email, min({D}) as first_import, max({D}) as latest_import, max(hs_code) as hs_code from import_history group by {K8}),
  status as ({STATUS}) select hist.*, market_status from hist left join status on {same('hist', 'status', h.MARKET_KEYS)}""", IH)
def _(t):
    return s.refresh_history(t.spark, ingested(t))


@query("n1_incremental_market", STATUS, IH)
def _(t):
    return s.refresh_market(t.spark, ingested(t))


@query("n1_incremental_factories", FACTORY, IH)
def _(t):
    return joined(s.refresh_factories(t.spark, ingested(t)), "importers", "import_types")


@query("n2_stream_counts", f"""with {DELIVERED},
  marks as (select a.k, (select max(ts) from d where arrival < a.k) - interval 2 day as mark from (select unnest(range(0, {LAST + 2})) as k) a),
  rows as (select date_trunc('day', ts) as window_start, event_type, value, coalesce(date_trunc('day', ts) + interval 1 day <= date_trunc('millisecond', mark), false) as late from d join marks on k = arrival),
  counts as (select window_start, event_type, count(*) filter (not late) as n, round(sum(value) filter (not late), 6) as value, count(*) filter (late) as late_rows from rows group by 1, 2)
  select cast(window_start as timestamp) as window_start, event_type, n, value, late_rows from counts
  where n > 0 and window_start + interval 1 day <= (select date_trunc('millisecond', mark) from marks where k = {LAST + 1})""")
def _(t):
    own, rows = scratch(t), delivered(t)
    counts = lambda stream: s.append_to_end(s.stream_counts(stream, "ts", ["event_type"], "1 day", "2 days"), f"{own}/counts", f"{own}/checkpoint-counts")
    late = lambda stream: s.start_late(stream, "ts", f"{own}/side", f"{own}/checkpoint-late", "1 day", "2 days").awaitTermination()
    in_turn(t, rows, own, counts, late)
    missed = t.spark.read.schema(rows.schema).parquet(f"{own}/side/late").groupBy(F.date_trunc("day", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("late_rows"))
    closed = t.spark.read.parquet(f"{own}/counts").join(missed, ["window_start", "event_type"], "left").withColumn("late_rows", F.coalesce("late_rows", F.lit(0)))
    return closed.withColumn("window_start", F.to_timestamp_ntz(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


def step(k):
    """What delivery ``k`` brings out: rows that aren't late, of keys whose last one has expired."""
    return f""", o{k} as (select r.user_id, r.event_type, r.arrival, r.ts from r join marks on k = {k} left join s{k} using (user_id, event_type) where r.arrival = {k} and (mark is null or r.ts > mark) and (s{k}.last is null or s{k}.last + interval 8 day <= mark)),
  s{k + 1} as (select user_id, event_type, max(last) as last from (select * from s{k} union all select user_id, event_type, ts from o{k}) group by 1, 2)"""


@query("n3_stream_dedupe", f"""with {DELIVERED}, r as (select user_id, event_type, arrival, min(ts) as ts from d group by 1, 2, 3),
  marks as (select a.k, date_trunc('millisecond', (select max(ts) from r where arrival < a.k)) - interval 8 day as mark from (select unnest(range(0, {LAST + 1})) as k) a),
  s0 as (select user_id, event_type, ts as last from r where false){''.join(map(step, range(LAST + 1)))}
  {' union all '.join(f'select user_id, event_type, arrival from o{k}' for k in range(LAST + 1))}""")
def _(t):
    own = scratch(t)
    rows = delivered(t).groupBy("user_id", "event_type", "arrival").agg(F.min("ts").alias("ts"))
    first = lambda stream: s.append_to_end(s.stream_dedupe(stream, "ts", ["user_id", "event_type"], "8 days"), f"{own}/out", f"{own}/checkpoint")
    in_turn(t, rows, own, first)
    return t.spark.read.schema(rows.schema).parquet(f"{own}/out").select("user_id", "event_type", "arrival")
