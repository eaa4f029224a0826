"""Operator 4: mix sources to target weights by a Pfair schedule.

A source is dealt out in blocks of rows. With weight w, block k (from 0) of a source is released at slot floor(k / w) and
due by slot ceil((k + 1) / w); at each slot the released block with the earliest deadline goes out. Then after any number
of slots each source has had its share to within less than one block. With whole-number weights the schedule repeats
after as many slots as the weights sum to, so only that one period is ever scheduled; a block's slot follows from its
number by arithmetic. When a source ends, the others go on by their weights in a new phase, until every row is dealt out.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from importlake.llm.common import stage


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of the earliest-deadline-first schedule; ties go to the first name."""
    total = sum(weights.values())
    waiting = [(0, -(-total // w), s, 0) for s, w in weights.items() if w > 0]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        _, s, k = heapq.heappop(ready)
        slots[s].append(slot)
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * total // weights[s], -(-(k + 2) * total // weights[s]), s, k + 1))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """The phases of the mix: for each source of a phase its weight, first block, number of blocks and slots.

    ``start``: the slot at which the phase begins; ``every``: the slots of a period. There are at most as many phases as sources.
    """
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        common = math.gcd(*(weights[s] for s in left))
        own = {s: weights[s] // common for s in sorted(left)}
        slots, every = period(own), sum(own.values())
        length = min((n - 1) // own[s] * every + slots[s][(n - 1) % own[s]] + 1 for s, n in left.items())
        for s in sorted(left):
            whole, rest = divmod(length, every)
            n = whole * own[s] + sum(x < rest for x in slots[s])
            if n:
                out.append({"source": s, "weight": own[s], "first": done[s], "blocks": n, "slots": slots[s], "start": start, "every": every})
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += length
    return out


#: A plan of up to this many rows is broadcast.
PLAN_ROWS = 20_000


def _table(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """The plan as a table, read from one JSON text."""
    kind = "array<struct<mix_plan_source: string, mix_plan_weight: bigint, mix_plan_first: bigint, mix_plan_blocks: bigint, mix_plan_slots: array<bigint>, mix_plan_start: bigint, mix_plan_every: bigint>>"
    rows = [{f"mix_plan_{k}": v for k, v in p.items()} for p in plan]
    return spark.sql(f"select inline(from_json(:plan, '{kind}'))", args={"plan": json.dumps(rows)})


def mix(
    docs: DataFrame, weights: dict[str, int] | None = None, block: int = 16, source_col: str = "source", key_col: str = "doc_id", text_col: str = "text",
    other_weight: int = 1, bucket_rows: int = 4_000,
) -> DataFrame:
    """Add to each row its place in the mix: mix_source, mix_block, mix_slot, mix_release, mix_deadline and mix_at (long).

    ``mix_slot`` is the slot of the row's block of ``block`` rows, and ``mix_at`` orders the rows: slot times block size plus
    the place in the block. ``weights`` are whole numbers of a source's relative share (``other_weight`` for a source
    without one; all alike by default); they should be small, as a period has as many slots as they sum to. A weight
    of zero puts a source behind all others. A null source is a source of its own, the empty name.
    Within a source the rows are in the order of a hash of key and text, and rows alike in both follow one another in any
    order, which are copies. No row is dropped. The only thing that comes to the driver is the number of rows of each source. The plan has a row for each
    source that is left in each phase, so it grows with the square of the sources if each ends at another slot; up to PLAN_ROWS it is broadcast. Ranks within a source come from counts of hash buckets of about ``bucket_rows``
    rows, so a source with a third of all rows is ranked in many tasks. An empty table gives an empty result.
    Columns of the input whose names begin with ``mix_`` are dropped.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("mix_")])
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    counts = {r.s: r.n for r in docs.groupBy(source.alias("s")).agg(F.count("*").alias("n")).collect()}
    share = {s: (weights or {}).get(s, other_weight) for s in counts}
    blocks = {s: -(-n // block) for s, n in counts.items()}
    plan = phases({s: n for s, n in blocks.items() if share[s] > 0}, share)
    behind = {s: n for s, n in blocks.items() if share[s] <= 0}
    after = max((p["start"] + (p["blocks"] - 1) // p["weight"] * p["every"] + p["every"] for p in plan), default=0)
    plan += [p | {"start": p["start"] + after} for p in phases(behind, dict.fromkeys(behind, 1))]

    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    mixed = F.xxhash64(F.col(key_col), F.col(text_col))
    keyed = docs.withColumns({"mix_source": source, "mix_bucket": F.pmod(mixed, F.lit(buckets)), "mix_hash": mixed})
    sizes = docs.select(source.alias("s"), F.pmod(mixed, F.lit(buckets)).alias("b")).groupBy("s", "b").agg(F.count("*").alias("n"))
    before = stage(
        sizes.selectExpr("s as mix_at_source", "b as mix_at_bucket", "sum(n) over (partition by s order by b rows between unbounded preceding and 1 preceding) as mix_before"),
        "buckets",
    )
    ranked = keyed.selectExpr("*", "row_number() over (partition by mix_source, mix_bucket order by mix_hash) - 1 as mix_rank")
    placed = ranked.join(before, (F.col("mix_source") == F.col("mix_at_source")) & (F.col("mix_bucket") == F.col("mix_at_bucket"))).withColumn(
        "mix_rank", F.col("mix_rank") + F.coalesce("mix_before", F.lit(0))
    )
    placed = placed.withColumn("mix_block", F.expr(f"mix_rank div {block}"))
    table = _table(docs.sparkSession, plan)
    if len(plan) <= PLAN_ROWS:
        table = F.broadcast(table)
    k = F.col("mix_block") - F.col("mix_plan_first")
    joined = placed.join(
        table, (F.col("mix_source") == F.col("mix_plan_source")) & (k >= 0) & (k < F.col("mix_plan_blocks"))
    ).withColumn("mix_k", k)
    return joined.withColumns({
        "mix_slot": F.expr("mix_plan_start + mix_k div mix_plan_weight * mix_plan_every + element_at(mix_plan_slots, cast(mix_k % mix_plan_weight as int) + 1)"),
        "mix_release": F.expr("mix_plan_start + mix_k * mix_plan_every div mix_plan_weight"),
        "mix_deadline": F.expr("mix_plan_start + ((mix_k + 1) * mix_plan_every + mix_plan_weight - 1) div mix_plan_weight"),
    }).withColumn("mix_at", F.col("mix_slot") * block + F.col("mix_rank") % block).select(*docs.columns, "mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_at")
