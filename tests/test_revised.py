"""Revised verdicts from pairs and records, held against those from all rows of both."""

import random

from pyspark.sql import functions as F

from importlake.operators import matching as m

KEYS = ["target", "old_status", "new_status", "pending", "changed"]


def made(spark, seed, most_importers):
    rng = random.Random(seed)
    some = lambda name, n, none=0.1: None if rng.random() < none else f"{name}{rng.randrange(n)}"
    pairs = spark.createDataFrame([(some("t", 40), f"c{rng.randrange(30)}", rng.random() < 0.5) for _ in range(150)], "target string, candidate string, ambiguous boolean")
    records = spark.createDataFrame([(f"c{rng.randrange(25)}", some("s", 3), some("f", 4), some("i", most_importers)) for _ in range(60)], "candidate string, sku_name string, factory string, importer string")
    decisions = spark.createDataFrame([(f"t{rng.randrange(40)}", f"c{rng.randrange(30)}", rng.random() < 0.3) for _ in range(400)], "target string, candidate string, accepted boolean")
    return pairs, records.distinct(), decisions


def test_verdicts_are_those_of_all_rows(spark):
    for seed, importers in ((1, 1), (2, 2), (3, 6)):
        pairs, records, decisions = made(spark, seed, importers)
        want = m.revise_status(pairs.join(records, "candidate"), decisions).select(*KEYS)
        got = m.revise_status_of(pairs, records, decisions).select(*KEYS)
        rows = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert rows(got) == rows(want) and want.count() > 20


def test_pairs_of_settled_targets_do_not_meet_records(spark, tmp_path):
    """2,000 targets of one name with 500 records made 1,000,000 rows."""
    records = spark.range(500).select(F.lit("c").alias("candidate"), F.lit("s").alias("sku_name"), F.expr("'f' || id % 100").alias("factory"), F.expr("'i' || id").alias("importer"))
    pairs = spark.range(2000).select(F.expr("'t' || id").alias("target"), F.lit("c").alias("candidate"), F.lit(True).alias("ambiguous"))
    none = spark.createDataFrame([], "target string, candidate string, accepted boolean")
    out = m.revise_status_of(pairs, records, none)
    assert out.where("old_status = 'O' and new_status = 'O' and pending and not changed").count() == 2000
    out.collect()
    most, todo = 0, [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kids, metrics = node.children(), node.metrics()
        todo += [kids.apply(i) for i in range(kids.size())]
        for way in ("executedPlan", "plan", "child"):
            if not kids.size() and hasattr(node, way):
                try:
                    todo.append(getattr(node, way)())
                    break
                except Exception:  # noqa: BLE001
                    pass
        if metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
    assert 0 < most <= 2000
