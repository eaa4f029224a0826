"""Versions, extension functions and merged ingest on small cases."""

import pytest
from pyspark.sql import functions as F

from importlake.operators import extensions as ext
from importlake.operators import history, matching
from importlake.plans.views import AS_OF, Tables
from importlake.sources import tables, versions
from importlake.streaming import ingest

SF = "/root/testdata/sf0.001"
STORED = "sku_name string, mc string, category string, embedding array<double>, status string, error string, model string"


def test_readers_see_whole_versions_only(spark, tmp_path, monkeypatch):
    out, ih = f"file://{tmp_path}/t", Tables(spark, SF).ih
    assert versions.current(spark, out) is None
    tables.refresh(ih.where("mc = 'bolt'"), out, AS_OF)
    before = {n: versions.read(spark, out, n).count() for n in ("sku_history", "sku_factory", "market_status", "facets")}

    def broken(*_):
        raise RuntimeError("stopped half way")

    monkeypatch.setattr(tables, "facet_lists", broken)
    with pytest.raises(RuntimeError):
        tables.refresh(ih, out, AS_OF)
    assert {n: versions.read(spark, out, n).count() for n in before} == before
    monkeypatch.undo()
    assert tables.refresh(ih, out, AS_OF) == 2
    assert versions.read(spark, out, "sku_history").count() > before["sku_history"]


def test_commits_are_numbered_in_turn(spark, tmp_path):
    out = f"file://{tmp_path}/t"
    assert [versions.commit(spark, out, {"n": k}) for k in range(3)] == [1, 2, 3]
    assert versions.current(spark, out) == {"n": 2}


def test_histories_read_the_records_once(spark):
    plan = history.factory_view(history.sku_history(Tables(spark, SF).ih, AS_OF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") + plan.count("l_orderkey#") > 0 and plan.count("l_returnflag") <= 8 and plan.count("Join") == 5


def test_a_function_that_raises_fails_its_rows_only():
    asked = []

    def f(items):
        asked.append(len(items))
        if 7 in items or 11 in items:
            raise ValueError("odd")
        return [k * 2 for k in items]

    got = ext.tried(f, list(range(16)), lambda r: "too large" if r > 28 else None)
    assert [e for _, e in got] == [{7: "ValueError: odd", 11: "ValueError: odd", 15: "too large"}.get(k) for k in range(16)]
    assert [r for r, e in got if e is None] == [k * 2 for k in range(16) if k not in (7, 11, 15)] and len(asked) < 16
    assert ext.tried(f, [], lambda r: None) == [] and ext.tried(lambda x: [], [1], lambda r: None)[0][1].startswith("ValueError: 0 results")


def test_embedding_until_the_backlog_is_empty(spark):
    rows = [("a b", "m", "c"), ("bad", None, "c"), ("a b", "m", "c"), ("inf", "m", "c"), ("", None, "c")]
    products, none = spark.createDataFrame(rows, "sku_name string, mc string, category string"), spark.createDataFrame([], STORED)

    def first(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("down")
        return [[float("inf"), 0.0] if "inf" in t else [1.0, 0.0] for t in texts]

    one = ext.embed_missing(products, none, first, "m", 2)
    status = {r.sku_name: (r.status, r.error) for r in one.collect()}
    assert status == {"a b": ("completed", None), "bad": ("failed", "RuntimeError: down"), "inf": ("failed", "a number isn't finite"), "": ("completed", None)}

    def second(texts):
        assert all("bad" in t or "inf" in t for t in texts)  # what is done isn't asked again
        return [[0.0, 1.0] for _ in texts]

    stored = spark.createDataFrame(one.collect(), STORED)
    two = ext.embed_missing(products, stored, second, "m", 2)
    assert {r.sku_name: (r.status, r.embedding[0]) for r in two.collect()} == {"a b": ("completed", 1.0), "": ("completed", 1.0), "bad": ("completed", 0.0), "inf": ("completed", 0.0)}

    def never(texts):
        raise AssertionError("asked")

    three = ext.embed_missing(products, spark.createDataFrame(two.collect(), STORED), never, "m", 2)
    assert three.where("status = 'completed'").count() == 4 and three.count() == 4


def test_each_pair_is_judged_once(spark):
    queue = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "b"), ("u", "c"), ("u", "d")], "target string, candidate string")
    none = spark.createDataFrame([], "target string, candidate string, accepted boolean, error string")

    def first(pairs):
        if ("u", "d") in pairs:
            raise RuntimeError("down")
        return [{"a": True, "b": False, "c": None}[c] for _, c in pairs]

    known = ext.judge_queue(queue, none, first).collect()
    assert sorted((r.candidate, r.accepted, r.error) for r in known) == [("a", True, None), ("b", False, None), ("c", None, None), ("d", None, "RuntimeError: down")]
    known = spark.createDataFrame(known, none.schema)
    again = ext.judge_queue(queue, known, lambda pairs: ["maybe" for _ in pairs]).collect()
    assert [(r.candidate, r.accepted, r.error) for r in again] == [("d", None, "not a decision: 'maybe'")]
    kept = matching.apply_decisions(queue.distinct().withColumn("ambiguous", F.lit(True)), ext.decisions(known)).collect()
    assert sorted((r.candidate, r.pending) for r in kept) == [("a", False), ("c", True), ("d", True)]


def test_batches_merge_like_one(spark, tmp_path):
    out, ih = f"file://{tmp_path}/t", Tables(spark, SF).ih
    for number in range(4):
        part = ih.where(F.pmod(F.xxhash64("sku_name", "importer"), F.lit(3)) == min(number, 2))
        ingest.partial_history(part).write.mode("overwrite").parquet(f"{out}/parts/batch={min(number, 2)}")  # the last one is run again
        if number == 0:
            assert ingest.compact(spark, out) == 0
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(ingest.refresh_market(spark, out), history.market_status(ih))
    assert same(ingest.refresh_factories(spark, out), history.sku_factory(ih))
    ingest.compact(spark, out)
    whole = history.sku_history(ih, AS_OF)
    own = ingest.refresh_history(spark, out)
    assert same(own, whole.select(*own.columns))
