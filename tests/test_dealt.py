"""Records dealt out once for all groups of a history: the same tables, and how many rows are shuffled for them."""

import datetime
import itertools
import os

from importlake import plans
from importlake.operators import history as h
from importlake.plans import registry
from importlake.plans.views import AS_OF, Tables
from importlake.sources import tables
from importlake.sources.staging import shared_folder, staged

SF = "/root/testdata/sf0.001"
plans.load()


def shuffled(spark, run):
    """Rows written for shuffles while ``run`` runs."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        bus.waitUntilEmpty(60_000)
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    run()
    return sum(n for k, n in written().items() if k not in before)


def test_other_joins_give_the_same_records(spark):
    t = Tables(spark, SF)
    for other in (t.ih_dealt, t.ih_goods_first):
        assert other.schema == t.ih.schema and other.exceptAll(t.ih).isEmpty() and t.ih.exceptAll(other).isEmpty()


def test_first_rows_hold_factories_and_market_status(spark):
    day = datetime.date(2000, 1, 1)
    cols = "category string, mc string, sku_name string, import_type string, importer string, manufacturer string, factory string, country string, email string, homepage string, oem_status string, import_date date, process_date date, hs_code string, unit string"
    keys = itertools.product(("c", "d", None), ("a", None), ("s1", "s2"), ("OEM", "IMPORT", None), ("i1", "i2", None), ("m", None), ("f", None), ("k", None))
    rows = [(*k, f"e{i % 5}" if i % 3 else None, f"h{i % 4}" if i % 2 else None, "ok" if i % 7 == 0 else None, day, None, None, None) for i, k in enumerate(keys) if i % 11]
    ih = spark.createDataFrame([r for i, r in enumerate(rows) for _ in range(1 + i % 3)], cols)
    groups = h.whole_groups(h.sku_groups(ih, day))
    same = lambda a, b: a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(h.marked_factories(groups), h.sku_factory(ih)) and same(h.marked_status(groups), h.market_status(ih))
    history = h.sku_history(ih, day)
    assert same(groups.select(*history.columns), history)


def test_refresh_shuffles_dealt_records_no_more(spark, tmp_path):
    """Before, for their status, the factories and the market status. What a refresh stages goes with it."""
    folder = shared_folder(spark).removeprefix("file://")
    left = lambda: {x for x in os.listdir(folder) if x.startswith("staged-")}
    ih = staged(Tables(spark, SF).ih).repartition(4, "sku_name", "manufacturer")
    before, n = left(), ih.count()
    assert n <= shuffled(spark, lambda: tables.refresh(ih, f"file://{tmp_path}/t", AS_OF)) < 1.1 * n
    assert left() == before


def test_dealt_records_are_grouped_without_a_shuffle(spark):
    lines = h.whole_groups(h.sku_groups(Tables(spark, SF).ih_dealt, AS_OF))._jdf.queryExecution().executedPlan().toString().split("\n")
    deal = [i for i, x in enumerate(lines) if "REPARTITION_BY_NUM" in x]
    assert len(deal) == 1 and not any("Exchange" in x for x in lines[: deal[0]]) and sum("Sort [" in x for x in lines[: deal[0]]) == 1


def test_measures_are_grouped_from_the_records_asked_for_only(spark):
    """Before, from all records, which were read once more for the keys."""
    n = Tables(spark, SF).raw("lineitem").count()
    assert shuffled(spark, lambda: registry.QUERIES["d2_attach_measures"](spark, SF).collect()) < n
