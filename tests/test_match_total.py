"""The total of matched groups: which records it groups, and how line items meet orders."""

import datetime

from importlake import plans
from importlake.operators import history as h
from importlake.operators import search as s
from importlake.plans import registry
from importlake.plans.views import Tables

SF = "/root/testdata/sf0.001"
plans.load()


def test_other_products_go_before_histories_are_grouped(spark):
    day = datetime.date(2000, 1, 1)
    cols = "category string, mc string, sku_name string, import_type string, importer string, manufacturer string, factory string, country string, email string, homepage string, oem_status string, import_date date, process_date date, hs_code string, unit string"
    made = [("c", mc, sku, "OEM", importer, "m", factory, None) for mc in ("a", None) for sku in ("s1", "s2", "s3") for importer in ("i1", "i2", None) for factory in ("f1", None)]
    history = h.sku_history(spark.createDataFrame([(*r, None, None, None, day, day, None, None) for r in made], cols), day)
    matched = spark.sql("select * from values ('s1', 'a', 'c'), ('s1', null, 'c'), ('s1', null, 'c'), ('s3', 'a', 'c'), ('s4', 'a', 'c') as m(sku_name, mc, category)")
    total = s.match_total(history, matched)
    assert total.first().total == 8  # two factories each, of one match twice as it stands twice
    lines = total._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = [i for i, x in enumerate(lines) if "LeftSemi" in x]
    assert first and not any("Aggregate" in x for x in lines[first[0] :])


def test_line_items_are_not_sorted(spark):
    """Their sort was most of a task's memory."""
    t = Tables(spark, SF)
    plan = registry.QUERIES["i7_match_total"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [l_orderkey" in plan and "ShuffledHashJoin [l_partkey" in plan
    assert t.ih_hashed.exceptAll(t.ih).isEmpty() and t.ih.exceptAll(t.ih_hashed).isEmpty() and t.ih.columns == t.ih_hashed.columns
