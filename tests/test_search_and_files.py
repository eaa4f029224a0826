"""Hybrid search, pruned neighbours, card pairing, listings and files against plain versions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from importlake.operators import enrich, retail, search
from importlake.sources import files, tables


def plain_pairs(cards, raw):
    """One card after the other, one row after the other."""
    used, out = set(), []
    for c, price in cards:
        free = [(i, p) for i, p in raw if i not in used]
        near = [i for i, p in free if price is not None and p is not None and abs(p - price) < 0.005]
        if free:
            at = near[0] if near else free[0][0]
            used.add(at)
            out.append((c, at, "price" if near else "order"))
    return out


def test_pairs_are_those_of_one_card_after_the_other(spark):
    rng = np.random.default_rng(3)
    price = lambda: None if rng.random() < 0.15 else float(np.round(rng.integers(1, 6) + rng.integers(0, 4) * 0.003, 3))
    cards = [(i, "t", "r", f"b{i % 4}", price()) for i in range(120)]
    raw = [(i, "t", "r", f"b{rng.integers(0, 4)}", price()) for i in range(110)]
    blank = [(900, "t", "r", None, 1.0), (901, "t", "r", " ", 1.0)]
    kind = "_id long, product_type string, retailer string, brand_en string, price_usd double"
    got = enrich.pair_cards(spark.createDataFrame(cards + blank, "card" + kind), spark.createDataFrame(raw + blank, "raw" + kind)).collect()
    want = [p for b in range(4) for p in plain_pairs([(c[0], c[4]) for c in cards if c[3] == f"b{b}"], [(x[0], x[4]) for x in raw if x[3] == f"b{b}"])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_card_may_take_the_row_that_suits_a_later_one(spark):
    cards = spark.createDataFrame([(1, "t", "r", "b", 9.0), (2, "t", "r", "b", 5.0)], "card_id long, product_type string, retailer string, brand_en string, price_usd double")
    raw = spark.createDataFrame([(7, "t", "r", "b", 5.0), (8, "t", "r", "b", 6.0)], "raw_id long, product_type string, retailer string, brand_en string, price_usd double")
    assert sorted(map(tuple, enrich.pair_cards(cards, raw).collect())) == [(1, 7, "order"), (2, 8, "order")]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_pruned_neighbours_are_the_nearest(spark, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 12))
    v = centres[rng.integers(0, 30, 3000)] + spread * rng.normal(size=(3000, 12))
    v[100:200] = v[5]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 12), (5002, [float("nan")] * 12), (5003, [1.0] * 3)]
    refs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = refs.where("vec_id % 40 = 0 or vec_id > 4000").withColumnRenamed("vec_id", "query_id")
    got = sorted((r.query_id, r.rank, r.ref_id) for r in search.knn(asked, refs, 4).collect())
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for q in range(0, 3000, 40):
        order = sorted((-round(float(c), 9), i) for i, c in enumerate(unit @ unit[q]))[:4]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(order)]
    exact = {(q, n): i for q, n, i in want}
    assert len(got) == len(want)
    for q, n, i in got:
        assert abs(float(unit[q] @ unit[i]) - float(unit[q] @ unit[exact[q, n]])) < 1e-9
    q, r, meet = search.knn_blocks(asked, refs, 4)
    share = q.join(r, meet).count() / (q.count() * r.count())
    assert share < 0.3 if spread < 0.1 else share <= 1


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert search.knn(one.withColumnRenamed("vec_id", "query_id"), none, 3).count() == 0
    assert search.knn(none.withColumnRenamed("vec_id", "query_id"), one, 3).count() == 0
    assert [tuple(r)[:2] for r in search.knn(one.withColumnRenamed("vec_id", "query_id"), one, 3).collect()] == [(1, 1)]


def test_a_term_that_only_an_importer_or_factory_has_is_found(spark):
    day = datetime.date(2000, 1, 1)
    base = [("parts", "bolt", "red bolt", "OEM", "Acme", "M", "Works One", "JP", 5), ("parts", "bolt", "blue bolt", "OEM", "Zeta", "M", "Works Two", "JP", 9), ("goods", None, "cup", "OEM", None, None, None, None, 1)]
    rows = spark.createDataFrame([(*b, day, "O") for b in base], "category string, mc string, sku_name string, import_type string, importer string, manufacturer string, factory string, country string, import_count long, latest_import date, market_status string")
    emb = spark.createDataFrame([(1, "Cup ", None, "GOODS", [1.0, 0.0], "completed"), (2, "red bolt", "bolt", "parts", [0.0, 1.0], "failed")], "vec_id long, sku_name string, mc string, category string, embedding array<double>, status string")
    v = F.array(F.lit(1.0), F.lit(0.0))
    find = lambda terms, intent, **more: {r.sku_name: r.match_type for r in search.hybrid_search(rows, emb, terms, v, intent, 5, 1, 0.5, **more).collect()}
    assert find(["acme"], search.Intent()) == {"red bolt": "exact", "cup": "semantic"}
    assert find(["works two"], search.Intent("bolt")) == {"blue bolt": "exact", "cup": "semantic"}
    assert find(["nothing"], search.Intent("bolt")) == {"blue bolt": "popular", "cup": "semantic"}
    assert find(["nothing"], search.Intent("bolt"), aliases=["^ac"]) == {"red bolt": "popular"}  # popularity after the filters
    assert find([], search.Intent(), filters={"country": ["JP"]}) == {}


def test_an_export_begins_with_the_mark_and_comes_back(spark, tmp_path):
    rows = [(1, 'a "b"\nc'), (2, None), (3, "x, y")]
    files.export_csv(spark.createDataFrame(rows, "id long, remark string"), str(tmp_path / "e"), ["id"])
    parts = list((tmp_path / "e").glob("part-*"))
    assert parts and all(p.read_bytes().startswith(b"\xef\xbb\xbfid,remark") for p in parts)
    back = files.read_rows(spark, str(tmp_path / "e"), line_breaks=True)
    assert back.columns == ["id", "remark"] and sorted((int(r.id), r.remark) for r in back.collect()) == rows


def test_the_report_counts_what_the_load_writes(spark, tmp_path):
    raw = spark.createDataFrame([(" a ", "x"), ("", "y"), (None, "z")], "sku_name string, factory string")
    clean, seen = files.observed_ingest(raw)
    clean.write.parquet(str(tmp_path / "c"))
    assert seen.get == {"total": 3, "inserted": 1, "skipped": 2}
    assert [r.sku_name for r in spark.read.parquet(str(tmp_path / "c")).collect()] == ["a"]


def test_a_snapshot_run_loaded_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("Nike", "cup, 5 oz", " "), ("Great Value", "tin, 2 oz", None), (None, None, "box")], "brand string, title string, unit string")
    load = lambda df, run: tables.load_snapshot(df, str(tmp_path / "i"), str(tmp_path / "r"), run, datetime.datetime(2000, 1, 1), "all", labels=["great value"])
    assert load(rows, "a") == 2 and load(rows.limit(1), "b") == 1 and load(rows, "a") == 2
    items = spark.read.parquet(str(tmp_path / "i")).collect()
    assert sorted((r.run_id, r.unit) for r in items) == [("a", "5 oz"), ("a", "box"), ("b", "5 oz")]
    assert sorted((r.run_id, r.row_count) for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [("a", 2), ("b", 1)]


def test_labels_flags_and_lists(spark):
    df = spark.createDataFrame([("Toilet ROLL", None, None), ("cup", "WAKODO", None), ("cup", None, "이유식 x"), ("cup", "x", "y"), (None, None, None)], "n string, b string, k string")
    assert [r[0] for r in df.select(retail.ineligible(F.col("n"), F.col("b"), F.col("k"))).collect()] == [True, True, True, False, False]
    codes = spark.createDataFrame([("kr",), ("K1",), (None,)], "code string")
    assert [r[0] for r in codes.select(retail.flag(F.col("code"))).collect()] == ["🇰🇷", "🏳️", "🏳️"]


def test_labels_of_cards_are_broadcast_and_their_values_stay_dealt_out(spark):
    labels = [("s", 0, 0, "type: oil"), ("s", 1, 0, "retailer: aeon"), ("s", 2, 0, "Brand"), ("s", 3, 0, "Name")]
    cells = spark.createDataFrame(labels + [("s", r, c, f"{r}-{c}") for r in (2, 3) for c in range(1, 60)], "sheet string, row int, col int, value string")
    out = files.unpivot_cards(cells.repartition(4), {"Brand": "brand", "Name": "name"})
    assert {tuple(r) for r in out.collect()} == {("oil", "aeon", c, f"2-{c}", f"3-{c}") for c in range(1, 60)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
