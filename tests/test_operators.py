"""Golden values, traps of null and rounding, and properties."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators import containing, costing, history, matching, ranking, retail, search
from importlake.plans.views import AS_OF, TOP_RETAILERS, Tables
from importlake.sources import files, tables, versions

SF = "/root/testdata/sf0.001"


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i long, v {kind}")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def test_unit_to_kg(spark):
    got = values(spark, x.unit_to_kg, ["500 g", "16 oz", "2 lb", "16.9 fl oz", "355ml (12 fl oz)", "36 count", None, "0 kg", "1,000 g", "5 floz"])
    assert got == [0.5, pytest.approx(0.4536, abs=1e-4), pytest.approx(0.9072, abs=1e-4), pytest.approx(0.5, abs=1e-3), 0.355, None, None, None, 1.0, pytest.approx(0.1479, abs=1e-4)]


def test_extract_unit(spark):
    assert values(spark, x.extract_unit, ["Oil, Extra Virgin, 16.9 fl oz", "nothing", None]) == ["16.9 fl oz", None, None]


@pytest.mark.parametrize(
    "mc, category, name, semantic, intent, expected",
    [
        ("tuna", "canned", "tuna can", 0.8286, search.Intent("tuna", ["canned"], ["tuna"]), 1.0),
        ("salmon", "canned", "plain", 0.82, search.Intent("tuna", ["canned"], ["tuna"]), 0.84),
        ("tuna", "fresh", "tuna", 0.86, search.Intent("tuna", ["canned"], ["tuna"]), 0.82),
        ("tuna", "canned", "tuna", 0.60, search.Intent("tuna", ["canned"], ["tuna"]), 0.98),
        (None, None, None, 0.5, search.Intent("tuna", ["canned"], ["tuna"]), 0.5),
    ],
)
def test_relevance(spark, mc, category, name, semantic, intent, expected):
    df = spark.createDataFrame([(mc, category, name, semantic)], "mc string, category string, sku_name string, semantic_score double")
    assert search.relevance(df, intent).first().relevance_score == pytest.approx(expected)


def test_threshold_keeps_exact_and_popular(spark):
    df = spark.createDataFrame([("exact", None), ("popular", 0.1), ("semantic", 0.98), ("semantic", 0.989)], "match_type string, relevance_score double")
    assert search.threshold(df, 0.99).count() == 2
    assert search.threshold(df, 0.985).count() == 3


def test_synonyms_go_both_ways(spark):
    groups = spark.createDataFrame([(1, t) for t in x.SYNONYMS[0]], "group_id int, term string")
    got = search.expand_terms(spark.createDataFrame([(t,) for t in x.SYNONYMS[0]], "query string"), groups).groupBy("query").agg(F.array_sort(F.collect_set("term")).alias("t")).collect()
    assert len(got) == 2 and all(r.t == sorted(x.SYNONYMS[0]) for r in got)


def test_importer_names(spark):
    got = values(spark, x.canonical_importer, ["(주)이마트", "주식회사 롯데마트 ", "㈜쿠팡", "하이랜드푸드", "(주)이랜드팜앤푸드", "  ", None, "Costco Korea Ltd", "무명 상사"])
    assert got == ["이마트", "롯데마트", "쿠팡", "하이랜드푸드", "이랜드", None, None, "코스트코", "무명 상사"]


def test_keys(spark):
    assert values(spark, x.brand_key, ["Trident Seafoods Corp.", "Ｆｏｏ, Inc", None]) == ["trident_seafoods", "foo", ""]
    assert values(spark, x.name_key, ["Olive  Oil (1L)", None]) == ["olive oil 1l", ""]
    assert values(spark, x.fold_text, ["Crème Brûlée!", None]) == ["creme brulee", None]
    assert values(spark, x.core_name, ["Oil (1L)", "Oil 500 ml", "Oil (2) 1 kg", "Oil"]) == ["Oil"] * 4


def test_null_groups_survive_joins(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    assert {(r.a, r.b) for r in history.null_safe_join(a, b, ["k"]).collect()} == {(1, 10), (2, 20)}


def test_landed_cost_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.5, 0.0), (1.5, 0.0), (None, 0.0), (1.0, None)], "purchase_usd double, rate_pct double")
    got = costing.landed_cost(df, {"won_per_dollar": 1.0, "broker_share": 0.0, "logistics_share": 0.0}).collect()
    assert [r.landed_won for r in got] == [0.0, 2.0, None, None]


def test_tariff_ties_and_dates(spark):
    t = Tables(spark, SF)
    items = spark.createDataFrame([("090102000", "NATION_4"), ("0100102000", "NATION_1"), ("0100102000", None), ("77", "NATION_1")], "hs_code string, country string")
    got = {(r.hs_code, r.country): (r.rate_pct and float(r.rate_pct), r.rate_type) for r in costing.resolve_tariff(items, t.tariffs, t.fta, AS_OF).collect()}
    assert got[("090102000", "NATION_4")] == (6.5, "A") and got[("0100102000", None)] == (8.0, "A") and got[("77", "NATION_1")] == (None, None)
    assert got[("0100102000", "NATION_1")][1] == "F1"


def test_one_factory_alone_is_an_a(spark):
    df = spark.createDataFrame([("s", "f", 3)], "sku string, factory string, import_count long")
    assert ranking.count_grade(df, ["sku"]).first().count_grade == "A"


def test_series_sum_to_counts(spark):
    t = Tables(spark, SF)
    total = history.monthly_series(t.ih, ["manufacturer"], datetime.date(2002, 1, 1)).groupBy().sum("count").first()[0]
    assert total == t.ih.where(history.effective_date().isNotNull()).count()


def test_factory_view_keeps_all_rows(spark):
    t = Tables(spark, SF)
    sh = history.sku_history(t.ih, AS_OF)
    assert history.factory_view(sh).groupBy().sum("import_count").first()[0] == t.ih.count()


def test_one_factory_is_a_part_of_all(spark):
    t = Tables(spark, SF)
    name = "Supplier#000000003 F1"
    one = ranking.factory_rank_per_sku(t.ih, name, TOP_RETAILERS, AS_OF)
    every = ranking.factory_rankings(t.ih, TOP_RETAILERS, AS_OF).where(F.col("factory") == name)
    assert sorted(map(str, one.collect())) == sorted(map(str, every.select(*one.columns).collect()))


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    updates = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "m", 1)], "k int, v string, o int")
    once = tables.upsert(target, updates, ["k"], "o")
    twice = tables.upsert(once, updates, ["k"], "o")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() == 4


def test_match_tiers(spark):
    rows = [("olive oil", "brand olive oil extra", "continuous"), ("costa d oro oil", "costa doro oil", "compact"), ("oil olive", "olive fine oil", "token_subset"), ("red", "blue", None), ("", "x", None)]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert all(r.got == r.want for r in df.select("want", matching.match_tier(F.col("a"), F.col("b")).alias("got")).collect())


def test_header_and_no_header(spark):
    rows = [(0, "구분", "제품명", ""), (1, "a", "b", "c")]
    df = spark.createDataFrame(rows, "o int, _c0 string, _c1 string, _c2 string")
    assert files.detect_header(df, "o").columns == ["o", "category", "sku_name", "sku_name_2"] and files.detect_header(df, "o").count() == 1
    assert files.detect_header(df.where("o = 1"), "o").columns == ["o", "category", "mc", "sku_name"]


def test_empty_tables(spark):
    t = Tables(spark, SF)
    none = t.ih.where("false")
    assert history.sku_history(none, AS_OF).count() == 0
    assert history.monthly_series(none, ["country"], AS_OF).count() == 0
    assert ranking.country_rankings(none, TOP_RETAILERS, AS_OF).count() == 0
    assert retail.recommendations(t.psi.where("false"), t.psi.select("product_type", "product_group_key").limit(0)).count() == 0


def test_no_cartesian_product_in_history(spark):
    t = Tables(spark, SF)
    plan = history.sku_history(t.ih, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_containing_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    needles, texts = sorted({word(rng.randrange(4)) for _ in range(20)}), sorted({word(rng.randrange(12)) for _ in range(60)})
    got = containing.containing(
        spark.createDataFrame([(x_,) for x_ in [*needles, None]], "needle string"), "needle", spark.createDataFrame([(x_,) for x_ in [*texts, *texts, None]], "text string"), "text"
    )
    assert sorted(map(tuple, got.collect())) == sorted((n, t) for n in needles for t in texts if n and n in t)
    none = spark.createDataFrame([], "needle string")
    assert containing.containing(none, "needle", none.withColumnRenamed("needle", "text"), "text").count() == 0


def test_brands_inside_words_and_factories(spark):
    targets = spark.createDataFrame([("Kellogg corn flakes 500 g", "Kellogg"), ("Cola zero", "Cola"), ("Red Bull drink", "Red Bull"), ("Olive oil", "")], "target string, brand string")
    rows = [("Kelloggs corn flakes", "x"), ("Kellogg corn", "x"), ("CocaCola zero", None), ("drink", "REDBULL GmbH"), ("water", "REDBULL GmbH"), ("red bull water", "REDBULL GmbH"), (None, "y")]
    candidates = spark.createDataFrame(rows, "candidate string, factory string")
    met = {(r.target, r.candidate) for r in matching.pairs(targets, candidates).collect()}
    assert met == {("Kellogg corn flakes 500 g", "Kelloggs corn flakes"), ("Kellogg corn flakes 500 g", "Kellogg corn"), ("Cola zero", "CocaCola zero"), ("Red Bull drink", "red bull water")}
    told = {(r.target, r.candidate) for r in matching.factory_fallback(targets, candidates).collect()}
    assert told == {("Red Bull drink", "drink")}


def test_alike_items_by_brute_force(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))
    products, items = sorted({name() for _ in range(60)}), sorted({name() for _ in range(40)})
    df = lambda rows, a, b: spark.createDataFrame([(r, r) for r in rows], f"{a} string, {b} string")
    got = {(r["product"], r["item"]): r.s for r in costing.alike(df(products, "product", "p"), df(items, "item", "i"), 0.34).collect()}
    grams = lambda w: {w[k : k + 2] for k in range(len(w) - 1)} or {w}
    want = {(p, i): len(grams(p) & grams(i)) / len(grams(p) | grams(i)) for p in products for i in items}
    assert got == {k: v for k, v in want.items() if v >= 0.34}


def test_knn_by_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[10] = v[20]
    rows = [(i, x_.tolist()) for i, x_ in enumerate(v)] + [(900, [0.0] * 8), (901, None)]
    refs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = search.knn(refs.where("vec_id % 50 = 0 or vec_id = 901").withColumnRenamed("vec_id", "query_id"), refs, 3).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        want = sorted((-round(float(s), 9), i) for i, s in enumerate(unit @ unit[q]))[:3]
        assert [(-round(r.score, 9), r.ref_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in got} == set(range(0, 300, 50))


def test_canonical_importer_cleans_a_name_once(spark):
    """The branches on aliases share one cleaned name, and give what a plain version gives."""
    names = ["(주)이마트24 ", "농업회사법인 emart x", "이랜드팜", "하이랜드", "LOTTE  MART", "costco", "(주) 홈플러스 ", "a\nb", "  ", None, "x 쿠팡(주) y", "주식회사 무명", "COUPANG Corp."]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    named = df.select("n", x.canonical_importer(F.col("n")).alias("i"), x.canonical_alias(F.col("n")).alias("a"))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 12  # 749 when each branch cleaned the name again

    def plain(cleaned, raw):
        group = [(a.lstrip("^").lower(), a.startswith("^"), name) for name, g in x.IMPORTER_ALIASES.items() for a in g]
        found = [n for a, _, n in group if cleaned == a] + [n for a, _, n in group if raw == a]
        found += [n for a, start, n in sorted(group, key=lambda g: -len(g[0])) if (cleaned.startswith(a) if start else a in cleaned or a in raw)]
        return found[0] if found else None

    for r in named.collect():
        legal = re.sub(r"\s+", " ", re.sub(x.LEGAL_MARKS, "", r.n or "")).strip()
        assert r.i == (plain(legal.lower(), r.n.strip(" ").lower()) or legal if legal else None)
        bare = (r.n or "").strip()
        assert r.a == (plain(bare.lower(), bare.lower()) or bare if bare else None)


def test_country_amounts_are_made_from_the_records_once(spark):
    """What reads the amounts sees a plain scan, however often, not the join of all records again."""
    t = Tables(spark, SF)
    amounts = t.cia
    plan = costing.resolve_origin(amounts.select(F.col("item_name").alias("item"), F.col("country").alias("origin")), amounts, ["NATION_1"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "l_orderkey" not in plan
    again = t.view("country_item_amount", import_history=t.ih)
    assert sorted(map(tuple, amounts.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_line_items_meet_orders_that_have_their_customers(spark):
    """The join with the customers is done before the line items come in, so it deals out none of them."""
    lines = Tables(spark, SF).ih._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(lines) if "Join Inner, (c_custkey" in line)
    depth = lines[at].index("Join")
    below = []
    for line in lines[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    assert "o_orderkey" in "".join(below) and "l_orderkey" not in "".join(below)


def test_refresh_reads_the_records_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(v):
        read.add(1)
        return v

    ih = Tables(spark, SF).ih
    n = ih.count()
    tables.refresh(ih.withColumn("sku_name", seen("sku_name")), str(tmp_path / "out"), AS_OF)
    assert read.value == n  # twice before
    kept = lambda df: sorted(map(tuple, df.collect()), key=str)
    own = versions.read(spark, str(tmp_path / "out"), "sku_factory")
    assert own.columns == history.sku_factory(ih).columns and kept(own) == kept(history.sku_factory(ih))
    own = versions.read(spark, str(tmp_path / "out"), "sku_history")
    assert own.columns == history.sku_history(ih, AS_OF).columns and kept(own) == kept(history.sku_history(ih, AS_OF))
