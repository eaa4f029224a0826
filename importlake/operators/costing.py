"""Landed cost: product to customs item, origin, price per kilogram, tariff, cost in won."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators.containing import containing
from importlake.operators.enrich import enrich_snapshot
from importlake.sources.staging import staged

# Names too general for a match, short names that may match, endings of processed forms.
GENERAL_ITEMS = ["기타", "기타식품", "기타가공품", "기타 가공품", "혼합제제", "기타류"]
SHORT_ITEMS = ["잼"]
PROCESSED = ["오일", "씨유", "잼", "페스토", "에이드", "주스", "완탕", "버터", "드레싱", "시럽", "식초", "크래커", "케찹", "케첩"]
SPELLINGS = {"케찹": "케첩"}
FALLBACKS = {
    "과자": ["크래커", "칩스", "칩", "비스킷", "프레첼", "팝콘", "그래놀라", "시리얼", "스낵믹스", "그레이엄", "크런치", "토스트", "모나카", "마카롱", "쿠키", "퍼프콘"],
    "캔디류": ["젤리", "구미"],
    "초콜릿가공품": ["초콜릿", "누텔라"],
    "조제커피": ["커피"],
}
LIKE_ENOUGH = 0.34
# Rates of the estimate.
ASSUMPTIONS = {"won_per_dollar": 1380.0, "freight_share": 0.0, "broker_share": 0.02, "logistics_share": 0.015, "vat": 0.0}
BASE_RATE = "A"


def item_key(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    for a, b in SPELLINGS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def alike(names: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(product, item, s): pairs of (product, p) and (item, i) whose bigrams have a Jaccard similarity of ``least`` or more.

    With all bigrams in one order, those rare among the items first, two like sets share one among the first of either that
    leave less than ``least`` of it; only these are joined, so common bigrams join nothing but what consists of them.
    """
    of_item = known.select("item", F.explode(x.bigrams(F.col("i"))).alias("g"))
    rare = of_item.groupBy("g").agg(F.count("*").alias("df"))

    def first(rows: DataFrame, key: str, grams: Column) -> DataFrame:
        each = rows.select(key, F.explode(grams).alias("g")).join(rare, "g", "left")
        ordered = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("o"))
        whole = F.transform("o", lambda v: v["g"]).alias(f"{key}_grams")
        head = F.slice("o", F.lit(1), F.size("o") - F.ceil(F.size("o") * least - 1e-9).cast("int") + 1)
        return ordered.select(key, whole, F.explode(F.transform(head, lambda v: v["g"])).alias("g"))

    p, q = first(names, "product", x.bigrams(F.col("p"))), first(known, "item", x.bigrams(F.col("i")))
    met = p.join(q, "g").drop("g").distinct()
    return met.select("product", "item", x.bigram_jaccard(F.col("product_grams"), F.col("item_grams")).alias("s")).where(F.col("s") >= least)


def match_item(
    products: DataFrame, items: DataFrame, manual: DataFrame | None = None, processed: list[str] | None = None, fallbacks: dict[str, list[str]] | None = None,
    general: list[str] | None = None, least: float = LIKE_ENOUGH,
) -> DataFrame:
    """(product, item, confidence, method) for each distinct ``product`` against the customs items (``item``).

    A product given by hand first; then the longest item name that the product's name contains (of medium confidence where
    the product is a processed form and the item its raw material); then the most alike by bigrams; then a general item by a
    keyword. Products and items are distinct before they meet.
    """
    # Each tier looks at what the one before left over, so both sides are read several times.
    names = staged(products.select("product").where("product is not null").distinct().withColumn("p", item_key(F.col("product"))))
    known = staged(items.select("item").where("item is not null").distinct().where(~F.col("item").isin(general or GENERAL_ITEMS)).withColumn("i", item_key(F.col("item"))))
    endings = [e for e in (processed or PROCESSED)]
    bare = item_key(F.regexp_replace("product", r"(\s*\([^()]*\))+\s*$", ""))
    is_processed = F.exists(F.array(*[item_key(F.lit(e)) for e in endings]), lambda e: F.endswith(bare, e))
    item_processed = F.exists(F.array(*[item_key(F.lit(e)) for e in endings]), lambda e: F.contains(F.col("i"), e))

    inside = known.where((F.length("item") >= 2) | F.col("item").isin(SHORT_ITEMS))
    held = names.join(containing(inside, "i", names, "p"), "p").join(inside, "i")
    held = held.withColumn("raw", is_processed & ~item_processed)
    held = held.groupBy("product").agg(F.max_by(F.struct("item", "raw"), F.struct(F.length("item"), "item")).alias("b")).select(
        "product", "b.item", F.when(F.col("b.raw"), "medium").otherwise("high").alias("confidence"), F.when(F.col("b.raw"), "contained_raw").otherwise("contained").alias("method")
    )
    rest = names.join(held, "product", "left_anti")
    scored = alike(rest, known, least)
    like = scored.groupBy("product").agg(F.min_by("item", F.struct((-F.col("s")), "item")).alias("item")).select("product", "item", F.lit("medium").alias("confidence"), F.lit("alike").alias("method"))
    rest = rest.join(like, "product", "left_anti")
    label = F
    for item, words in (fallbacks or FALLBACKS).items():
        label = label.when(F.exists(F.array(*[item_key(F.lit(w)) for w in words]), lambda w: F.contains(F.col("p"), w)), item)
    fallback = rest.withColumn("item", label.otherwise(None)).join(known.select("item"), "item", "left_semi").select("product", "item", F.lit("low").alias("confidence"), F.lit("keyword").alias("method"))
    found = held.unionByName(like).unionByName(fallback)
    if manual is not None:
        sure = manual.groupBy("product").agg(F.min("item").alias("item")).select("product", "item", F.lit("high").alias("confidence"), F.lit("manual").alias("method"))
        found = sure.unionByName(found.join(sure, "product", "left_anti"))
    return names.select("product").join(found, "product", "left").select(
        "product", "item", F.coalesce("confidence", F.lit("none")).alias("confidence"), F.coalesce("method", F.lit("none")).alias("method")
    )


def resolve_origin(df: DataFrame, cia: DataFrame, countries: list[str], longest_match: bool = False) -> DataFrame:
    """(origin, item) to one ``country``: the one named, or of several the one with the largest amount of the item, ties and no item: the first named. ``longest_match``: a name inside a longer one doesn't count."""
    pairs = df.select("origin", "item").distinct().withColumn("found", x.countries_in_text(F.col("origin"), countries, longest_match))
    named = pairs.select("origin", "item", F.posexplode("found").alias("at", "country"))
    amounts = cia.select(F.col("country"), F.col("item_name").alias("item"), "amount_usd_k")
    best = F.max_by("country", F.struct(F.coalesce("amount_usd_k", F.lit(0.0)), -F.col("at")))
    chosen = named.join(amounts, ["country", "item"], "left").groupBy("origin", "item").agg(best.alias("country"))
    keyed = chosen.select(F.col("origin").alias("o"), F.col("item").alias("i"), "country")
    return df.join(keyed, df["origin"].eqNullSafe(keyed["o"]) & df["item"].eqNullSafe(keyed["i"]), "left").drop("o", "i")


def price_per_kg(df: DataFrame, cia: DataFrame) -> DataFrame:
    """The import price of the country's item in dollars a kilogram; null without weight."""
    prices = cia.select("country", F.col("item_name").alias("item"), F.try_divide(F.col("amount_usd_k"), F.nullif(F.col("weight_ton"), F.lit(0.0))).alias("usd_per_kg"))
    return df.join(prices, ["country", "item"], "left")


def purchase_price(df: DataFrame, unit: str = "unit") -> DataFrame:
    """The price of a piece where its size is known, else that of a kilogram."""
    kg = x.unit_to_kg(F.col(unit))
    return df.withColumns({"purchase_usd": F.when(kg.isNotNull(), F.col("usd_per_kg") * kg).otherwise(F.col("usd_per_kg")), "is_per_kg": F.when(F.col("usd_per_kg").isNotNull(), kg.isNull())})


def rate_label(kind: Column, rate: Column) -> Column:
    """``basic 8%`` or ``agreement (F1) 2.5%``, the rate without needless zeros."""
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", rate.cast("double")), "0+$", ""), r"\.$", "")
    return F.concat(F.when(kind == BASE_RATE, F.lit("기본세율 ")).otherwise(F.concat(F.lit("FTA 협정세율("), kind, F.lit(") "))), number, F.lit("%"))


def resolve_tariff(items: DataFrame, tariffs: DataFrame, fta: DataFrame, on_date: datetime.date, extra_codes: list[str] | None = None) -> DataFrame:
    """Add rate_pct, rate_type and basis_label: the lowest rate valid on a date for the item's ``hs_code`` and ``country``.

    Candidates are the base rate and those of the country's agreements (``fta``: country, rate_type); of equal rates the base rate, then the first
    code. ``tariffs`` and ``fta`` are reference tables; the distinct codes and countries are resolved, then joined back.
    """
    valid = tariffs.where((F.col("effective_from").isNull() | (F.col("effective_from") <= F.lit(on_date))) & (F.col("effective_to").isNull() | (F.col("effective_to") >= F.lit(on_date))))
    wanted = items.select("hs_code", "country").where("hs_code is not null").distinct()
    general = F.col("rate_type").isin(BASE_RATE, *(extra_codes or []))
    open_rates = wanted.join(valid.where(general), "hs_code")
    agreed = wanted.join(fta.distinct(), "country").join(valid.where(~general), ["hs_code", "rate_type"])
    place = F.struct("rate_pct", F.when(F.col("rate_type") == BASE_RATE, 0).otherwise(1), "rate_type")
    columns = ["hs_code", "country", "rate_type", "rate_pct"]
    best = open_rates.select(*columns).unionByName(agreed.select(*columns)).groupBy("hs_code", "country").agg(F.min_by(F.struct("rate_pct", "rate_type"), place).alias("b"))
    keyed = best.select(F.col("hs_code").alias("h"), F.col("country").alias("c"), "b.rate_pct", "b.rate_type").withColumn("basis_label", rate_label(F.col("rate_type"), F.col("rate_pct")))
    return items.join(keyed, (items["hs_code"] == keyed["h"]) & items["country"].eqNullSafe(keyed["c"]), "left").drop("h", "c")


def landed_cost(df: DataFrame, assumptions: dict | None = None) -> DataFrame:
    """The landed cost in whole won, halves to even; null without price or tariff."""
    a = ASSUMPTIONS | (assumptions or {})
    value = F.col("purchase_usd") * a["won_per_dollar"] * (1 + a["freight_share"])
    duty = value * F.col("rate_pct") / 100
    total = value + duty + value * a["broker_share"] + value * a["logistics_share"] + (value + duty) * a["vat"]
    return df.withColumn("landed_won", F.bround(total, 0))


def pick_text(df: DataFrame, columns: list[str], matches: DataFrame) -> DataFrame:
    """The first of some texts that matched an item, else the first that isn't blank, as ``match_text``."""
    hit = matches.where("item is not null").select(F.col("product").alias("t"), F.lit(True).alias("ok"))
    for k, c in enumerate(columns):
        df = df.join(hit.select(F.col("t").alias(f"__t{k}"), F.col("ok").alias(f"__ok{k}")), F.col(c) == F.col(f"__t{k}"), "left")
    matched = F.coalesce(*[F.when(F.col(f"__ok{k}"), F.col(c)) for k, c in enumerate(columns)])
    plain = F.coalesce(*[x.blank_to_null(F.col(c)) for c in columns])
    return df.withColumn("match_text", F.coalesce(matched, plain)).drop(*[f"__{p}{k}" for k in range(len(columns)) for p in ("t", "ok")])


def recompute_costs(
    rows: DataFrame, texts: list[str], cia: DataFrame, tariffs: DataFrame, fta: DataFrame, countries: list[str], on_date: datetime.date, assumptions: dict | None = None, manual: DataFrame | None = None, **matching
) -> DataFrame:
    """Add the estimate to rows with ``origin``, ``hs_code``, ``unit`` and some texts. Each step works on distinct inputs and is joined back."""
    rows, cia = staged(rows), staged(cia)
    names = rows.select(F.explode(F.array(*texts)).alias("product"))
    matches = staged(match_item(names, cia.select(F.col("item_name").alias("item")), manual, **matching))
    picked = pick_text(rows, texts, matches)
    with_item = picked.join(matches.select(F.col("product").alias("match_text"), "item", "confidence"), "match_text", "left")
    with_origin = resolve_origin(with_item, cia, countries, longest_match=True)
    priced = purchase_price(price_per_kg(with_origin, cia))
    digits = priced.withColumn("hs_code", x.hs_digits(F.col("hs_code")))
    return landed_cost(resolve_tariff(digits, tariffs, fta, on_date), assumptions)


def priced_snapshot(
    snapshot: DataFrame, brands: DataFrame, codes: DataFrame, origins: DataFrame, cia: DataFrame, tariffs: DataFrame, fta: DataFrame, countries: list[str], on_date: datetime.date, **matching
) -> DataFrame:
    """A crawl snapshot with what the caches know of its brands, customs codes and ``origin``, and from these its tariff and landed cost.

    Rows have ``brand``, ``title``, ``url``, ``product_type`` and ``unit``. Without a code there is no tariff, without a tariff or price no cost; whether a
    cost is one of a kilogram is told only where there is a cost.
    """
    known = enrich_snapshot(snapshot, brands, codes, origins)
    costed = recompute_costs(known, ["product_type"], cia, tariffs, fta, countries, on_date, **matching)
    return costed.withColumn("is_per_kg", F.when(F.col("landed_won").isNotNull(), F.col("is_per_kg")))


def cost_reason(df: DataFrame) -> Column:
    """Why a row has no cost: the first thing that is missing, in the order of the estimate."""
    return (
        F.when(F.col("hs_code").isNull(), "no_hs_code").when(F.col("rate_pct").isNull(), "no_tariff").when(F.col("item").isNull(), "no_item")
        .when(F.col("country").isNull(), "no_origin").when(F.col("usd_per_kg").isNull(), "no_price").otherwise("estimated")
    )


def cost_coverage(costed: DataFrame) -> DataFrame:
    return costed.groupBy(cost_reason(costed).alias("reason")).agg(F.count("*").alias("rows"))
