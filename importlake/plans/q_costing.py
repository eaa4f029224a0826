"""Queries of the landed-cost estimate."""

from __future__ import annotations

from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators import costing as k
from importlake.operators.containing import containing
from importlake.plans.registry import query
from importlake.plans.views import AS_OF

IH, CIA, TF = ("import_history",), ("country_item_amount",), ("tariff_rate", "fta_map")
NATIONS = [f"NATION_{i}" for i in range(25)]
#: Made for the driver's names: forms that end in "gear" are processed, "nut" goes to "ring" by keyword.
MATCHING = {"processed": ["gear"], "fallbacks": {"ring": ["nut", "pin"]}, "general": ["cog"]}


def products(t):
    return t.ih.select(F.col("sku_name").alias("product")).distinct()


def items(t):
    return t.cia.select(F.col("item_name").alias("item")).distinct()


ITEMS = "items as (select distinct item_name as item, lower(item_name) as i from country_item_amount where item_name <> 'cog')"
MATCH = f"""{ITEMS}, prods as (select distinct sku_name as product, replace(lower(sku_name), ' ', '') as p from import_history),
  held as (select product, item, case when ends_with(p, 'gear') and not contains(i, 'gear') then 'medium' else 'high' end as confidence,
    case when ends_with(p, 'gear') and not contains(i, 'gear') then 'contained_raw' else 'contained' end as method
    from prods join items on length(item) >= 2 and contains(p, i) qualify row_number() over (partition by product order by length(item) desc, item desc) = 1),
  rest as (select * from prods where product not in (select product from held)),
  pg as (select distinct product, substr(p, u, 2) as g from (select product, p, unnest(generate_series(1, length(p) - 1)) as u from rest)),
  ig as (select distinct item, substr(i, u, 2) as g from (select item, i, unnest(generate_series(1, length(i) - 1)) as u from items)),
  alike as (select pg.product, ig.item, count(*) * 1.0 / ((select count(*) from pg a where a.product = pg.product) + (select count(*) from ig b where b.item = ig.item) - count(*)) as s from pg join ig using (g) group by pg.product, ig.item),
  liked as (select product, item, 'medium' as confidence, 'alike' as method from alike where s >= 0.34 qualify row_number() over (partition by product order by s desc, item) = 1),
  kw as (select product, 'ring' as item, 'low' as confidence, 'keyword' as method from rest where product not in (select product from liked) and (contains(p, 'nut') or contains(p, 'pin')) and 'ring' in (select item from items)),
  found as (select * from held union all select * from liked union all select * from kw),
  matched as (select prods.product, item, coalesce(confidence, 'none') as confidence, coalesce(method, 'none') as method from prods left join found using (product))"""


@query("k1_match_item", f", {MATCH} select * from matched", CIA)
def _(t):
    return k.match_item(products(t), items(t), **MATCHING)


def origins(t):
    return t.cia.select(F.col("item_name").alias("item"), F.concat_ws(" / ", F.lit("blend"), F.col("country"), F.lit("NATION_4")).alias("origin")).unionByName(
        t.cia.select(F.col("item_name").alias("item"), F.lit("unknown").alias("origin")).distinct()
    )


ORIGIN = """ o as (select item_name as item, 'blend / ' || country || ' / NATION_4' as origin, country from country_item_amount),
  named as (select o.item, o.origin, c.country, case when c.country = 'NATION_4' then length('blend / ' || o.country || ' / ') else length('blend / ') end as place, -length(c.country) as len from o join (select distinct 'NATION_' || cast(n_nationkey as varchar(9)) as country from nation) c on contains(o.origin, c.country)),
  best as (select named.item, origin, named.country from named left join country_item_amount a on a.country = named.country and a.item_name = named.item
    qualify row_number() over (partition by named.item, origin order by coalesce(amount_usd_k, 0) desc, place, len) = 1)"""


@query("k2_resolve_origin", f",{ORIGIN} select item, origin, country from best union all select distinct item_name, 'unknown', cast(null as varchar) from country_item_amount", CIA)
def _(t):
    return k.resolve_origin(origins(t), t.cia, NATIONS).select("item", "origin", "country")


@query("k3_price_per_kg", "select country, item_name as item, amount_usd_k / nullif(weight_ton, 0) as usd_per_kg from country_item_amount", CIA)
def _(t):
    return k.price_per_kg(t.cia.select("country", F.col("item_name").alias("item")), t.cia).select("country", "item", "usd_per_kg")


@query("k4_purchase_price", ", u as (select distinct country, coalesce(mc, 'ring') as item, unit from import_history where country is not null) select u.country, item, unit, round(case when unit like '% oz' then amount_usd_k / weight_ton * cast(split_part(unit, ' ', 1) as double) * 0.028349523125 else amount_usd_k / weight_ton end, 6) as purchase_usd, case when weight_ton is not null then coalesce(unit not like '% oz', true) end as is_per_kg from u join country_item_amount a on a.country = u.country and a.item_name = u.item", CIA)
def _(t):
    rows = t.ih.where("country is not null").select("country", F.coalesce("mc", F.lit("ring")).alias("item"), "unit").distinct()
    return k.purchase_price(k.price_per_kg(rows, t.cia)).select("country", "item", "unit", F.round("purchase_usd", 6).alias("purchase_usd"), "is_per_kg")


CODED = "coded as (select distinct country, nullif(regexp_replace(hs_code, '\\D', '', 'g'), '') as hs_code from import_history)"
VALID = "valid as (select * from tariff_rate where (effective_from is null or effective_from <= date '2001-06-30') and (effective_to is null or effective_to >= date '2001-06-30'))"
RESOLVED = f"""{CODED}, {VALID}, cand as (select coded.country, coded.hs_code, v.rate_type, rate_pct from coded join valid v on v.hs_code = coded.hs_code where v.rate_type = 'A' or exists (select 1 from fta_map f where f.country = coded.country and f.rate_type = v.rate_type and v.rate_type <> 'C')),
  lowest as (select * from cand qualify row_number() over (partition by country, hs_code order by rate_pct, case when rate_type = 'A' then 0 else 1 end, rate_type) = 1),
  tariffed as (select coded.*, rate_pct, lowest.rate_type, case when lowest.rate_type = 'A' then '기본세율 ' else 'FTA 협정세율(' || lowest.rate_type || ') ' end || regexp_replace(regexp_replace(printf('%.6f', rate_pct), '0+$', ''), '\\.$', '') || '%' as basis_label
    from coded left join lowest on coded.country is not distinct from lowest.country and coded.hs_code = lowest.hs_code)"""


def coded(t):
    return t.ih.select("country", x.hs_digits(F.col("hs_code")).alias("hs_code")).distinct()


@query("k5_resolve_tariff", f", {RESOLVED} select * from tariffed", ("import_history", *TF))
def _(t):
    return k.resolve_tariff(coded(t), t.tariffs, t.fta, AS_OF)


@query("d12_temporal_join", f", {RESOLVED} select hs_code, min(rate_pct) as lowest_pct, count(*) as countries from tariffed where rate_pct is not null group by 1", ("import_history", *TF))
def _(t):
    return k.resolve_tariff(coded(t), t.tariffs, t.fta, AS_OF).where("rate_pct is not null").groupBy("hs_code").agg(F.min("rate_pct").alias("lowest_pct"), F.count("*").alias("countries"))


@query("k6_landed_cost", "select p_partkey, round_even(p_retailprice * 1380.0 * 1.0 + p_retailprice * 1380.0 * (p_size % 9) / 100 + p_retailprice * 1380.0 * 0.02 + p_retailprice * 1380.0 * 0.015, 0) as landed_won from part")
def _(t):
    rows = t.raw("part").select("p_partkey", F.col("p_retailprice").alias("purchase_usd"), (F.col("p_size") % 9).cast("double").alias("rate_pct"))
    return k.landed_cost(rows).select("p_partkey", "landed_won")


@query("k7_pick_text", f", {MATCH}, hit as (select product from matched where item is not null), r as (select distinct mc, sku_name from import_history) select r.mc, r.sku_name, coalesce(case when a.product is not null then r.mc end, case when b.product is not null then r.sku_name end, r.mc, r.sku_name) as match_text from r left join hit a on a.product = r.mc left join hit b on b.product = r.sku_name", CIA)
def _(t):
    rows = t.ih.select("mc", "sku_name").distinct()
    return k.pick_text(rows, ["mc", "sku_name"], k.match_item(products(t), items(t), **MATCHING))


COSTED = f"""{MATCH}, {RESOLVED}, base as (select distinct sku_name, country, unit, nullif(regexp_replace(hs_code, '\\D', '', 'g'), '') as hs_code from import_history),
  est as (select base.*, m.item, a.amount_usd_k, a.weight_ton, t.rate_pct, amount_usd_k / nullif(weight_ton, 0) as usd_per_kg,
    case when unit like '% oz' then amount_usd_k / nullif(weight_ton, 0) * (cast(split_part(unit, ' ', 1) as double) * 0.028349523125) else amount_usd_k / nullif(weight_ton, 0) end as purchase_usd
    from base left join matched m on m.product = base.sku_name left join country_item_amount a on a.country = base.country and a.item_name = m.item
    left join tariffed t on t.country is not distinct from base.country and t.hs_code is not distinct from base.hs_code)"""


def costed(t):
    rows = t.ih.select("sku_name", F.col("country").alias("origin"), "unit", "hs_code").distinct()
    return k.recompute_costs(rows, ["sku_name"], t.cia, t.tariffs, t.fta, exact_names(t), AS_OF, **MATCHING)


def exact_names(t):
    """The countries that occur, the longest names first, as a list of constants."""
    return sorted(NATIONS, key=lambda n: -len(n))


@query("k8_recompute_costs", f", {COSTED} select sku_name, country, unit, hs_code, item, round_even(purchase_usd * 1380.0 + purchase_usd * 1380.0 * rate_pct / 100 + purchase_usd * 1380.0 * 0.02 + purchase_usd * 1380.0 * 0.015, 0) as landed_won from est", ("country_item_amount", *TF))
def _(t):
    return costed(t).select("sku_name", "country", "unit", "hs_code", "item", "landed_won")


@query("d8_priced_snapshot", f""", {MATCH}, names as (select *, regexp_replace(replace(lower(product_name_en), ',', ' '), ' +', ' ', 'g') as name_key from product_sourcing_item),
  snap as (select id, split_part(product_name_en, ', ', 1) as sku_name, case when id % 4 <> 0 then unit end as unit, case when id % 3 <> 0 then 'NATION_' || cast(id % 25 as varchar) end as country,
    case when name_key in (select name_key from names where id % 2 = 0) then case when length(name_key) % 2 = 0 then '0100102000' else '090102000' end end as hs_code, case when brand_en like '%1' then '통과' end as recall_status from names),
  {RESOLVED.replace(CODED, 'coded as (select distinct country, hs_code from snap)')},
  est as (select snap.*, m.item, t.rate_pct, t.basis_label, amount_usd_k / nullif(weight_ton, 0) * case when unit like '% oz' then cast(split_part(unit, ' ', 1) as double) * 0.028349523125 else 1 end as purchase_usd
    from snap left join matched m on m.product = snap.sku_name left join country_item_amount a on a.country = snap.country and a.item_name = m.item
    left join tariffed t on t.country is not distinct from snap.country and t.hs_code = snap.hs_code)
  select id, recall_status, hs_code, country, item, rate_pct, basis_label, round_even(purchase_usd * 1380.0 + purchase_usd * 1380.0 * rate_pct / 100 + purchase_usd * 1380.0 * 0.02 + purchase_usd * 1380.0 * 0.015, 0) as landed_won,
    case when purchase_usd is not null and rate_pct is not null then unit is null end as is_per_kg from est""", ("product_sourcing_item", "country_item_amount", *TF))
def _(t):
    snap = t.psi.select("id", F.col("brand_en").alias("brand"), F.col("product_name_en").alias("title"), F.concat(F.lit("https://x.org/"), "id").alias("url"), F.split_part("product_name_en", F.lit(", "), F.lit(1)).alias("product_type"), F.expr("case when id % 4 <> 0 then unit end").alias("unit"))
    brands = snap.where("brand like '%1'").select(x.brand_key(F.col("brand")).alias("brand_key"), F.lit("통과").alias("recall_status")).distinct()
    key = x.name_key(F.col("title"))
    codes = snap.where("id % 2 = 0").select(key.alias("name_key"), F.when(F.length(key) % 2 == 0, "0100.10-2000").otherwise("0901.02000").alias("hs_code")).distinct()
    origins = snap.where("id % 3 <> 0").select(x.text_hash(F.col("url")).alias("url_hash"), F.concat(F.lit("NATION_"), (F.col("id") % 25).cast("string")).alias("origin"))
    costed = k.priced_snapshot(snap, brands, codes, origins, t.cia, t.tariffs, t.fta, exact_names(t), AS_OF, **MATCHING)
    return costed.select("id", "recall_status", "hs_code", "country", "item", "rate_pct", "basis_label", "landed_won", "is_per_kg")


@query("k9_cost_coverage", f", {COSTED} select case when hs_code is null then 'no_hs_code' when rate_pct is null then 'no_tariff' when item is null then 'no_item' when country is null then 'no_origin' when usd_per_kg is null then 'no_price' else 'estimated' end as reason, count(*) as rows from est group by 1", ("country_item_amount", *TF))
def _(t):
    return k.cost_coverage(costed(t))


@query("b38_fta_codes", "select n_name as country, string_agg(rate_type, '|' order by rate_type) as codes from nation left join fta_map on country = n_name group by 1", ("fta_map",))
def _(t):
    names = t.raw("nation").select(F.col("n_name").alias("country"))
    codes = t.fta.groupBy("country").agg(F.array_join(F.array_sort(F.collect_set("rate_type")), "|").alias("codes"))
    return names.join(codes, "country", "left")


@query("d13_contains_join", f", {ITEMS} select sku_name, item from (select distinct sku_name from import_history) join items on contains(sku_name, i)", CIA)
def _(t):
    known = items(t).where("item <> 'cog'")
    return containing(known, "item", t.ih, "sku_name").select("sku_name", "item")
