"""Queries of enrichment, upserts and table maintenance."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators import enrich as e
from importlake.operators import extensions as ext
from importlake.operators import history as h
from importlake.plans.q_history import K6, same
from importlake.plans.registry import query
from importlake.plans.views import AS_OF
from importlake.sources import tables as tb
from importlake.sources.staging import staged

IH, PSI, EMB, CIA = ("import_history",), ("product_sourcing_item",), ("product_embedding",), ("country_item_amount",)
CONTACTS = "select * from (values (1, 'Supplier#000000003', cast(null as varchar(9)), 'any@c.org', 'any.c.org'), (2, 'Supplier#000000003', 'NATION_1', 'nat@c.org', cast(null as varchar(9))), (3, 'Supplier#000000006 F1', cast(null as varchar(9)), 'f1@c.org', 'f1.c.org'), (4, 'Supplier#000000006', cast(null as varchar(9)), 'maker@c.org', 'm.c.org'), (5, 'Supplier#000000009', 'NATION_99', 'no@c.org', 'no')) as t(ordinal, factory, country, email, homepage)"


@query("d3_expression_join", ", p as (select sku_name, mc, category, count(*) as n from import_history group by 1, 2, 3) select p.sku_name, p.n, v.vec_id from p join product_embedding v on lower(trim(p.sku_name)) = lower(trim(v.sku_name)) and lower(trim(coalesce(p.category, ''))) = lower(trim(coalesce(v.category, '')))", ("import_history", "product_embedding"))
def _(t):
    p = t.ih.groupBy("sku_name", "mc", "category").agg(F.count("*").alias("n"))
    return e.expression_join(p, t.emb.select("sku_name", "category", "vec_id"), ["sku_name", "category"]).select("sku_name", "n", "vec_id")


def contact_sql(order: str) -> str:
    return f""", c as ({CONTACTS}), k as (select distinct factory, manufacturer, country from import_history),
      fits as (select k.*, c.email as ce, c.homepage as ch, c.country is not null as own, 1 as by_f, ordinal from k join c on c.factory = k.factory where c.country is null or c.country = k.country
        union all select k.*, c.email, c.homepage, c.country is not null, 0, ordinal from k join c on c.factory = k.manufacturer where c.country is null or c.country = k.country),
      best as (select * from fits qualify row_number() over (partition by factory, manufacturer, country order by own desc, by_f desc, ordinal desc) = 1)
      select i.factory, i.manufacturer, i.country, {order.format('email', 'ce')} as email, {order.format('homepage', 'ch')} as homepage, count(*) as n from import_history i left join best b on {same('i', 'b', ['factory', 'manufacturer', 'country'])} group by 1, 2, 3, 4, 5"""


@query("d4_enrich_contacts", contact_sql("coalesce(i.{0}, {1})"), IH)
def _(t):
    return e.enrich_contacts(t.ih, t.spark.sql(CONTACTS)).groupBy("factory", "manufacturer", "country", "email", "homepage").agg(F.count("*").alias("n"))


@query("d4_overwrite_contacts", contact_sql("coalesce({1}, i.{0})"), IH)
def _(t):
    return e.enrich_contacts(t.ih, t.spark.sql(CONTACTS), overwrite=True).groupBy("factory", "manufacturer", "country", "email", "homepage").agg(F.count("*").alias("n"))


NAMES = "select distinct sku_name, factory, importer, upper(sku_name) || ' ' || coalesce(importer, '') as sku_name_en, length(importer) as ordinal from import_history where mc = 'bolt'"


@query("d5_enrich_english", f", n as ({NAMES}), last as (select sku_name, factory, importer, max(sku_name_en) as en from n group by 1, 2, 3) select i.sku_name, i.factory, i.importer, en as sku_name_en, count(*) as n from import_history i left join last l on i.sku_name = l.sku_name and i.factory = l.factory and i.importer = l.importer group by 1, 2, 3, 4", IH)
def _(t):
    names = t.ih.where("mc = 'bolt'").select("sku_name", "factory", "importer", F.concat(F.upper("sku_name"), F.lit(" "), F.coalesce("importer", F.lit(""))).alias("sku_name_en"), F.length("importer").alias("ordinal")).distinct()
    return e.enrich_english(t.ih, names).groupBy("sku_name", "factory", "importer", "sku_name_en").agg(F.count("*").alias("n"))


def hs_file(t):
    return t.psi.where("id % 3 = 0").select(F.col("id").alias("ordinal"), "product_type", "retailer", F.expr("case when id % 5 = 0 then rank + 100000 else rank end").alias("rank"), F.expr("case when id % 7 = 0 then '-' else '01.' || cast(id as string) end").alias("hs_code"), F.expr("case when id % 2 = 0 then 'high' else 'low' end").alias("confidence"))


FILE = "f as (select id as ordinal, product_type, retailer, case when id % 5 = 0 then rank + 100000 else rank end as rank, case when id % 7 = 0 then null else '01' || cast(id as varchar(9)) end as code, case when id % 2 = 0 then 'high' else 'low' end as confidence from product_sourcing_item where id % 3 = 0)"


@query("d6_apply_hs", f", {FILE} select p.id, code as hs_code from product_sourcing_item p left join f on f.product_type = p.product_type and f.retailer = p.retailer and f.rank = p.rank and confidence = 'high' and code is not null", PSI)
def _(t):
    return e.apply_hs(t.psi, hs_file(t))[0].select("id", "hs_code")


@query("d6_hs_misses", f", {FILE} select ordinal, case when code is null then 'no_code' when confidence <> 'high' then 'low_confidence' else 'no_row' end as reason from f where code is null or confidence <> 'high' or rank > 100000", PSI)
def _(t):
    return e.apply_hs(t.psi, hs_file(t))[1].select("ordinal", "reason")


@query("d7_apply_hs_by_sku", "select sku_name, case when mc = 'bolt' then '010203' else nullif(hs_code, '') end as hs_code, count(*) as n from import_history group by 1, 2", IH)
def _(t):
    file = t.ih.where("mc = 'bolt'").select("sku_name").distinct().select("sku_name", F.lit("01.02-03").alias("hs_code"), F.lit("high").alias("confidence"), F.lit(1).alias("ordinal"))
    return e.apply_hs_by_sku(t.ih, file)[0].groupBy("sku_name", "hs_code").agg(F.count("*").alias("n"))


@query("d8_enrich_snapshot", ", snap as (select id, lower(brand_en) as brand_key, regexp_replace(replace(lower(product_name_en), ',', ' '), ' +', ' ', 'g') as name_key from product_sourcing_item) select id, brand_key, name_key, '통과' as recall_status, case when name_key in (select name_key from snap where id % 2 = 0) then '010203' end as hs_code, case when id % 3 = 0 then 'Y' end as origin_ok from snap", PSI)
def _(t):
    snap = t.psi.select("id", F.col("brand_en").alias("brand"), F.col("product_name_en").alias("title"), F.concat(F.lit("https://x.org/"), "id").alias("url"))
    brands = snap.select(x.brand_key(F.col("brand")).alias("brand_key"), F.lit("통과").alias("recall_status")).distinct()
    codes = snap.where("id % 2 = 0").select(x.name_key(F.col("title")).alias("name_key"), F.lit("010203").alias("hs_code")).distinct()
    origins = snap.where("id % 3 = 0").select(x.text_hash(F.col("url")).alias("url_hash"), F.lit("Y").alias("origin_ok"))
    return e.enrich_snapshot(snap, brands, codes, origins).select("id", "brand_key", "name_key", "recall_status", "hs_code", "origin_ok")


@query("d9_embedding_backlog", ", p as (select distinct sku_name, mc, category from import_history), h as (select distinct sku_name, mc, category from product_embedding where status <> 'failed') select p.* from p where not exists (select 1 from h where h.sku_name = p.sku_name and h.mc is not distinct from p.mc and h.category = p.category)", ("import_history", "product_embedding"))
def _(t):
    products = t.ih.select("sku_name", "mc", "category").distinct()
    return e.embedding_backlog(products, t.emb, "m64", retry_failed=True).select("sku_name", "mc", "category")


@query("d23_missing_embeddings", ", p as (select distinct sku_name, mc, category from import_history), h as (select distinct sku_name, mc, category from product_embedding where status = 'completed') select p.* from p where not exists (select 1 from h where h.sku_name = p.sku_name and coalesce(h.mc, '') = coalesce(p.mc, '') and h.category = p.category)", ("import_history", "product_embedding"))
def _(t):
    return e.missing_embeddings(t.ih.select("sku_name", "mc", "category").distinct(), t.emb)


@query("g9_sample_order", ", p as (select distinct sku_name, mc, category from import_history) select sku_name, mc, category from p order by md5(sku_name), sku_name limit 10", IH)
def _(t):
    return e.sample_order(t.ih.select("sku_name", "mc", "category").distinct(), "random").limit(10)


#: Coarse prices, some of them three or six thousandths apart: the first two are one price, the last is another.
COARSE = "floor(price_usd / 60) + ({} % 3) * 0.003e0"


@query("d10_pair_cards", f""", c as (select id as card_id, retailer, brand_en, case when id % 5 <> 0 then {COARSE.format('id')} end as price, row_number() over (partition by retailer, brand_en order by id) as n from product_sourcing_item),
  r as (select retailer, brand_en, list({{'id': id, 'price': {COARSE.format('(id + 1)')}}} order by id) as raws from product_sourcing_item where id % 11 <> 0 group by 1, 2)
  select card_id, raw_id, "by" from (with recursive g as (
    select retailer, brand_en, raws, cast(0 as bigint) as n, cast([] as bigint[]) as used, cast(null as bigint) as card_id, cast(null as bigint) as raw_id, cast(null as varchar) as "by" from r
    union all
    select retailer, brand_en, raws, n, list_append(used, coalesce(hit, free)), card_id, coalesce(hit, free), case when hit is not null then 'price' when free is not null then 'order' end
    from (select g.retailer, g.brand_en, g.raws, c.n, g.used, c.card_id,
        list_filter(g.raws, lambda x: not list_contains(g.used, x.id) and abs(x.price - c.price) < 0.005)[1].id as hit, list_filter(g.raws, lambda x: not list_contains(g.used, x.id))[1].id as free
      from g join c on c.retailer = g.retailer and c.brand_en = g.brand_en and c.n = g.n + 1)) select * from g) where raw_id is not null""", PSI)
def _(t):
    cards = t.psi.select(F.col("id").alias("card_id"), "retailer", "brand_en", F.expr(f"case when id % 5 <> 0 then {COARSE.format('id')} end").alias("price_usd"))
    raw = t.psi.where("id % 11 <> 0").select(F.col("id").alias("raw_id"), "retailer", "brand_en", F.expr(COARSE.format("(id + 1)")).alias("price_usd"))
    return e.pair_cards(cards, raw, ("retailer", "brand_en"))


@query("d14_mark_members", ", o as (select distinct sku_name, coalesce(importer, '') as importer, coalesce(mc, '') as mc from import_history where import_type = 'OEM') select i.sku_name, i.importer, i.mc, o.sku_name is not null as is_oem, count(*) as n from import_history i left join o on i.sku_name = o.sku_name and coalesce(i.importer, '') = o.importer and coalesce(i.mc, '') = o.mc group by 1, 2, 3, 4", IH)
def _(t):
    return e.mark_members(t.ih, t.ih.where("import_type = 'OEM'"), ["sku_name", "importer", "mc"]).groupBy("sku_name", "importer", "mc", "is_oem").agg(F.count("*").alias("n"))


MAPPING = "select * from (values ('ECONOMY', 'E'), ('STANDARD', 'S')) as t(item_type, mc)"


@query("d15_map_mc", f", m as ({MAPPING}) select id, split_part(product_type, ' ', 1) as item_type, m.mc from product_sourcing_item left join m on m.item_type = split_part(product_type, ' ', 1)", PSI)
def _(t):
    return e.map_mc(t.psi.select("id", F.split_part("product_type", F.lit(" "), F.lit(1)).alias("item_type")), t.spark.sql(MAPPING), "item_type")


@query("d16_amount_weight", "select a.country, a.item_name, a.amount_usd_k, b.weight_ton from country_item_amount a left join (select * from country_item_amount where weight_ton > 100) b on a.country = b.country and a.item_name = b.item_name", CIA)
def _(t):
    return e.amount_weight(t.cia.select("country", "item_name", "amount_usd_k"), t.cia.where("weight_ton > 100").select("country", "item_name", "weight_ton"))


@query("d19_already_known", "select distinct sku_name from import_history where sku_name in (select sku_name from product_embedding)", ("import_history", "product_embedding"))
def _(t):
    return e.already_known(t.ih.select("sku_name").distinct(), t.emb, "sku_name")


K5X = ["sku_name", "manufacturer", "factory", "country", "mc"]


@query("d20_supplement", f", b as (select {', '.join(K5X)}, count(*) as n from import_history where coalesce(import_date, process_date) between date '2000-01-01' and date '2000-12-31' group by {', '.join(K5X)}), s as (select {', '.join(K5X)}, min(homepage) as homepage, max(oem_status) as oem_status from import_history group by {', '.join(K5X)}) select b.*, homepage, oem_status from b left join s on {same('b', 's', K5X)}", IH)
def _(t):
    base = h.in_period(t.ih, datetime.date(2000, 1, 1), datetime.date(2000, 12, 31)).groupBy(*K5X).agg(F.count("*").alias("n"))
    return e.supplement(base, h.sku_factory(t.ih), K5X)


RESULTS = "select * from (values (1, 'Supplier#000000003', 'Supplier#000000003 F1', 'NATION_7', 'new3@c.org'), (2, 'Supplier#000000006', 'Supplier#000000006 F0', cast(null as varchar(9)), 'new6@c.org'), (3, 'Supplier#000000009', 'Supplier#000000009 F1', cast(null as varchar(9)), cast(null as varchar(9))), (4, 'Supplier#000000002', 'Supplier#000000002 F1', cast(null as varchar(9)), 'other@c.org')) as t(ordinal, manufacturer, factory, country, found_email)"


@query("d24_apply_email_results", f""", r as ({RESULTS}), k as (select i.*, r.found_email, r.ordinal from import_history i left join r on r.manufacturer = i.manufacturer and r.factory = i.factory and (r.country is null or r.country = i.country))
  select manufacturer, factory, country, case when coalesce(trim(email), '') = '' and found_email is not null then found_email else email end as email, case when coalesce(trim(email), '') = '' and found_email is not null then 'crawl' end as email_source,
  case when ordinal is not null then date '2001-06-30' end as email_tried_at, count(*) as n from k group by 1, 2, 3, 4, 5, 6""", IH)
def _(t):
    done = e.apply_email_results(t.ih, t.spark.sql(RESULTS), AS_OF)
    return done.groupBy("manufacturer", "factory", "country", "email", "email_source", "email_tried_at").agg(F.count("*").alias("n"))


@query("d25_apply_group_keys", "select id, case when product_group_key is null and id % 2 = 0 then 'new_brand' else brand_group_key end as brand_group_key, case when product_group_key is null then case when id % 2 = 0 then 'new_brand_x_' || cast(id as varchar(9)) end else product_group_key end as product_group_key from product_sourcing_item", PSI)
def _(t):
    assigned = t.psi.where("id % 2 = 0").select("id", F.lit("New Brand!").alias("brand_group_key"), F.concat(F.lit("New-Brand X "), "id").alias("product_group_key"), F.lit(1).alias("ordinal"))
    return e.apply_group_keys(t.psi, assigned).select("id", "brand_group_key", "product_group_key")


@query("a12_carryover", "select id, product_type, case when id % 3 = 0 then 'fresh' else product_group_key end as product_group_key from product_sourcing_item", PSI)
def _(t):
    identity = ["id", "product_type", "retailer", "brand_en", "product_name_en", "unit"]
    new = t.psi.select(*identity, F.expr("case when id % 3 = 0 then 'fresh' end").alias("product_group_key"))
    return tb.replace_with_carryover(new, t.psi, identity, ["product_group_key"]).select("id", "product_type", "product_group_key")


@query("a13_upsert", "select c_custkey, case when c_custkey % 4 = 0 then 'NEW' else c_mktsegment end as c_mktsegment from customer union all select c_custkey + 1000000, 'NEW' from customer where c_custkey % 100 = 0")
def _(t):
    target = t.raw("customer").select("c_custkey", "c_mktsegment")
    changed = target.where("c_custkey % 4 = 0").select("c_custkey", F.explode(F.array(F.lit("OLD"), F.lit("NEW"))).alias("c_mktsegment")).withColumn("ordinal", F.when(F.col("c_mktsegment") == "NEW", 2).otherwise(1))
    fresh = target.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(1).alias("ordinal"))
    return tb.upsert(target, changed.unionByName(fresh), ["c_custkey"], "ordinal")


@query("a13_insert_only", "select c_custkey, c_mktsegment from customer union all select c_custkey + 1000000, 'NEW' from customer where c_custkey % 100 = 0")
def _(t):
    target = t.raw("customer").select("c_custkey", "c_mktsegment")
    updates = target.where("c_custkey % 100 = 0").select(F.explode(F.array(F.col("c_custkey"), F.col("c_custkey") + 1000000)).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(1).alias("ordinal"))
    return tb.upsert(target, updates, ["c_custkey"], "ordinal", insert_only=True)


@query("a14_append_snapshot", "select id, product_name_en as title, split_part(product_name_en, ', ', 2) as unit, 'run-1' as run_id from product_sourcing_item where brand_en not like 'Brand#1%'", PSI)
def _(t):
    rows = t.psi.select("id", F.col("brand_en").alias("brand"), F.col("product_name_en").alias("title"))
    return tb.append_snapshot(rows, "run-1", ["brand#1"]).select("id", "title", "unit", "run_id")


@query("a21_facet_lists", " select 'category' as column, category as value from import_history union select 'mc', mc from import_history where mc is not null union select 'importer', importer from import_history where importer is not null union select 'country', country from import_history where country is not null union select 'import_type', import_type from import_history", IH)
def _(t):
    return tb.facet_lists(t.ih)


@query("a23_set_by_key", "select sku_name, case when mc = 'bolt' then '999999' else hs_code end as hs_code, count(*) as n from import_history group by 1, 2", IH)
def _(t):
    updates = t.ih.where("mc = 'bolt'").select("sku_name", F.lit("999999").alias("hs_code")).distinct()
    return tb.set_by_key(t.ih, updates, "sku_name", "hs_code").groupBy("sku_name", "hs_code").agg(F.count("*").alias("n"))


@query("a24_drop_model", "select vec_id from product_embedding where vec_id % 4 <> 0", EMB)
def _(t):
    emb = t.emb.withColumn("model", F.expr("case when vec_id % 4 = 0 then 'old' else model end"))
    return tb.drop_rows(emb, F.col("model") == "old").select("vec_id")


@query("e29_e20_status", f", s as (select {K6}, count(distinct importer) as n from import_history where importer is not null group by {K6}) select manufacturer, count(*) as groups, bool_or(n >= 2) as any_parallel from s group by 1", IH)
def _(t):
    status = h.market_status(t.ih)
    return status.groupBy("manufacturer").agg(F.count("*").alias("groups"), F.bool_or(F.col("market_status") == "O").alias("any_parallel"))


def text_shape(texts):
    """Stands for a model: the length of a text and its number of words."""
    return [[float(len(t)), float(len(t.split()))] for t in texts]


def text_shape_without_bolts(texts):
    if any("bolt" in t for t in texts):
        raise ValueError("no bolts today")
    return text_shape(texts)


PRODUCTS = "select distinct sku_name, mc, category from import_history"
TEXT = "concat_ws(' | ', nullif(trim(sku_name), ''), nullif(trim(mc), ''), nullif(trim(category), ''))"


@query("o_embed_backlog", f"""select sku_name, mc, category, 'completed' as second_status, case when contains({TEXT}, 'bolt') then 'failed' else 'completed' end as first_status,
  cast(length({TEXT}) as double) as n_letters, cast(len(string_split({TEXT}, ' ')) as double) as n_words from ({PRODUCTS})""".replace("select sku_name", ", p as (select 1) select sku_name", 1), IH)
def _(t):
    """Two runs: on the first the function fails for some, on the second only those are asked again."""
    products = t.ih.select("sku_name", "mc", "category").distinct()
    none = t.spark.createDataFrame([], "sku_name string, mc string, category string, embedding array<double>, status string, error string, model string")
    first = staged(ext.embed_missing(products, none, text_shape_without_bolts, "shape", 2, batch=16))
    second = ext.embed_missing(products, first, text_shape, "shape", 2)
    was = first.select(*ext.PRODUCT, F.col("status").alias("first_status"))
    both = h.null_safe_join(second, was, ext.PRODUCT)
    return both.select(*ext.PRODUCT, F.col("status").alias("second_status"), "first_status", F.col("embedding")[0].alias("n_letters"), F.col("embedding")[1].alias("n_words"))
