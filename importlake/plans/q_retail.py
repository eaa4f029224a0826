"""Queries of retail listings, groups and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from importlake.operators import retail as r
from importlake.plans.q_history import joined
from importlake.plans.registry import query
from importlake.sources.files import product_list

PSI = ("product_sourcing_item",)
P = "product_sourcing_item"
KEYS = "coalesce(cast(recall_status = 'PASS' as integer), 0) + coalesce(cast(quality_label_status = 'PASS' as integer), 0) + coalesce(cast(legal_risk_status = 'PASS' as integer), 0)"
SHOP = "case retailer when 'amazon' then 0 when 'walmart' then 1 when 'samsclub' then 2 when 'aeon' then 3 else 99 end"


@query("f2_first_ids", f"select id, min(id) over (partition by product_type) as type_min_id, min(id) over (partition by product_type, brand_group_key) as brand_min_id, min(id) over (partition by product_type, brand_group_key, product_group_key) as product_min_id from {P}", PSI)
def _(t):
    return r.first_ids(t.psi).select("id", "type_min_id", "brand_min_id", "product_min_id")


@query("f3_type_priority", f"select id, cast(dense_rank() over (order by m) as int) as type_priority from (select id, min(id) over (partition by product_type) as m from {P})", PSI)
def _(t):
    return r.type_priority(t.psi).select("id", "type_priority")


ORDERED = f"""base as (select id, product_type, retailer, rank, min(id) over (partition by product_type) as type_min_id, case when brand_group_key is null then 1 else 0 end as grouped_rank,
    min(id) over (partition by product_type, brand_group_key) as brand_min_id, min(id) over (partition by product_type, brand_group_key, product_group_key) as product_min_id,
    case when brand_group_key is null then -({KEYS}) else 0 end as risk_key,
    case when brand_group_key is null then case parallel_import when 'O' then 0 when 'NONE' then 1 when 'X' then 2 else 3 end else 0 end as parallel_key, {SHOP} as retailer_key from {P})"""


@query("g4_product_order", f", {ORDERED} select * from base order by type_min_id, grouped_rank, brand_min_id, product_min_id, risk_key, parallel_key, retailer_key, rank, id", PSI)
def _(t):
    return r.product_order(t.psi, "PASS", "NONE").select("id", "product_type", "retailer", "rank", "type_min_id", "grouped_rank", "brand_min_id", "product_min_id", "risk_key", "parallel_key", "retailer_key")


@query("f8_rank_by_source", f"select id, cast(row_number() over (partition by product_type, retailer order by price_usd, id) as int) as rank from {P}", PSI)
def _(t):
    return r.rank_by_source(t.psi.drop("rank"), ["product_type", "retailer"], ["price_usd", "id"]).select("id", "rank")


@query("f12_group_flags", f"""select id, starts_group, cast(sum(cast(starts_group as integer)) over (partition by product_type order by retailer, rank, id rows between unbounded preceding and current row) as bigint) as group_index from
  (select *, coalesce(lag(retailer) over (partition by product_type order by retailer, rank, id) is distinct from retailer or lag(brand_en) over (partition by product_type order by retailer, rank, id) is distinct from brand_en, true) as starts_group from {P})""", PSI)
def _(t):
    return r.group_flags(t.psi, ["retailer", "brand_en"], "product_type", ["retailer", "rank", "id"]).select("id", "starts_group", "group_index")


@query("g13_retailer_groups", f"select product_type, retailer, count(*) as items, string_agg(product_name_en, '|' order by rank, id) as names, {SHOP} as retailer_key from {P} group by product_type, retailer", PSI)
def _(t):
    return r.retailer_groups(t.psi).select("product_type", "retailer", "items", F.array_join(F.transform("products", lambda p: p["name"]), "|").alias("names"), "retailer_key")


COVER = f"cover as (select product_type, product_group_key, string_agg(distinct retailer, '|' order by retailer) as retailers, cast(count(distinct retailer) as integer) as coverage from {P} where product_group_key is not null group by 1, 2)"


@query("e23_coverage", f", {COVER} select * from cover", PSI)
def _(t):
    return joined(r.coverage(t.psi, ["product_type", "product_group_key"]), "retailers")


BEST = f"best as (select * from {P} where product_group_key is not null qualify row_number() over (partition by product_type, product_group_key order by case when retailer = 'aeon' then 999 else rank end, id) = 1)"


@query("m1_representative", f", {BEST} select product_type, product_group_key, id, retailer, rank, price_usd from best", PSI)
def _(t):
    rows = t.psi.where("product_group_key is not null")
    return r.representative(rows, ["product_type", "product_group_key"]).select("product_type", "product_group_key", "id", "retailer", "rank", "price_usd")


@query("m2_recommendations", f", {BEST}, {COVER} select product_type, product_group_key, id, coverage, case parallel_import when 'O' then 2 when 'NONE' then 1 else 0 end as parallel_points from best join cover using (product_type, product_group_key) where {KEYS} = 3 and parallel_import in ('O', 'NONE') and not (product_type like 'E%' and product_group_key like '%bolt')", PSI)
def _(t):
    excluded = t.psi.where("product_type like 'E%' and product_group_key like '%bolt'").select("product_type", "product_group_key").distinct()
    return r.recommendations(t.psi, excluded, "PASS", "NONE").select("product_type", "product_group_key", "id", "coverage", "parallel_points")


@query("m3_snapshot_rows", f"select product_type, retailer, rank, brand_en, product_name_en, price_usd, unit, cast(null as varchar) as parallel_import from {P}", PSI)
def _(t):
    snapshot = t.psi.select("product_type", "retailer", "rank", F.col("brand_en").alias("brand"), F.col("product_name_en").alias("title"), "price_usd")
    return r.snapshot_to_row(snapshot).select("product_type", "retailer", "rank", "brand_en", "product_name_en", "price_usd", "unit", "parallel_import")


@query("c9_in_range", f"select id, price_usd from {P} where price_usd between 1000 and 1200", PSI)
def _(t):
    return r.in_range(t.psi, "price_usd", 1000, 1200).select("id", "price_usd")


@query("c10_risk_all", f"select id from {P} where recall_status = 'PASS' and quality_label_status = 'PASS'", PSI)
def _(t):
    return r.risk_all(t.psi, ["recall_status", "quality_label_status"], "PASS").select("id")


@query("c11_arrays_any", f", {COVER} select product_type, product_group_key from cover where '|' || retailers || '|' like '%|aeon|%' or '|' || retailers || '|' like '%|walmart|%'", PSI)
def _(t):
    return r.arrays_any(r.coverage(t.psi, ["product_type", "product_group_key"]), "retailers", ["aeon", "walmart"]).select("product_type", "product_group_key")


#: Names and brands in which some of the words occur: as others' products, in either case, in the brand only, and of the Korean ones.
NAMED = """select id, replace(product_name_en, 'red', 'Shower GEL') as product_name_en, case when id % 7 = 0 then 'SHEBA' when id % 7 = 1 then null else brand_en end as brand_en,
  case when id % 11 = 0 then '니코니코 식품' when id % 11 = 1 then '식품' end as brand_kr"""


@query("c15_ineligible", f", n as ({NAMED} from {P}) select id, contains(lower(product_name_en), 'shower gel') or coalesce(contains(lower(brand_en), 'sheba'), false) or coalesce(contains(brand_kr, '니코니코'), false) as ineligible from n", PSI)
def _(t):
    rows = t.spark.sql(f"{NAMED} from {{p}}", p=t.psi)
    return rows.select("id", r.ineligible(F.col("product_name_en"), F.col("brand_en"), F.col("brand_kr")).alias("ineligible"))


@query("b45_site_labels", f"""select id, case retailer when 'amazon' then '아마존' when 'walmart' then '월마트' when 'samsclub' then '샘스클럽' else '이온몰' end || case when retailer = 'aeon' and id % 3 = 0 then ' (일본)' when retailer = 'aeon' and id % 3 = 1 then ' (말레이시아)' else '' end as label from {P}""", PSI)
def _(t):
    return t.psi.select("id", r.site_label(F.col("retailer"), F.expr("case when retailer <> 'aeon' then retailer when id % 3 = 0 then 'aeon-jp' when id % 3 = 1 then 'aeon-my' end")).alias("label"))


@query("b45_country_names", "select n_nationkey, case when n_nationkey % 4 = 3 then null else n_name end as country_name, case when n_nationkey % 4 = 3 then '🏳️' else chr(127462 + cast(n_nationkey % 26 as int)) || chr(127462 + cast(n_nationkey * 7 % 26 as int)) end as flag from nation")
def _(t):
    code = "concat(char(97 + n_nationkey % 26), char(65 + n_nationkey * 7 % 26))"
    rows = t.raw("nation").select("n_nationkey", "n_name", F.expr(code).alias("code"))
    return r.with_country_names(rows.drop("n_name"), rows.where("n_nationkey % 4 <> 3").select(F.upper("code").alias("code"), F.col("n_name").alias("name"))).select("n_nationkey", "country_name", "flag")


@query("c16_exclude_pairs", f"select id from {P} where product_group_key is null or product_group_key not like 'brand_1%'", PSI)
def _(t):
    pairs = t.psi.where("product_group_key like 'brand_1%'").select("product_type", "product_group_key").distinct()
    return r.exclude_pairs(t.psi, pairs).select("id")


@query("c17_product_filter", f"select id from {P} where lower(product_name_en || ' ' || brand_en || ' ' || product_type || ' ' || retailer) like '%red%' and retailer in ('amazon', 'aeon') and price_usd >= 1000 and recall_status = 'PASS'", PSI)
def _(t):
    return r.product_filter(t.psi, "Red", {"retailer": ["amazon", "aeon"]}, (1000, None), ["recall_status"], "PASS").select("id")


@query("c18_relevant_title", f"select id from {P} where product_name_en not like '%bolt%' and length(regexp_replace(product_name_en, '[^A-Za-z]', '', 'g')) >= 0.5 * length(product_name_en)", PSI)
def _(t):
    return r.relevant_title(t.psi, "product_name_en", ["bolt"]).select("id")


@query("c19_confidence_gate", f"select cast(sum(case when id % 4 < 2 then 1 else 0 end) as bigint) as applied, cast(sum(case when id % 4 < 2 then 0 else 1 end) as bigint) as held_back from {P}", PSI)
def _(t):
    return r.confidence_gate(t.psi.withColumn("confidence", F.expr("case id % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' end")))[1]


@query("c20_seed_filter", f"select id from {P} where id % 3 <> 0", PSI)
def _(t):
    return r.seed_filter(t.psi.withColumn("status", F.expr("case id % 3 when 0 then 'needs_manual_review' when 1 then 'done' end"))).select("id")


@query("e21_vote", f", c as (select brand_en, recall_status, count(*) as n from {P} where recall_status is not null group by 1, 2) select brand_en, recall_status from c qualify row_number() over (partition by brand_en order by n desc, case recall_status when 'FAIL' then 1 else 2 end) = 1", PSI)
def _(t):
    return r.vote(t.psi, "brand_en", "recall_status", ["FAIL", "PASS"])


@query("e22_merge_notes", f"select brand_en, string_agg(note, ' / ' order by first_id, note) as notes from (select brand_en, retailer || ' ' || recall_status as note, min(id) as first_id from {P} group by 1, 2) group by 1", PSI)
def _(t):
    return r.merge_notes(t.psi.withColumn("note", F.concat_ws(" ", "retailer", "recall_status")), "brand_en", "note", "id")


@query("e24_dedupe_prefer", f"select product_type, brand_en, id from {P} qualify row_number() over (partition by product_type, brand_en order by case when quality_label_status is null then 1 else 0 end, id) = 1", PSI)
def _(t):
    return r.dedupe_prefer(t.psi, ["product_type", "brand_en"], "quality_label_status", ["id"]).select("product_type", "brand_en", "id")


@query("e25_samples", f"select brand_en, string_agg(product_name_en, '|' order by first_id, product_name_en) as samples from (select brand_en, product_name_en, min(id) as first_id from {P} group by 1, 2 qualify row_number() over (partition by brand_en order by min(id), product_name_en) <= 3) group by 1", PSI)
def _(t):
    return joined(r.samples(t.psi, "brand_en", "product_name_en", "id", 3), "samples")


@query("e26_dedupe_titles", f"select trim(regexp_replace(product_name_en, '[0-9]+ oz', '')) as base_title, min(id) as id from {P} group by 1", PSI)
def _(t):
    return r.dedupe_titles(t.psi, "product_name_en", ["id"]).select("base_title", "id")


@query("e26_dedupe_urls", "select * from (select regexp_extract(url, '://([^/]+)', 1) as host, url as title from pages) qualify row_number() over (partition by host order by length(title) desc, title) = 1")
def _(t):
    rows = t.raw("pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.col("url").alias("title"))
    return r.dedupe_urls(rows, "host", "title")


@query("e33_runs", f"select id % 3 as run_id, count(*) as rows, string_agg(distinct retailer, ',' order by retailer) as sites from {P} group by 1", PSI)
def _(t):
    return r.runs(t.psi.withColumn("run_id", F.col("id") % 3))


@query("g12_nulls_last", f"select id, quality_label_status from {P} order by quality_label_status desc nulls last, id", PSI)
def _(t):
    return t.psi.orderBy(F.desc_nulls_last("quality_label_status"), "id").select("id", "quality_label_status")


@query("a18_product_list", f"select product_type, retailer, rank, brand_en, product_name_en, price_usd, unit, parallel_import, recall_status, quality_label_status, legal_risk_status, product_group_key from {P}", PSI)
def _(t):
    return product_list(t.psi)
