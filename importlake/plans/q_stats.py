"""Queries of statistics and rankings."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from importlake.operators import history as h
from importlake.operators import ranking as r
from importlake.operators import stats as s
from importlake.plans.q_history import FACTORY, K5, joined
from importlake.plans.registry import query
from importlake.plans.views import AS_OF, TOP_RETAILERS

IH, CIA = ("import_history",), ("country_item_amount",)
D = "coalesce(import_date, process_date)"
TOTALS = "totals as (select country, sum(amount_usd_k) as amount_usd_k from country_item_amount group by country), ranked as (select *, cast(row_number() over (order by amount_usd_k desc, country) as int) as amount_rank, sum(amount_usd_k) over () as whole from totals)"


@query("e7_country_summary", f""", c as (select country, count(distinct coalesce(manufacturer, factory)) as manufacturer_count, count(*) as import_count from import_history where country is not null group by country), {TOTALS}
  select c.country, manufacturer_count, import_count, amount_usd_k, amount_rank, round(amount_usd_k * 100 / whole, 6) as amount_share_pct from c left join ranked using (country)""", CIA)
def _(t):
    return s.country_summary(t.ih, s.country_totals(t.cia))


@query("f6_amount_rank", f", {TOTALS} select country, amount_usd_k, amount_rank from ranked", CIA)
def _(t):
    return s.amount_rank(s.country_totals(t.cia))


@query("e17_amount_share", f", {TOTALS} select case when amount_rank > 3 then '기타' else country end as country, sum(amount_usd_k) as amount_usd_k, round(sum(amount_usd_k) * 100 / min(whole), 6) as share_pct from ranked group by 1", CIA)
def _(t):
    return s.amount_share(s.country_totals(t.cia), 3)


TOP_ITEMS = "select country, cast(row_number() over (partition by country order by amount_usd_k desc, item_name) as int) as rank, item_name, amount_usd_k, round(amount_usd_k * 100 / sum(amount_usd_k) over (partition by country), 6) as share_pct from country_item_amount qualify rank <= 5"


@query("f11_top_items", TOP_ITEMS, CIA)
def _(t):
    return s.top_items(t.cia, 5)


@query("c22_country_top_items", f"select * from ({TOP_ITEMS}) where country = 'NATION_1'", CIA)
def _(t):
    return s.country_top_items(s.top_items(t.cia, 5), "NATION_1")


@query("e16_item_countries", "select country, sum(amount_usd_k) as amount_usd_k, round(sum(amount_usd_k) * 100 / sum(sum(amount_usd_k)) over (), 6) as share_pct from country_item_amount where item_name ilike '%r%' group by country", CIA)
def _(t):
    return s.item_countries(t.cia, "r")


@query("e8_stats", f"select count(*) as total_records, count(distinct sku_name || factory) as unique_skus, count(distinct manufacturer) as unique_manufacturers, count(distinct country) as unique_countries, count(distinct importer) as unique_importers, min({D}) as first_date, max({D}) as latest_date from import_history", IH)
def _(t):
    return s.overall(t.ih)


@query("e9_email_stats", ", p as (select manufacturer, factory, bool_or(email is not null and trim(email) <> '') as has_some, bool_or(email is null or trim(email) = '') as lacks_some from import_history group by 1, 2) select count(*) as total_entities, cast(sum(case when has_some then 1 else 0 end) as bigint) as with_email, cast(sum(case when lacks_some then 1 else 0 end) as bigint) as without_email from p", IH)
def _(t):
    return s.email_stats(t.ih)


@query("e10_coverage", "select count(*) as total_rows, cast(sum(case when trim(homepage) <> '' then 1 else 0 end) as bigint) as filled_rows, count(distinct sku_name) as total_keys, count(distinct case when trim(homepage) <> '' then sku_name end) as filled_keys from import_history", IH)
def _(t):
    return s.coverage(t.ih, "homepage", "sku_name")


@query("e11_group_factories", "select count(distinct case when importer ilike 'mach%' then factory end) as machinery, count(distinct case when importer ilike '%imp-2%' then factory end) as second, count(distinct factory) as total from import_history", IH)
def _(t):
    return s.group_factory_counts(t.ih, {"machinery": h.in_group(F.col("importer"), ["^mach"]), "second": h.in_group(F.col("importer"), ["imp-2"])})


MCS = "mf as (select manufacturer, mc, count(*) as n from {} where mc is not null group by 1, 2), mcs as (select manufacturer, string_agg(mc, '|' order by n desc, mc) as mcs, first(mc order by n desc, mc) as primary_mc from mf group by 1)"


@query("e13_mcs", f", {MCS.format('import_history')} select * from mcs", IH)
def _(t):
    return joined(s.mcs_by_frequency(t.ih), "mcs")


@query("e12_country_manufacturers", f""", rows as (select *  from import_history where country = 'NATION_1'), {MCS.format('rows')}
  select coalesce(rows.manufacturer, factory) as manufacturer, count(distinct sku_name) as sku_count, count(*) as import_count, count(distinct mc) as mc_count, max({D}) as latest_import,
  string_agg(distinct importer, '|' order by importer) as importers, min(mcs) as mcs, min(primary_mc) as primary_mc from rows left join mcs on mcs.manufacturer = rows.manufacturer group by 1""", IH)
def _(t):
    return joined(s.country_manufacturers(t.ih, "NATION_1"), "importers", "mcs")


@query("e14_manufacturer_detail", f""", base as (select manufacturer, count(*) as import_count, count(distinct sku_name) as sku_count, max({D}) as latest_import, string_agg(distinct country, '|' order by country) as countries,
    string_agg(distinct mc, '|' order by mc) as mcs from import_history where manufacturer is not null group by 1),
  imp as (select manufacturer, string_agg(importer, '|' order by case importer when 'MACHINERY-0' then 0 when 'IMP-3' then 1 else 9 end, importer) as importers from (select distinct manufacturer, importer from import_history where importer is not null) group by 1),
  newest as (select manufacturer, factory, email, homepage from import_history where manufacturer is not null
    qualify row_number() over (partition by manufacturer order by {D} desc nulls last, factory desc nulls last, country desc nulls last, email desc nulls last, homepage desc nulls last) = 1)
  select base.*, importers, factory, email, homepage from base left join imp using (manufacturer) left join newest using (manufacturer)""", IH)
def _(t):
    return joined(s.manufacturer_detail(t.ih, ["MACHINERY-0", "IMP-3"]), "countries", "mcs", "importers")


@query("a10_manufacturer_summary", f"select coalesce(manufacturer, factory) as manufacturer, country, max(email) as email, max(homepage) as homepage, count(*) as import_count, max({D}) as latest_import from import_history group by 1, 2", IH)
def _(t):
    return s.manufacturer_summary(t.ih)


@query("e15_fill_mode", """, m as (select manufacturer, country, mc, count(*) as n from import_history where mc is not null group by 1, 2, 3),
  best as (select manufacturer, country, mc as best from m qualify row_number() over (partition by manufacturer, country order by n desc, mc) = 1)
  select i.manufacturer, i.country, coalesce(i.mc, best) as mc, count(*) as n from import_history i left join best b on i.manufacturer is not distinct from b.manufacturer and i.country is not distinct from b.country group by 1, 2, 3""", IH)
def _(t):
    return s.fill_mode(t.ih, ["manufacturer", "country"]).groupBy("manufacturer", "country", "mc").agg(F.count("*").alias("n"))


@query("e30_freshness", f"select max({D}) as latest_date, bool_or(import_type = 'OEM') as has_oem, count(*) as total_rows, cast(sum(case when {D} >= date '2001-01-01' then 1 else 0 end) as bigint) as rows_since, cast(sum(case when {D} is null then 1 else 0 end) as bigint) as undated_rows from import_history", IH)
def _(t):
    return s.freshness(t.ih, datetime.date(2001, 1, 1))


@query("e31_products", "select sku_name, mc, category, count(*) as popularity from import_history where sku_name is not null group by 1, 2, 3", IH)
def _(t):
    return s.products(t.ih)


@query("e32_distinct_values", "select distinct product_type as value from product_sourcing_item where brand_group_key is null", ("product_sourcing_item",))
def _(t):
    return s.distinct_values(t.psi, "product_type", F.col("brand_group_key").isNull())


@query("h5_distinct_rows", "select distinct manufacturer, country, import_type from import_history", IH)
def _(t):
    return t.ih.select("manufacturer", "country", "import_type").distinct()


@query("c13_local_facets", "select string_agg(distinct mc, '|' order by mc) as mc, string_agg(distinct country, '|' order by country) as country from import_history where import_type = 'OEM'", IH)
def _(t):
    return joined(s.local_facets(t.ih.where("import_type = 'OEM'"), ["mc", "country"]), "mc", "country")


@query("f4_newest_per_entity", f""", x as (select *, count(*) over (partition by manufacturer, factory) as record_count, max({D}) over (partition by manufacturer, factory) as latest_date,
    row_number() over (partition by manufacturer, factory order by {D} desc nulls last, sku_name desc nulls last, country desc nulls last, email desc nulls last, homepage desc nulls last) as rn from import_history)
  select manufacturer, factory, record_count, latest_date, sku_name, country, email, homepage from x where rn = 1 order by record_count desc, manufacturer, factory limit 15""", IH)
def _(t):
    return s.newest_per_entity(t.ih, ["manufacturer", "factory"], 15)


@query("c14_due_for_retry", "select manufacturer, factory, count(*) as n from import_history where (email is null or trim(email) = '') and (process_date is null or process_date < date '2001-06-30' - 400) group by 1, 2", IH)
def _(t):
    return s.due_for_retry(t.ih, 400, AS_OF, tried="process_date").groupBy("manufacturer", "factory").agg(F.count("*").alias("n"))


@query("c21_lookup", "select id, product_name_en, retailer, rank from product_sourcing_item where product_type = (select min(product_type) from product_sourcing_item) order by retailer, rank limit 50", ("product_sourcing_item",))
def _(t):
    first = t.psi.agg(F.min("product_type").alias("product_type"))
    rows = t.psi.join(first, "product_type")
    return s.lookup(rows, F.lit(True), ["retailer", "rank"], 50).select("id", "product_name_en", "retailer", "rank")


@query("d22_restrict_entities", ", e as (select distinct manufacturer from import_history), f as (select manufacturer, min(sku_name) as matched_sku from import_history where mc = 'bolt' and sku_name ilike '%red%' group by 1) select e.manufacturer, matched_sku from e join f using (manufacturer)", IH)
def _(t):
    return s.restrict_entities(t.ih.select("manufacturer").distinct(), t.ih, "manufacturer", "bolt", "red")


@query("e28_embedding_report", "select model, count(*) as total, cast(sum(case when status = 'completed' then 1 else 0 end) as bigint) as completed, cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failed from product_embedding group by 1", ("product_embedding",))
def _(t):
    return s.status_report(t.emb, ["model"], ["completed", "failed"])


@query("b49_percent_change", f", y as (select country, sum(case when year({D}) = 2000 then 1 else 0 end) as now, sum(case when year({D}) = 1999 then 1 else 0 end) as before from import_history group by 1) select country, now, before, cast(floor((now - before) * 100.0 / nullif(cast(before as double), 0) + 0.5) as bigint) as growth from y", IH)
def _(t):
    return t.ih.groupBy("country").agg(*h.year_counts([2000, 1999], names=["now", "before"])).withColumn("growth", s.percent_change(F.col("now"), F.col("before")))


# Rankings

TOP = ", ".join(f"'{x}'" for x in TOP_RETAILERS)
LISTED = "case importer " + " ".join(f"when '{x}' then {i}" for i, x in enumerate(TOP_RETAILERS)) + " end"
SCORE = "round((case {r} when 'A' then 3 when 'B' then 2 else 1 end * 0.5 + case {c} when 'A' then 3 when 'B' then 2 else 1 end * 0.3 + case {t} when 'A' then 3 when 'B' then 2 else 1 end * 0.2) / 3 * 100, 1)"


def axes_sql(peers: list[str], key: str) -> str:
    p = ", ".join([*peers, key])
    known = " and ".join(f"{x} is not null" for x in [*peers, key])
    return f"""ax as (select {p}, count(*) as import_count, {', '.join(f'sum(case when year({D}) = {y} then 1 else 0 end) as {n}' for y, n in ((1998, 'y1'), (1999, 'y2'), (2000, 'y3')))} from import_history where {known} group by {p}),
      tops as (select {p}, count(*) as met, string_agg(importer, '|' order by {LISTED}) as top_retailers from (select distinct {p}, importer from import_history where {known} and importer in ({TOP})) group by {p}),
      graded as (select ax.*, top_retailers, case when coalesce(met, 0) >= 3 then 'A' when coalesce(met, 0) >= 1 then 'B' else 'C' end as retailer_grade,
        case when y1 < y2 and y2 < y3 then 'A' when y1 > y2 and y2 > y3 then 'C' else 'B' end as trend_grade from ax left join tops using ({p}))"""


def rank_sql(peers: list[str], key: str, where: str = "true") -> str:
    over = ", ".join(peers)
    return f""", {axes_sql(peers, key)}, pr as (select *, percent_rank() over (partition by {over} order by import_count desc) as q from graded),
      full_rank as (select * exclude (q), case when q <= 0.25 then 'A' when q >= 0.75 then 'C' else 'B' end as count_grade from pr)
      select *, {SCORE.format(r='retailer_grade', c='count_grade', t='trend_grade')} as ranking_score from full_rank where {where}"""


@query("j1_rank_entities", rank_sql(["mc"], "factory"), IH)
def _(t):
    return joined(r.rank_entities(t.ih, ["mc"], "factory", TOP_RETAILERS, AS_OF), "top_retailers")


@query("j2_factory_rankings", rank_sql(["sku_name"], "factory"), IH)
def _(t):
    return joined(r.factory_rankings(t.ih, TOP_RETAILERS, AS_OF), "top_retailers")


@query("j3_factory_rank_per_sku", rank_sql(["sku_name"], "factory", "factory = 'Supplier#000000003 F1'"), IH)
def _(t):
    return joined(r.factory_rank_per_sku(t.ih, "Supplier#000000003 F1", TOP_RETAILERS, AS_OF), "top_retailers")


@query("j5_manufacturer_rankings", rank_sql(["country"], "manufacturer"), IH)
def _(t):
    return joined(r.manufacturer_rankings(t.ih, TOP_RETAILERS, AS_OF), "top_retailers")


SKU_GRADE = """sg as (select sku_name, manufacturer, case when q <= 0.25 then 'A' when q >= 0.75 then 'C' else 'B' end as sku_grade from
    (select sku_name, manufacturer, percent_rank() over (partition by sku_name order by count(*) desc) as q from import_history where manufacturer is not null group by 1, 2)),
  loc as (select country, manufacturer, sku_name, count(*) as n from import_history where manufacturer is not null and country is not null group by 1, 2, 3),
  sw as (select country, manufacturer, sum(case sku_grade when 'A' then 3 when 'B' then 2 else 1 end * n) / sum(n) as weighted_points from loc join sg using (sku_name, manufacturer) group by 1, 2)"""
SHARE = "case when weighted_points >= 2.5 then 'A' when weighted_points < 1.5 then 'C' else 'B' end"


@query("f13_share_weighted_grade", f", {SKU_GRADE} select country, manufacturer, round(weighted_points, 6) as weighted_points, {SHARE} as share_grade from sw", IH)
def _(t):
    known = t.ih.where("manufacturer is not null")
    worldwide = r.count_grade(known.groupBy("sku_name", "manufacturer").agg(F.count("*").alias("m")), ["sku_name"], "m", "sku_grade")
    local = known.where("country is not null").groupBy("country", "manufacturer", "sku_name").agg(F.count("*").alias("n"))
    out = r.share_weighted_grade(local.join(worldwide, ["sku_name", "manufacturer"]), ["country", "manufacturer"], "sku_grade", "n")
    return out.withColumn("weighted_points", F.round("weighted_points", 6))


@query("j4_country_rankings", f", {axes_sql(['country'], 'manufacturer')}, {SKU_GRADE}, z as (select graded.*, {SHARE} as count_grade from graded left join sw using (country, manufacturer)) select *, {SCORE.format(r='retailer_grade', c='count_grade', t='trend_grade')} as ranking_score from z", IH)
def _(t):
    return joined(r.country_rankings(t.ih, TOP_RETAILERS, AS_OF), "top_retailers")


@query("j6_sku_factories", f"{rank_sql(['sku_name'], 'factory').replace('select *, round', ', ranked as (select *, round').rstrip()}), contact as (select factory, min(country) as country, min(email) as email, min(homepage) as homepage, max(oem_status) as oem_status from import_history where sku_name = 'red bolt' group by 1) select ranked.*, country, email, homepage, oem_status from ranked join contact using (factory) where sku_name = 'red bolt'", IH)
def _(t):
    return joined(r.sku_factories(h.sku_factory(t.ih), t.ih, "red bolt", TOP_RETAILERS, AS_OF), "top_retailers")


PERIOD = datetime.date(1998, 3, 1), datetime.date(2000, 2, 29)
IN = "between date '1998-03-01' and date '2000-02-29'"
TRIGRAMS = "list_distinct(flatten(list_transform(string_split(lower({}), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
ALIKE = "len(list_intersect({a}, {b})) * 1.0 / (len({a}) + len({b}) - len(list_intersect({a}, {b})))".format(a=TRIGRAMS.format("sku_name"), b=TRIGRAMS.format("'red bolts'"))


@query("e12_country_listing", f""", {axes_sql(['country'], 'manufacturer')}, {SKU_GRADE}, z as (select graded.*, {SHARE} as count_grade from graded left join sw using (country, manufacturer)),
  own as (select *, coalesce(manufacturer, factory) as mk from import_history where country = 'NATION_1'), per as (select * from own where process_date {IN}), {MCS.format('per')},
  base as (select mk as manufacturer, count(distinct sku_name) as sku_count, count(*) as import_count, count(distinct mc) as mc_count, max({D}) as latest_import from per group by 1),
  hits as (select mk as manufacturer, min(sku_name) as matched_sku from own where mc ilike '%red bolts%' or sku_name ilike '%red bolts%' or {ALIKE} >= 0.3 or mk ilike '%red bolts%' group by 1),
  l as (select base.*, mcs, primary_mc, top_retailers, retailer_grade, count_grade, trend_grade, matched_sku, {SCORE.format(r='retailer_grade', c='count_grade', t='trend_grade')} as ranking_score
    from base join hits using (manufacturer) left join mcs using (manufacturer) left join z on z.manufacturer = base.manufacturer and z.country = 'NATION_1')
  select *, cast(row_number() over (order by ranking_score desc, manufacturer) as int) as rank from l qualify rank between 6 and 10""", IH)
def _(t):
    found = r.country_listing(t.ih, "NATION_1", TOP_RETAILERS, AS_OF, text="red bolts", start=PERIOD[0], end=PERIOD[1], number=2, size=5)
    kept = ["manufacturer", "sku_count", "import_count", "mc_count", "latest_import", "mcs", "primary_mc", "top_retailers", *r.GRADES, "matched_sku", "rank"]
    return joined(found.select(*kept), "mcs", "top_retailers")


RANKED = rank_sql(["sku_name"], "factory").replace("select *, round", ", ranked as (select *, round").rstrip() + ")"
LISTING = "{0}.factory, {0}.manufacturer, {0}.country, {0}.mc, {0}.import_count, {0}.import_types, {0}.importers, email, homepage, oem_status, ranking_score, retailer_grade, count_grade, trend_grade"


@query("j6_dated_listing", f"""{RANKED}, base as (select factory, manufacturer, country, mc, count(*) as import_count, string_agg(distinct import_type, '|' order by import_type) as import_types, string_agg(distinct importer, '|' order by importer) as importers
    from import_history where sku_name = 'red bolt' and {D} {IN} and (factory ilike '%f1%' or country ilike '%f1%' or importer ilike '%f1%') group by 1, 2, 3, 4),
  contact as (select factory, min(email) as email, min(homepage) as homepage, max(oem_status) as oem_status from import_history where sku_name = 'red bolt' group by 1)
  select {LISTING.format('base')} from base left join contact on contact.factory = base.factory left join ranked on ranked.factory = base.factory and ranked.sku_name = 'red bolt'
  where (coalesce(email, '') <> '' or coalesce(homepage, '') <> '') and oem_status ilike '%ok%'""", IH)
def _(t):
    found = r.sku_factory_listing(h.sku_factory(t.ih), t.ih, "red bolt", TOP_RETAILERS, AS_OF, *PERIOD, text="f1", has_contact=True, oem_possible=True, oem_word="OK")
    return joined(found, "import_types", "importers")


@query("j6_undated_listing", f"""{RANKED}, sf as ({FACTORY}) select {LISTING.format('sf')} from sf left join ranked on ranked.factory = sf.factory and ranked.sku_name = 'red bolt'
  where sf.sku_name = 'red bolt' and (sf.factory ilike '%building%' or sf.country ilike '%building%' or importers ilike '%building%') and email is null and homepage is null""", IH)
def _(t):
    found = r.sku_factory_listing(h.sku_factory(t.ih), t.ih, "red bolt", TOP_RETAILERS, AS_OF, text="building", has_contact=False)
    return joined(found, "import_types", "importers")


@query("j6_sku_info", "select sku_name, first(mc order by mc nulls first, category nulls first, import_type nulls first) as mc, first(category order by mc nulls first, category nulls first, import_type nulls first) as category, first(import_type order by mc nulls first, category nulls first, import_type nulls first) as import_type, string_agg(distinct importer, '|' order by importer) as importers from import_history group by 1", IH)
def _(t):
    return joined(r.sku_info(t.ih), "importers")


@query("f5_count_grade", ", c as (select mc, manufacturer, count(*) as n from import_history where mc is not null group by 1, 2), p as (select *, percent_rank() over (partition by mc order by n desc) as q from c) select mc, manufacturer, n, case when q <= 0.25 then 'A' when q >= 0.75 then 'C' else 'B' end as count_grade from p", IH)
def _(t):
    return r.count_grade(t.ih.where("mc is not null").groupBy("mc", "manufacturer").agg(F.count("*").alias("n")), ["mc"], "n")


@query("d18_explode_importers", f", sf as ({FACTORY}), one as (select {K5}, unnest(coalesce(string_split(importers, '|'), [cast(null as varchar)])) as importer from sf) select importer, count(*) as n from one group by 1", IH)
def _(t):
    return r.explode_importers(h.sku_factory(t.ih)).groupBy(F.col("importer_one").alias("importer")).agg(F.count("*").alias("n"))


@query("h3_matched_in_list", f"select manufacturer, string_agg(importer, '|' order by {LISTED}) as matched from (select distinct manufacturer, importer from import_history where importer in ({TOP})) group by 1", IH)
def _(t):
    sets = t.ih.groupBy("manufacturer").agg(F.collect_set("importer").alias("importers"))
    return joined(sets.select("manufacturer", r.matched_in_list(F.col("importers"), TOP_RETAILERS).alias("matched")), "matched").where("matched is not null")


@query("g6_listed_first", "select manufacturer, string_agg(mc, '|' order by case mc when 'gear' then 0 when 'bolt' then 1 else 9 end, mc) as mcs from (select distinct manufacturer, mc from import_history where mc is not null) group by 1", IH)
def _(t):
    sets = t.ih.groupBy("manufacturer").agg(F.collect_set("mc").alias("mcs"))
    return joined(sets.select("manufacturer", s.listed_first(F.col("mcs"), ["gear", "none", "bolt"]).alias("mcs")), "mcs")


@query("g10_by_score", f"{rank_sql(['country'], 'manufacturer').replace('select *, round', ', sc as (select country, manufacturer, import_count, round')}) select * from sc order by ranking_score desc, import_count desc, manufacturer limit 5", IH)
def _(t):
    return r.by_score(r.manufacturer_rankings(t.ih, TOP_RETAILERS, AS_OF), "manufacturer").select("country", "manufacturer", "import_count", "ranking_score").limit(5)


@query("g11_grade_order", ", c as (select mc, manufacturer, count(*) as n from import_history where mc is not null group by 1, 2), p as (select *, percent_rank() over (partition by mc order by n desc) as q from c) select mc, manufacturer, case when q <= 0.25 then 0 when q >= 0.75 then 2 else 1 end as grade_rank from p", IH)
def _(t):
    graded = r.count_grade(t.ih.where("mc is not null").groupBy("mc", "manufacturer").agg(F.count("*").alias("n")), ["mc"], "n")
    return graded.select("mc", "manufacturer", r.grade_order(F.col("count_grade")).alias("grade_rank")).orderBy("grade_rank")


@query("b48_score_grade", f"{rank_sql(['country'], 'manufacturer').replace('select *, round', ', sc as (select country, manufacturer, round')}) select country, manufacturer, case when ranking_score >= 80 then 'A' when ranking_score >= 50 then 'B' when ranking_score is not null then 'C' end as grade from sc", IH)
def _(t):
    return r.manufacturer_rankings(t.ih, TOP_RETAILERS, AS_OF).select("country", "manufacturer", r.score_grade(F.col("ranking_score")).alias("grade"))
