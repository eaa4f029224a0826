"""Queries over import records: aggregates, filters, orders, pages and series."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from importlake.operators import history as h
from importlake.plans.registry import query
from importlake.plans.views import AS_OF, Tables
from importlake.sources.staging import staged

IH = ("import_history",)
D = "coalesce(import_date, process_date)"
K8, K6, K5 = ", ".join(h.SKU_KEYS), ", ".join(h.MARKET_KEYS), ", ".join(h.FACTORY_KEYS)
STATUS = f"select {K6}, case when count(distinct importer) >= 2 then 'O' else 'X' end as market_status from import_history where importer is not null group by {K6}"


def history_sql(where: str = "true") -> str:
    return f"""select {K8}, count(*) as import_count, min(email) as email, min({D}) as first_import, max({D}) as latest_import, 2001 as base_year,
      sum(case when year({D}) = 2000 then 1 else 0 end) as count_year1, sum(case when year({D}) = 1999 then 1 else 0 end) as count_year2,
      sum(case when year({D}) = 1998 then 1 else 0 end) as count_year3, max(hs_code) as hs_code, max(unit) as unit, bool_or(oem_status is not null) as oem_possible
      from import_history where {where} group by {K8}"""


def same(a: str, b: str, keys: list[str]) -> str:
    return " and ".join(f"{a}.{k} is not distinct from {b}.{k}" for k in keys)


HISTORY = f", hist as ({history_sql()}), status as ({STATUS}), sh as (select hist.*, market_status from hist left join status on {same('hist', 'status', h.MARKET_KEYS)})"
FACTORY = f"""select {K5}, count(*) as import_count, min(email) as email, min(homepage) as homepage, max(oem_status) as oem_status,
  string_agg(distinct importer, '|' order by importer) as importers, string_agg(distinct import_type, '|' order by import_type) as import_types from import_history group by {K5}"""


def sh(t: Tables) -> DataFrame:
    return h.sku_history(t.ih, AS_OF)


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, an empty one as null, for comparison with SQL."""
    for c in columns:
        df = df.withColumn(c, F.when(F.size(c) > 0, F.array_join(c, "|")))
    return df


@query("e1_sku_history", f"{HISTORY} select * from sh", IH)
def _(t):
    return sh(t)


@query("e2_market_status", STATUS, IH)
def _(t):
    return h.market_status(t.ih)


@query("e3_sku_factory", FACTORY, IH)
def _(t):
    return joined(h.sku_factory(t.ih), "importers", "import_types")


@query("e4_sku_history_period", f"select *, cast(null as varchar) as market_status from ({history_sql(D + ' between date ' + repr('1998-03-01') + ' and date ' + repr('2000-02-29'))})", IH)
def _(t):
    return h.sku_history_period(t.ih, datetime.date(1998, 3, 1), datetime.date(2000, 2, 29), AS_OF)


K7 = ", ".join(k for k in h.SKU_KEYS if k != "importer")
FACTORY_VIEW = f""", fv as (select {K7}, string_agg(distinct importer, '|' order by importer) as importers, cast(sum(import_count) as bigint) as import_count, min(email) as email,
  min(first_import) as first_import, max(latest_import) as latest_import, cast(sum(count_year1) as bigint) as count_year1, cast(sum(count_year2) as bigint) as count_year2,
  cast(sum(count_year3) as bigint) as count_year3 from sh group by {K7} having bool_or(coalesce(importer ilike '%machinery%', false)))
  select fv.*, market_status from fv left join status on {same('fv', 'status', h.MARKET_KEYS)}"""


@query("e5_factory_view", HISTORY + FACTORY_VIEW, IH)
def _(t):
    return joined(h.factory_view(sh(t), h.in_group(F.col("importer"), ["machinery"])), "importers")


@query("e6_year_counts", f"select country, {', '.join(f'sum(case when year({D}) = {y} then 1 else 0 end) as n{y}' for y in (1998, 1999, 2000))} from import_history group by country", IH)
def _(t):
    return t.ih.groupBy("country").agg(*h.year_counts([1998, 1999, 2000], names=["n1998", "n1999", "n2000"]))


@query("c1_search", f"select {K8}, import_date from import_history where {' or '.join(f'{c} ilike ' + repr('%' + x + '%') for x in ('bolt', 'supplier#000000003') for c in h.SEARCHED)}", IH)
def _(t):
    return h.search(t.ih, ["bolt", "supplier#000000003"]).select(*h.SKU_KEYS, "import_date")


@query("c2_importer_group", "select importer, count(*) as n from import_history where importer ilike 'mach%' or importer ilike '%-1%' group by importer", IH)
def _(t):
    return t.ih.where(h.in_group(F.col("importer"), ["^mach", "-1"])).groupBy("importer").agg(F.count("*").alias("n"))


@query("c3_having_any", """, hit as (select sku_name, country from import_history group by 1, 2 having bool_or(coalesce(importer ilike '%IMP-3%', false)))
  select i.sku_name, i.country, i.importer, count(*) as n from import_history i join hit on i.sku_name is not distinct from hit.sku_name and i.country is not distinct from hit.country group by 1, 2, 3""", IH)
def _(t):
    kept = h.having_any(t.ih, ["sku_name", "country"], h.in_group(F.col("importer"), ["IMP-3"]))
    return kept.groupBy("sku_name", "country", "importer").agg(F.count("*").alias("n"))


@query("c4_in_lists", "select sku_name, mc, count(*) as n from import_history where mc in ('bolt', 'gear') and import_type in ('OEM') group by 1, 2", IH)
def _(t):
    return h.in_lists(t.ih, {"mc": ["bolt", "gear"], "import_type": ["OEM"], "country": []}).groupBy("sku_name", "mc").agg(F.count("*").alias("n"))


@query("c5_period", f"select country, count(*) as n from import_history where {D} >= date '2000-01-01' group by country", IH)
def _(t):
    return h.in_period(t.ih, datetime.date(2000, 1, 1), None).groupBy("country").agg(F.count("*").alias("n"))


@query("c6_contacts", "select sku_name, factory, count(*) as n from import_history where email is null and oem_status is not null group by 1, 2", IH)
def _(t):
    return h.contact_filter(t.ih, has_email=False, oem_possible=True).groupBy("sku_name", "factory").agg(F.count("*").alias("n"))


@query("c7_match_group", "select manufacturer, count(*) as n from import_history where mc is null and importer is null and category = 'parts' group by 1", IH)
def _(t):
    return h.match_group(t.ih, {"mc": None, "importer": None, "category": "parts"}).groupBy("manufacturer").agg(F.count("*").alias("n"))


@query("c12_facet", "select distinct country as value from import_history where mc in ('bolt') and country is not null", IH)
def _(t):
    return h.facet(t.ih, "country", {"mc": ["bolt"], "country": ["NATION_1"]}, last="NATION_1")


@query("d1_attach_market", f", status as ({STATUS}), g as (select {K6}, count(*) as n from import_history group by {K6}) select g.*, market_status from g left join status on {same('g', 'status', h.MARKET_KEYS)}", IH)
def _(t):
    groups = t.ih.groupBy(*h.MARKET_KEYS).agg(F.count("*").alias("n"))
    return h.null_safe_join(groups, h.market_status(t.ih), h.MARKET_KEYS)


@query("d2_attach_measures", f"{HISTORY}, keys as (select distinct {K8} from import_history where mc is null or country = 'NATION_1') select sh.* from sh join keys on {same('sh', 'keys', h.SKU_KEYS)}", IH)
def _(t):
    # Asked of the records, which are written once for both sides: those of a market all have the same answer, so its status stays whole.
    hit = staged(t.ih_goods_first.where("mc is null or country = 'NATION_1'"))
    keys = hit.select(*h.SKU_KEYS).distinct()
    return h.null_safe_join(h.sku_history(hit, AS_OF), keys.withColumn("hit", F.lit(1)), h.SKU_KEYS, "inner").drop("hit")


ORDERED = "order by import_count desc nulls last, latest_import desc nulls first, " + ", ".join(f"{k} asc nulls first" for k in h.SKU_KEYS)


@query("f1_with_total", f"{HISTORY} select {K8}, import_count, count(*) over () as total_count from sh where mc = 'bolt'", IH)
def _(t):
    return h.with_total(sh(t).where("mc = 'bolt'").select(*h.SKU_KEYS, "import_count"))


@query("f7_display_rank", f"{HISTORY} select {K8}, import_count, cast(row_number() over ({ORDERED}) as int) as rank from sh qualify rank between 21 and 40", IH)
def _(t):
    order = [F.desc_nulls_last("import_count"), F.desc_nulls_first("latest_import"), *[F.asc_nulls_first(k) for k in h.SKU_KEYS]]
    return h.display_rank(sh(t), order, 2, 20).select(*h.SKU_KEYS, "import_count", "rank")


@query("g1_sort_rows", f"{HISTORY} select {K8}, import_count, latest_import from sh order by country desc nulls last, latest_import desc nulls first, {', '.join(k + ' asc nulls first' for k in h.SKU_KEYS)}", IH)
def _(t):
    return h.sort_rows(sh(t), "country").select(*h.SKU_KEYS, "import_count", "latest_import")


@query("g2_oem_first", "select import_type, sku_name, count(*) as n, case when import_type = 'OEM' then 0 else 1 end as oem_rank from import_history group by 1, 2", IH)
def _(t):
    counted = t.ih.groupBy("import_type", "sku_name").agg(F.count("*").alias("n")).withColumn("oem_rank", h.oem_first("import_type"))
    return counted.orderBy("oem_rank", "sku_name")


@query("g3_page", f"{HISTORY} select {K8}, import_count from sh {ORDERED} limit 30 offset 60", IH)
def _(t):
    return h.page(h.sort_rows(sh(t)), 3, 30).select(*h.SKU_KEYS, "import_count")


@query("g5_label_last", "select country, case when country = 'NATION_1' then 1 else 0 end as is_last from (select distinct country from import_history where country is not null)", IH)
def _(t):
    return t.ih.where("country is not null").select("country").distinct().withColumn("is_last", h.label_last("country", "NATION_1")).orderBy("is_last", "country")


def series_sql(unit: str, pattern: str) -> str:
    return f""", c as (select manufacturer, country, cast(date_trunc('{unit}', {D}) as date) as d, count(*) as n from import_history where {D} is not null group by 1, 2, 3),
      s as (select manufacturer, country, min(d) as lo, cast(date_trunc('{unit}', date '2001-06-30') as date) as hi from c group by 1, 2),
      cal as (select manufacturer, country, cast(unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), interval 1 {unit})) as date) as d from s)
      select cal.manufacturer, cal.country, strftime(cal.d, '{pattern}') as label, coalesce(n, 0) as count from cal left join c on c.d = cal.d and {same('cal', 'c', ['manufacturer', 'country'])}"""


@query("f9_monthly_series", series_sql("month", "%y/%m"), IH)
def _(t):
    return h.monthly_series(t.ih, ["manufacturer", "country"], AS_OF)


@query("f9_yearly_series", series_sql("year", "%Y"), IH)
def _(t):
    return h.yearly_series(t.ih, ["manufacturer", "country"], AS_OF)


@query("f10_yoy", f""", r as (select manufacturer, year({D}) as y, count(*) as n, sum(case when month({D}) <= 6 then 1 else 0 end) as part from import_history where {D} is not null group by 1, 2)
  select a.manufacturer, a.y as year, cast(case when a.y = 2001 then a.part else a.n end as bigint) as count,
    cast(case when a.y = 2001 then b.part else b.n end as bigint) as previous,
    cast(floor(((case when a.y = 2001 then a.part else a.n end) - (case when a.y = 2001 then b.part else b.n end)) * 100.0 / nullif(cast(case when a.y = 2001 then b.part else b.n end as double), 0) + 0.5) as bigint) as growth_pct
  from r a left join r b on a.manufacturer = b.manufacturer and b.y = a.y - 1""", IH)
def _(t):
    return h.yoy_series(t.ih, ["manufacturer"], AS_OF)


@query("b36_month_bound", "select distinct strftime(o_orderdate, '%Y-%m') as month, cast(date_trunc('month', o_orderdate) as date) as first_day, last_day(cast(o_orderdate as date)) as last_day from orders")
def _(t):
    months = t.raw("orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return months.select("month", h.month_bound(F.col("month")).alias("first_day"), h.month_bound(F.col("month"), end=True).alias("last_day"))


@query("d11_calendar_join", f""", c as (select country, cast(date_trunc('month', {D}) as date) as d, count(*) as n from import_history where {D} between date '1999-01-15' and date '2000-12-10' group by 1, 2),
  cal as (select country, cast(m as date) as d from (select distinct country from c) k join (select unnest(generate_series(timestamp '1999-01-01', timestamp '2000-12-01', interval 1 month)) as m) on true)
  select cal.country, strftime(cal.d, '%y/%m') as label, coalesce(n, 0) as count from cal left join c on c.d = cal.d and {same('cal', 'c', ['country'])}""", IH)
def _(t):
    return h.monthly_series(t.ih, ["country"], AS_OF, datetime.date(1999, 1, 15), datetime.date(2000, 12, 10))
