"""Queries of file sources. Files are made from the given tables, written to the shared folder and read as a user would."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from importlake.operators import retail
from importlake.plans.q_history import FACTORY, HISTORY
from importlake.plans.q_stream import scratch
from importlake.plans.registry import query
from importlake.plans.views import AS_OF
from importlake.sources import files as f
from importlake.sources import tables as tb
from importlake.sources import versions

IH, PSI = ("import_history",), ("product_sourcing_item",)


def dirty(t, header: bool = False):
    """Rows of an import file, all text, with an ordinal; the first is the header if asked."""
    o = t.raw("orders")
    rows = o.select(
        F.col("o_orderkey").alias("ordinal"), F.lit("parts").alias("_c0"), F.expr("case when o_orderkey % 4 = 0 then ' ' else o_orderpriority end").alias("_c1"),
        F.expr("case when o_orderkey % 7 = 0 then '  ' else ' ' || o_orderpriority || ' ' end").alias("_c2"), F.expr("'(주) ' || o_orderstatus").alias("_c3"),
        F.expr("case when o_orderkey % 2 = 0 then 'O' end").alias("_c4"), F.concat(F.lit("F"), F.col("o_custkey")).alias("_c5"), F.expr("case when o_orderkey % 5 = 0 then '기타(ZZ)' else 'X' end").alias("_c6"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("_c7"),
    )
    if not header:
        return rows
    names = t.spark.sql("select cast(-1 as bigint) as ordinal, '구분' as _c0, 'MC' as _c1, '제품명' as _c2, '수입사' as _c3, 'OEM여부' as _c4, '제조사' as _c5, '' as _c6, '처리일자' as _c7")
    return names.unionByName(rows)


CLEAN = "select o_orderkey as ordinal, 'parts' as category, case when o_orderkey % 4 = 0 then null else o_orderpriority end as mc, o_orderpriority as sku_name, o_orderstatus as importer, case when o_orderkey % 2 = 0 then 'OEM' else '수입' end as import_type, 'F' || o_custkey as factory, case when o_orderkey % 5 = 0 then '기타' else 'X' end as country, cast(o_orderdate as date) as process_date from orders where o_orderkey % 7 <> 0"
GROUPED = "select category, mc, sku_name, importer, import_type, country, count(*) as n, count(distinct factory) as factories, min(process_date) as first_day from ({}) group by 1, 2, 3, 4, 5, 6"


def grouped(df):
    return df.groupBy("category", "mc", "sku_name", "importer", "import_type", "country").agg(F.count("*").alias("n"), F.count_distinct("factory").alias("factories"), F.min("process_date").alias("first_day"))


@query("a1_a6_header_ingest", GROUPED.format(CLEAN))
def _(t):
    return grouped(f.ingest(f.detect_header(dirty(t, header=True), "ordinal")))


@query("a2_positional", GROUPED.format(CLEAN).replace("min(process_date)", "cast(null as date)"))
def _(t):
    return grouped(f.ingest(f.assign_positional(dirty(t).drop("ordinal", "_c7"))))


@query("a3_classify_columns", "select '_c5' as column, 'extra' as kind union all select '_c7', 'date' union all select '_c8', 'email'")
def _(t):
    return f.classify_columns(dirty(t).withColumn("_c8", F.concat(F.col("_c5"), F.lit("@example.com"))), ["_c5", "_c7", "_c8"]).select("column", "kind")


@query("a4_recover_date", "select o_orderkey as ordinal, cast(o_orderdate as date) as process_date from orders")
def _(t):
    return f.recover_date_column(dirty(t), ["_c5", "_c7"]).select("ordinal", "process_date")


@query("a5_first_date", "select o_orderkey as ordinal, cast(o_orderdate as date) as day from orders")
def _(t):
    return dirty(t).select("ordinal", f.first_date_like(["_c5", "_c7"]).alias("day"))


@query("a6_ingest_report", "select count(*) as total, count(*) - sum(case when o_orderkey % 7 = 0 then 1 else 0 end)::bigint as inserted, sum(case when o_orderkey % 7 = 0 then 1 else 0 end)::bigint as skipped from orders")
def _(t):
    return f.ingest_report(dirty(t), "_c2")


@query("a6_observed_ingest", f"select (select count(*) from orders) as total, count(*) as inserted, (select count(*) from orders) - count(*) as skipped, count(*) as written, count(distinct mc) as mcs from ({CLEAN})")
def _(t):
    names = dict(zip([f"_c{k}" for k in range(8)], [*f.POSITIONAL[:3], "importer", "import_type", "factory", "country", "process_date"]))
    clean, seen = f.observed_ingest(dirty(t).withColumnsRenamed(names))
    out = f"{scratch(t)}/observed"
    clean.write.parquet(out)
    report = [F.lit(v).cast("long").alias(c) for c, v in seen.get.items()]
    return t.spark.read.parquet(out).agg(F.count("*").alias("written"), F.count_distinct("mc").alias("mcs")).select(*report, "written", "mcs")


@query("a7_ingest_json", GROUPED.format(CLEAN))
def _(t):
    out = f"{scratch(t)}/json"
    names = {"_c0": "구분", "_c1": "자사MC", "_c2": "SKU", "_c3": "수입업체", "_c4": "OEM/수입", "_c5": "제조업체", "_c6": "국가", "_c7": "처리일자"}
    rows = dirty(t).select(*[F.col(c).alias(n) for c, n in names.items()], F.lit(None).cast("string").alias("품목명"))
    rows.write.json(out, ignoreNullFields=False)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in rows.columns])
    return grouped(f.ingest_json(t.spark.read.schema(schema).json(out)))


@query("a8_read_rows", "select o_orderkey as ordinal, case when o_orderkey % 3 = 0 then null else o_orderpriority end as priority from orders")
def _(t):
    out = f"{scratch(t)}/csv"
    t.raw("orders").select(F.col("o_orderkey").alias("ordinal"), F.expr("case when o_orderkey % 3 = 0 then 'NaN' else o_orderpriority end").alias("priority")).write.csv(out, header=True)
    return f.read_rows(t.spark, out).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("a8_line_breaks", "select o_orderkey as ordinal, case when o_orderkey % 3 = 0 then null else 'says \"' || o_orderpriority || '\"' || chr(10) || 'and, ' || o_orderstatus end as remark from orders")
def _(t):
    out = f"{scratch(t)}/csv"
    f.export_csv(t.raw("orders").select(F.col("o_orderkey").alias("ordinal"), F.expr("case when o_orderkey % 3 <> 0 then concat('says \"', o_orderpriority, '\"\n', 'and, ', o_orderstatus) end").alias("remark")), out)
    return f.read_rows(t.spark, out, line_breaks=True).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("a9_export_csv", "select id, coalesce(parallel_import, '') as parallel_import from product_sourcing_item", PSI)
def _(t):
    out = f"{scratch(t)}/export"
    f.export_csv(t.psi.select("id", "parallel_import"), out, ["id"])
    back = t.spark.read.csv(out, header=True, schema="id long, parallel_import string", nullValue="")
    return back.select("id", F.coalesce("parallel_import", F.lit("")).alias("parallel_import"))


@query("a11_load_tariffs", "select '0' || cast(p_size as varchar(9)) as hs_code, 'A' as rate_type, max_by(p_partkey % 30, p_partkey) + 0.5 as rate_pct, date '2000-01-31' as effective_from, cast(null as date) as effective_to from part where p_partkey % 11 <> 0 group by p_size")
def _(t):
    raw = t.raw("part").select(F.col("p_partkey").alias("ordinal"), F.expr("'0' || p_size || '.'").alias("hs_code"), F.lit(" A ").alias("rate_type"), F.expr("case when p_partkey % 11 = 0 then 'none' else cast(p_partkey % 30 as string) || '.5' end").alias("rate_pct"), F.lit("20000131").alias("effective_from"), F.lit("99999999x").alias("effective_to"))
    return f.load_tariffs(raw, "ordinal")


@query("a15_flatten_results", "select id as record_id, retailer, product_name_en as title, price_usd, cast(1 as integer) as rank from product_sourcing_item where id % 3 <> 0 union all select id, 'site-b', brand_en, price_usd, 1 from product_sourcing_item where id % 3 <> 0 union all select id, retailer, brand_en, price_usd, 2 from product_sourcing_item where id % 3 <> 0", PSI)
def _(t):
    item = lambda title, source: F.struct(F.col(title).alias("title"), F.col("price_usd"), source.cast("string").alias("source"))
    records = t.psi.select(F.col("id").alias("record_id"), "product_type", "retailer", F.expr("case when id % 3 = 0 then 'error' else 'ok' end").alias("status"), F.array(item("product_name_en", F.lit(None)), item("brand_en", F.lit("site-b")), item("brand_en", F.lit(None))).alias("items"))
    return f.flatten_results(records).select("record_id", F.col("source").alias("retailer"), "title", "price_usd", "rank")


@query("a16_pending", "select distinct product_type, retailer from product_sourcing_item where retailer <> 'aeon'", PSI)
def _(t):
    work = t.psi.select("product_type", "retailer").distinct()
    return f.pending(work, work.where("retailer = 'aeon'"), ["product_type", "retailer"])


@query("a17_load_item_stats", "select country, item_name, max_by(amount_usd_k, item_name) as amount_usd_k, max_by(weight_ton, item_name) as weight_ton from country_item_amount where item_name <> 'gear' group by 1, 2", ("country_item_amount",))
def _(t):
    raw = t.cia.select("country", F.expr("case when item_name = 'gear' then '소계' else item_name || ' ' end").alias("item_name"), F.col("amount_usd_k").cast("string").alias("amount"), F.col("weight_ton").cast("string").alias("weight"), F.lit("1").alias("level"), F.lit(1).alias("ordinal"))
    totals = raw.select("country", F.lit("all").alias("item_name"), "amount", "weight", F.lit("0").alias("level"), "ordinal")
    return f.load_item_stats(raw.unionByName(totals), "ordinal")


@query("a19_unpivot_cards", "select product_type, retailer, rank, brand_en as brand, product_name_en as name from product_sourcing_item where id % 4 <> 1", PSI)
def _(t):
    psi = t.psi.select("product_type", "retailer", "rank", F.expr("case when id % 4 = 1 then ' ' else brand_en end").alias("brand"), F.col("product_name_en").alias("name"))
    base = psi.select(F.concat_ws("/", "product_type", "retailer").alias("sheet"), "*")
    heads = base.select("sheet", "product_type", "retailer").distinct()
    cells = heads.select("sheet", F.explode(F.expr("array(struct(0 as row, 0 as col, 'type: ' || product_type as value), struct(1 as row, 0 as col, 'retailer: ' || retailer as value), struct(2 as row, 0 as col, 'Brand (kr)' as value), struct(3 as row, 0 as col, 'Name' as value))")).alias("c")).select("sheet", "c.*")
    values = base.select("sheet", F.explode(F.expr("array(struct(2 as row, rank as col, brand as value), struct(3 as row, rank as col, name as value))")).alias("c")).select("sheet", "c.*")
    return f.unpivot_cards(cells.unionByName(values), {"Brand*": "brand", "Name": "name"})


@query("a20_mapping_report", "select split_part(product_type, ' ', 1) as item_type, count(*) as rows from product_sourcing_item where product_type not like 'ECONOMY%' group by 1", PSI)
def _(t):
    rows = t.psi.select(F.split_part("product_type", F.lit(" "), F.lit(1)).alias("item_type"))
    return f.mapping_report(rows, rows.where("item_type = 'ECONOMY'"))


@query("a21_refresh", f"""{HISTORY}, facts as ({FACTORY}), facets as (select 'category' as c, category as v from import_history union select 'mc', mc from import_history union select 'importer', importer from import_history union select 'country', country from import_history union select 'import_type', import_type from import_history)
  select 'sku_history' as name, count(*) as n, cast(sum(import_count) as bigint) as total, count(*) filter (market_status = 'O') as marked from sh
  union all select 'sku_factory', count(*), cast(sum(import_count) as bigint), count(*) filter (importers like '%|%') from facts
  union all select 'market_status', count(*), cast(count(distinct sku_name) as bigint), count(*) filter (market_status = 'O') from status
  union all select 'facets', count(*), cast(sum(length(v)) as bigint), count(distinct c) from facets where v is not null""", IH)
def _(t):
    out = scratch(t)
    tb.refresh(t.ih_dealt.where("mc = 'bolt'"), out, AS_OF)
    tb.refresh(t.ih_dealt, out, AS_OF)
    total = lambda name, total, marked: versions.read(t.spark, out, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), total.cast("long").alias("total"), marked.alias("marked")).select("name", "n", "total", "marked")
    open_ = F.count_if(F.col("market_status") == "O")
    rows = total("sku_history", F.sum("import_count"), open_).unionByName(total("sku_factory", F.sum("import_count"), F.count_if(F.size("importers") > 1)))
    return rows.unionByName(total("market_status", F.count_distinct("sku_name"), open_)).unionByName(total("facets", F.sum(F.length("value")), F.count_distinct("column")))


@query("a22_conform", "select r_regionkey, r_name, cast(null as varchar) as r_comment from region")
def _(t):
    return f.conform(t.raw("region"), T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType()), T.StructField("r_comment", T.StringType())]))


@query("a14_snapshot_runs", "select 'run-2' as run_id, count(*) as rows, 'aeon,amazon,samsclub,walmart' as sites from product_sourcing_item", PSI)
def _(t):
    out = scratch(t)
    rows = t.psi.select("id", "retailer", F.col("brand_en").alias("brand"), F.col("product_name_en").alias("title"))
    tb.write_snapshot(tb.append_snapshot(rows, "run-2"), out)
    return retail.runs(t.spark.read.parquet(out))


@query("a14_load_snapshot", """, i as (select id, product_type, case when id % 5 = 0 then 'box' end as given, split_part(product_name_en, ', ', 2) as size, 'run-' || cast(id % 3 as varchar) as run_id from product_sourcing_item where lower(brand_en || ' ' || product_name_en) not like '%red%')
  select run_id, count(*) as row_count, count(*) as items, count(given) as given, count(distinct coalesce(given, size)) as units from i group by 1""", PSI)
def _(t):
    out = scratch(t)
    rows = t.psi.select("id", F.col("brand_en").alias("brand"), F.col("product_name_en").alias("title"), F.expr("case when id % 5 = 0 then 'box' when id % 5 = 1 then ' ' end").alias("unit"))
    for k in (0, 1, 2, 1):  # the second run is loaded again
        tb.load_snapshot(rows.where(F.col("id") % 3 == k), f"{out}/items", f"{out}/runs", f"run-{k}", datetime.datetime(2001, 6, 1 + k), "all", labels=["red"])
    found = t.spark.read.parquet(f"{out}/items").groupBy("run_id").agg(F.count("*").alias("items"), F.count_if(F.col("unit") == "box").alias("given"), F.count_distinct("unit").alias("units"))
    return t.spark.read.parquet(f"{out}/runs").select("run_id", "row_count").join(found, "run_id")
