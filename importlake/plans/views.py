"""The domain tables as views over the driver's tables. The same text runs in Spark and in DuckDB."""

from __future__ import annotations

import datetime
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from importlake.sources.staging import staged

AS_OF = datetime.date(2001, 6, 30)
TOP_RETAILERS = ["MACHINERY-0", "BUILDING-0", "AUTOMOBILE-0", "FURNITURE-0", "HOUSEHOLD-0"]

IMPORT_HISTORY = """
select
  case when split_part(p_name,' ',2) in ('ring','bolt','gear') then 'parts' else 'goods' end as category,
  nullif(split_part(p_name,' ',2),'ring') as mc,
  p_name as sku_name,
  case when l_returnflag='R' then 'OEM' else 'IMPORT' end as import_type,
  case when l_orderkey % 17 = 0 then null
       when length(p_name) % 3 = 0 then 'IMP-' || cast(l_suppkey % 10 as varchar(9))
       else c_mktsegment || '-' || cast(o_custkey % 2 as varchar(9)) end as importer,
  s_name as manufacturer,
  s_name || ' F' || cast(l_linenumber % 2 as varchar(9)) as factory,
  case when s_suppkey = 7 then null else n_name end as country,
  case when s_suppkey % 3 = 0 then null else lower(replace(s_name,'#','')) || '@example.com' end as email,
  case when s_suppkey % 4 = 0 then 'www.' || lower(replace(s_name,'#','')) || '.example.com' else null end as homepage,
  case when l_returnflag='R' then 'OEM OK' else null end as oem_status,
  case when l_orderkey % 5 = 0 then null else cast(l_shipdate as date) end as import_date,
  case when l_orderkey % 35 = 0 then null else cast(o_orderdate as date) end as process_date,
  case when length(p_name) % 4 = 0 then null else '0' || cast(length(p_name) as varchar(9)) || '0.10-2000' end as hs_code,
  case when p_size % 5 = 0 then null when p_size % 2 = 0 then cast(p_size as varchar(9)) || ' oz' else cast(p_size as varchar(9)) || ' pack' end as unit
from lineitem join orders on l_orderkey=o_orderkey join customer on c_custkey=o_custkey
join part on p_partkey=l_partkey join supplier on s_suppkey=l_suppkey join nation on n_nationkey=s_nationkey"""

COUNTRY_ITEM_AMOUNT = """
select country, coalesce(mc,'ring') as item_name, cast(count(*) as double)*3.5 as amount_usd_k,
  case when country='NATION_15' then null else cast(count(*) as double)*0.7 end as weight_ton
from import_history where country is not null group by country, coalesce(mc,'ring')"""

PRODUCT_SOURCING_ITEM = """
select p_partkey as id, p_type as product_type,
  case p_partkey % 4 when 0 then 'amazon' when 1 then 'walmart' when 2 then 'samsclub' else 'aeon' end as retailer,
  cast(row_number() over (partition by p_type, p_partkey % 4 order by p_retailprice desc, p_partkey) as int) as rank,
  p_brand as brand_en, p_name || ', ' || cast(p_size as varchar(9)) || ' oz' as product_name_en,
  p_retailprice as price_usd, cast(p_size as varchar(9)) || ' oz' as unit,
  case when p_partkey % 6 = 0 then 'O' when p_partkey % 6 = 1 then 'X' when p_partkey % 6 = 2 then null else 'NONE' end as parallel_import,
  case when p_partkey % 5 = 0 then 'FAIL' else 'PASS' end as recall_status,
  case when p_partkey % 7 = 0 then null else 'PASS' end as quality_label_status,
  'PASS' as legal_risk_status,
  case when p_partkey % 9 = 0 then null else lower(replace(p_brand,'#','_')) end as brand_group_key,
  case when p_partkey % 9 = 0 then null else lower(replace(p_brand,'#','_')) || '_' || split_part(p_name,' ',2) end as product_group_key
from part"""

PRODUCT_EMBEDDING = """
select vec_id, p_name as sku_name, split_part(p_name,' ',2) as mc,
  case when split_part(p_name,' ',2) in ('ring','bolt','gear') then 'parts' else 'goods' end as category,
  embedding, case when vec_id % 50 = 0 then 'failed' else 'completed' end as status, 'm64' as model
from (select *, vec_id % (select count(*) from part) as part_of from embeddings) e join part on p_partkey = part_of"""

#: Small reference tables, the same on both engines.
VALUES = {
    "tariff_rate": """select * from (values
      ('05001','A',8.0,cast(null as date),cast(null as date)), ('05001','F1',0.0,date '2000-01-01',date '2001-12-31'),
      ('05001','F2',3.5,date '1990-01-01',date '1999-12-31'), ('05001','C',1.0,cast(null as date),cast(null as date)),
      ('09001','A',6.5,date '1999-01-01',cast(null as date)), ('09001','F3',6.5,cast(null as date),cast(null as date)),
      ('010010','A',30.0,cast(null as date),cast(null as date)), ('011010','A',5.0,cast(null as date),date '2000-12-31'),
      ('011010','F1',2.25,cast(null as date),cast(null as date)), ('0100102000','A',8.0,cast(null as date),cast(null as date)),
      ('0100102000','F1',0.0,date '2000-01-01',date '2001-12-31'), ('090102000','A',6.5,cast(null as date),cast(null as date)),
      ('0110102000','A',12.5,cast(null as date),cast(null as date)), ('0110102000','F2',4.25,cast(null as date),cast(null as date)),
      ('090102000','F3',6.5,cast(null as date),cast(null as date)), ('0100102000','C',1.0,cast(null as date),cast(null as date)))
      as t(hs_code, rate_type, rate_pct, effective_from, effective_to)""",
    "fta_map": """select * from (values ('NATION_1','F1'), ('NATION_1','F2'), ('NATION_15','F1'), ('NATION_4','F3'), ('NATION_9','F2'), ('NATION_20','F1'))
      as t(country, rate_type)""",
}

VIEWS = {
    "import_history": IMPORT_HISTORY,
    "country_item_amount": COUNTRY_ITEM_AMOUNT,
    "product_sourcing_item": PRODUCT_SOURCING_ITEM,
    "product_embedding": PRODUCT_EMBEDDING,
    **VALUES,
}
#: Spark joins as written: orders meet their customers before the line items, several times as many, are dealt out, which spares those a shuffle.
GROUPED_JOIN = "orders on l_orderkey=o_orderkey join customer on c_custkey=o_custkey", "(orders join customer on c_custkey=o_custkey) on l_orderkey=o_orderkey"
#: With these, line items aren't sorted: they meet hash tables of their orders, parts and suppliers, which are fewer and unique by key, so that no key makes them large.
HASHED_JOIN = ("\nselect\n", "\nselect /*+ shuffle_hash(bought, goods, maker) */\n"), (GROUPED_JOIN[1].split(" on l_")[0], f"(select * from {GROUPED_JOIN[1].split(' on l_')[0][1:-1]}) bought"), ("join part on", "join (select * from part) goods on"), ("join supplier on", "join (select * from supplier) maker on")
#: For all records and filters on goods or makers: line items meet parts and suppliers first and their orders last, each in as few bytes as the view needs (it asks an order's key
#: only whether 5, 17 and 35 divide it, which they do what is left by their least common multiple). The view's text columns are made behind the ``hint``, before which numbers stand first, as they compress better so.
GOODS_FIRST = """
from (select *, s_suppkey as l_suppkey from (
  select {hint} s_suppkey, l_shipdate, o_orderdate, l_orderkey % 595 as l_orderkey, p_size, o_custkey, l_linenumber, s_name, l_returnflag, n_name, c_mktsegment, p_name
  from (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, cast(l_shipdate as date) as l_shipdate from lineitem)
  join part on p_partkey=l_partkey join supplier on s_suppkey=l_suppkey join nation on n_nationkey=s_nationkey
  join (select o_orderkey, o_custkey % 2 as o_custkey, cast(o_orderdate as date) as o_orderdate, c_mktsegment from orders join customer on c_custkey=o_custkey) on o_orderkey=l_orderkey))"""
NEEDS = {"country_item_amount": ["import_history"]}


def ctes(*names: str) -> str:
    """``with`` and the views named, for a query in DuckDB."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in order)


class Tables:
    """The tables and views of a folder as DataFrames, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str, *tables: str, hashed: bool = False, goods_first: bool = False, dealt: bool = False, **frames: DataFrame) -> DataFrame:
        frames |= {t: self.raw(t) for t in tables}
        text = VIEWS[name].replace(*GROUPED_JOIN)
        if goods_first or dealt:
            # A number, as rows are several times wider behind the deal than in it: by the bytes dealt, partitions would be merged to too large ones.
            hint = f"/*+ repartition({self.spark.conf.get('spark.sql.shuffle.partitions')}, p_name, s_name) */" if dealt else ""
            text = text.split("\nfrom ")[0] + GOODS_FIRST.format(hint=hint)
        for change in HASHED_JOIN if hashed else ():
            text = text.replace(*change, 1)
        for t in frames:
            text = re.sub(rf"(?:(?<=from |join )|(?<=join \()){t}\b(?!\.)", f"{{{t}}}", text)
        return self.spark.sql(text, **frames)

    @cached_property
    def ih(self) -> DataFrame:
        return self.records(lineitem=self.raw("lineitem"))

    @cached_property
    def ih_hashed(self) -> DataFrame:
        """``ih`` without a sort of the line items, for queries of which a task would hold many of them."""
        return self.records(lineitem=self.raw("lineitem"), hashed=True)

    @cached_property
    def ih_goods_first(self) -> DataFrame:
        """``ih`` for filters on goods and makers, which thin the line items before they meet their orders."""
        return self.records(lineitem=self.raw("lineitem"), goods_first=True)

    @cached_property
    def ih_dealt(self) -> DataFrame:
        """``ih_goods_first`` dealt out by goods and maker, for queries that group all records by more than these: they are not shuffled again for it."""
        return self.records(lineitem=self.raw("lineitem"), dealt=True)

    def records(self, lineitem: DataFrame, **how: bool) -> DataFrame:
        """Import records of line items."""
        return self.view("import_history", "orders", "customer", "part", "supplier", "nation", lineitem=lineitem, **how)

    @cached_property
    def cia(self) -> DataFrame:
        """Written once: it is small, made from all records, and queries read it several times."""
        return staged(self.view("country_item_amount", import_history=self.ih))

    @cached_property
    def psi(self) -> DataFrame:
        return self.view("product_sourcing_item", "part")

    @cached_property
    def emb(self) -> DataFrame:
        return self.view("product_embedding", "embeddings", "part")

    @cached_property
    def tariffs(self) -> DataFrame:
        return self.spark.sql(VALUES["tariff_rate"])

    @cached_property
    def fta(self) -> DataFrame:
        return self.spark.sql(VALUES["fta_map"])
