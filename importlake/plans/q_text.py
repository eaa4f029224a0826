"""Queries of the text functions, over product names, documents and inline rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators.matching import translate_names
from importlake.operators.retail import retailer_country
from importlake.plans.registry import query

C = F.col
PSI, IH, EMB = ("product_sourcing_item",), ("import_history",), ("product_embedding",)
ALIASES = {"Red House": ["^red"], "Bolt Makers": ["bolt", "gear bolt"], "Blue": ["blue ring"]}


def one(name, table, sql, views, **columns):
    """A query of scalar columns over the distinct values of a table's columns."""

    @query(name, sql, views)
    def _(t):
        return columns["f"](getattr(t, table) if hasattr(type(t), table) else t.raw(table))


one("b1_strip_legal", "psi", "select distinct p as raw, nullif(trim(regexp_replace(regexp_replace(p, '[(（]?\\s*주\\s*[)）]|주식회사\\s*|㈜\\s*|농업회사법인\\s*', '', 'g'), '\\s+', ' ', 'g')), '') as cleaned from (select case id % 4 when 0 then '(주)' || brand_en when 1 then brand_en || ' 주식회사' when 2 then '㈜  ' || brand_en || '  x' else ' 주식회사 ' end as p from product_sourcing_item)", PSI,
    f=lambda d: d.select(F.expr("case id % 4 when 0 then '(주)' || brand_en when 1 then brand_en || ' 주식회사' when 2 then '㈜  ' || brand_en || '  x' else ' 주식회사 ' end").alias("raw")).distinct().withColumn("cleaned", x.strip_legal(C("raw"))))
one("b2_canonical_importer", "ih", "select distinct sku_name, case when lower(sku_name) in ('bolt', 'gear bolt') then 'Bolt Makers' when lower(sku_name) = 'blue ring' then 'Blue' when contains(sku_name, 'gear bolt') then 'Bolt Makers' when contains(sku_name, 'blue ring') then 'Blue' when contains(sku_name, 'bolt') then 'Bolt Makers' when starts_with(sku_name, 'red') then 'Red House' else sku_name end as importer from import_history", IH,
    f=lambda d: d.select("sku_name").distinct().withColumn("importer", x.canonical_importer(C("sku_name"), ALIASES)))
one("b3_canonical_alias", "ih", "select distinct mc, case when mc = 'bolt' then 'Bolt Makers' else mc end as alias from import_history", IH, f=lambda d: d.select("mc").distinct().withColumn("alias", x.canonical_alias(C("mc"), ALIASES)))
one("b4_oem_flag", "ih", "select distinct oem_status, case when trim(oem_status) <> '' then 'OEM' else '수입' end as flag from import_history", IH, f=lambda d: d.select("oem_status").distinct().withColumn("flag", x.oem_flag(C("oem_status"))))
one("b5_safe_date", "orders", "select o_orderkey, case o_orderkey % 4 when 3 then null else cast(o_orderdate as date) end as day from orders", (),
    f=lambda d: d.select("o_orderkey", x.safe_date(F.expr("case o_orderkey % 4 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'yyyyMMdd') when 2 then date_format(o_orderdate, 'yyyy/M/d') else 'soon' end")).alias("day")))
one("b6_blank_to_null", "psi", "select id, case when id % 3 = 0 then null when id % 3 = 1 then null else brand_en end as v from product_sourcing_item", PSI, f=lambda d: d.select("id", x.blank_to_null(F.expr("case id % 3 when 0 then '  ' when 1 then ' NaN ' else ' ' || brand_en || ' ' end"), literals=True).alias("v")))
one("b7_country", "ih", "select distinct country, case when country = 'NATION_1' then '기타' else country end as label from import_history", IH, f=lambda d: d.select("country").distinct().withColumn("label", x.normalize_country(F.expr("case when country = 'NATION_1' then '기타 (ZZ)' else country end"))))
one("b8_product_text", "ih", ", p as (select distinct sku_name, mc, category, sku_name || coalesce(' | ' || mc, '') || ' | ' || category as product_text from import_history) select *, sha256(product_text) as text_hash from p", IH, f=lambda d: d.select("sku_name", "mc", "category").distinct().withColumn("product_text", x.product_text(C("sku_name"), C("mc"), C("category"))).withColumn("text_hash", x.text_hash(C("product_text"))))
one("b9_norm_key", "psi", "select id, lower(replace(product_name_en, ', ', ',  ')) as raw, lower(product_name_en) as norm_key from product_sourcing_item", PSI, f=lambda d: d.select("id", F.lower(F.replace("product_name_en", F.lit(", "), F.lit(",  "))).alias("raw"), x.norm_key(F.replace(F.upper("product_name_en"), F.lit(", "), F.lit(",  "))).alias("norm_key")))
one("b10_vector_key", "emb", "select distinct mc, lower(trim(coalesce(mc, ''))) as key from product_embedding", EMB, f=lambda d: d.select("mc").distinct().withColumn("key", x.vector_key(F.concat(F.lit(" "), F.upper("mc"), F.lit(" ")))))
one("b11_brand_key", "psi", "select distinct brand_en, lower(brand_en) as key from product_sourcing_item", PSI, f=lambda d: d.select("brand_en").distinct().withColumn("key", x.brand_key(F.concat(C("brand_en"), F.lit(" Ｃo., Ltd.")))))
one("b12_name_key", "psi", "select distinct product_name_en, regexp_replace(replace(lower(product_name_en), ',', ' '), ' +', ' ', 'g') as key from product_sourcing_item", PSI, f=lambda d: d.select("product_name_en").distinct().withColumn("key", x.name_key(C("product_name_en"))))
one("b13_alnum_key", "ih", "select distinct factory, regexp_replace(upper(coalesce(factory, '')), '[^A-Z0-9가-힣]', '', 'g') as key from import_history", IH, f=lambda d: d.select("factory").distinct().withColumn("key", x.alnum_key(C("factory"))))
one("b14_hs_digits", "ih", "select distinct hs_code, nullif(regexp_replace(hs_code, '\\D', '', 'g'), '') as digits from import_history", IH, f=lambda d: d.select("hs_code").distinct().withColumn("digits", x.hs_digits(C("hs_code"))))
one("b15_url_hash", "pages", "select page_id, sha256(url) as url_hash from pages", (), f=lambda d: d.select("page_id", x.text_hash(C("url")).alias("url_hash")))
one("b16_unit_to_kg", "ih", "select distinct unit, case when unit like '% oz' then round(cast(split_part(unit, ' ', 1) as double) * 0.028349523125, 9) end as kg from import_history", IH, f=lambda d: d.select("unit").distinct().withColumn("kg", F.round(x.unit_to_kg(C("unit")), 9)))
one("b17_extract_unit", "psi", "select id, split_part(product_name_en, ', ', 2) as unit_found from product_sourcing_item", PSI, f=lambda d: d.select("id", x.extract_unit(C("product_name_en")).alias("unit_found")))
one("b18_format_unit", "psi", "select distinct unit, case when g >= 1000 then regexp_replace(printf('%.1f', round(g / 1000, 1)), '\\.0$', '') || 'kg' else regexp_replace(printf('%.1f', round(g, 1)), '\\.0$', '') || 'g' end as shown from (select unit, round(cast(split_part(unit, ' ', 1) as double) * 28.349523125, 6) as g from product_sourcing_item)", PSI, f=lambda d: d.select("unit").distinct().withColumn("shown", x.format_unit(C("unit"))))
one("b19_slug", "psi", "select distinct product_name_en, replace(replace(product_name_en, ', ', '_'), ' ', '_') as slug from product_sourcing_item", PSI, f=lambda d: d.select("product_name_en").distinct().withColumn("slug", x.slug(F.concat(F.lit("- "), F.upper("product_name_en"), F.lit("!")))))
one("b20_brand_from_title", "psi", "select distinct product_name_en, split_part(product_name_en, ',', 1) as brand, split_part(product_name_en, ' ', 1) as marked from product_sourcing_item", PSI, f=lambda d: d.select("product_name_en").distinct().select("product_name_en", x.brand_from_title(F.concat(F.lit("2X-"), C("product_name_en"))).alias("brand"), x.brand_from_title(F.regexp_replace("product_name_en", "^(\\S+) ", "$1® ")).alias("marked")))
one("b21_brand_first_words", "psi", "select distinct product_name_en, split_part(product_name_en, ' ', 1) as brand from product_sourcing_item", PSI, f=lambda d: d.select("product_name_en").distinct().withColumn("brand", x.brand_first_words(C("product_name_en"), 1)))
one("b22_parse_numbers", "psi", "select id, round(price_usd, 2) as price, case when id % 6 < 5 then (id % 6) + 0.5 else 5.0 end as rating, cast(floor((id % 97) / 10.0 * 1000 + 0.5) as bigint) as reviews from product_sourcing_item", PSI,
    f=lambda d: d.select("id", x.parse_price(F.concat(F.lit("USD "), F.format_number("price_usd", 2))).alias("price"), x.parse_rating(F.expr("case when id % 6 < 5 then cast(id % 6 as string) || '.5 out of 5' else '5 stars' end")).alias("rating"), x.parse_count(F.expr("format_string('%.1fK', (id % 97) / 10.0D)")).alias("reviews")))
one("b23_to_usd", "psi", "select id, round(round(price_usd, 2) * case when retailer = 'aeon' then 0.0067 else 1.0 end, 2) as usd from product_sourcing_item", PSI, f=lambda d: d.select("id", x.to_usd(F.format_number("price_usd", 2), C("retailer"), {"aeon": 0.0067}).alias("usd")))
one("b24_base_title", "psi", "select distinct product_name_en, trim(regexp_replace(product_name_en, '[0-9]+ oz', '')) as base from product_sourcing_item", PSI, f=lambda d: d.select("product_name_en").distinct().withColumn("base", x.base_title(C("product_name_en"))))
one("b25_fold_text", "documents", "select doc_id, sha256(f) as folded_sha256, length(f) as n from (select doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as f from documents)", (), f=lambda d: d.select("doc_id", F.sha2(x.fold_text(C("text")), 256).alias("folded_sha256"), F.length(x.fold_text(C("text"))).alias("n")))
one("b26_canonical_phrase", "ih", "select distinct sku_name, replace(replace(sku_name, 'red bolt', 'RB'), 'blue bolt', 'RB') as phrase from import_history", IH, f=lambda d: d.select("sku_name").distinct().withColumn("phrase", x.canonical_phrase(C("sku_name"), ["red bolt", "blue bolt"], "RB")))
one("b27_drop_words", "ih", "select distinct sku_name, case when split_part(sku_name, ' ', 1) = 'red' then split_part(sku_name, ' ', 2) else sku_name end as kept from import_history", IH, f=lambda d: d.select("sku_name").distinct().withColumn("kept", x.drop_words(C("sku_name"), ["red", "classic"])))
one("b28_core_name", "psi", "select distinct product_name_en, regexp_replace(product_name_en, ' [0-9]+ oz$', '') as core from product_sourcing_item", PSI, f=lambda d: d.select("product_name_en").distinct().withColumn("core", x.core_name(F.concat(C("product_name_en"), F.lit(" (2 pack) 500 ml")))))
one("b29_content_tokens", "psi", "select distinct product_name_en, 'l' || split_part(product_name_en, ' ', 1) || '|' || rtrim(split_part(product_name_en, ' ', 2), ',') as tokens from product_sourcing_item", PSI, f=lambda d: d.select("product_name_en").distinct().withColumn("tokens", F.array_join(x.content_tokens(F.regexp_replace(F.concat(F.lit("l "), F.regexp_replace("product_name_en", " oz$", "oz")), ",", "")), "|")))
one("b30_translate", "psi", "select product_type, case when product_type like 'E%' then 'KO ' || product_type when product_type like 'S%' then null else product_type end as english from (select distinct product_type from product_sourcing_item)", PSI,
    f=lambda d: translate_names(d.select("product_type").distinct().withColumn("name", F.expr("case when product_type like 'E%' or product_type like 'S%' then '한 ' || product_type else product_type end")), d.where("product_type like 'E%'").select(F.expr("'한 ' || product_type").alias("name"), F.expr("'KO ' || product_type").alias("english")).distinct(), "name").select("product_type", "english"))
one("b31_private_label", "psi", "select id, id % 5 = 0 as own_brand from product_sourcing_item", PSI, f=lambda d: d.select("id", x.is_private_label(F.expr("case when id % 5 = 0 then 'Great Value' else brand_en end"), C("product_name_en")).alias("own_brand")))
one("b32_emails", "documents", "select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda e: lower(regexp_replace(e, '^[.]+|[.]+$', '', 'g'))))), '|') as emails from documents", (), f=lambda d: d.select("doc_id", F.array_join(x.extract_emails(C("text")), "|").alias("emails")))
one("b33_registered_domain", "pages", "select distinct host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain from (select regexp_extract(url, '://([^/?#]+)', 1) as host from pages)", (), f=lambda d: d.select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host")).distinct().withColumn("domain", x.registered_domain(C("host"))))
one("b34_pick_email", "ih", "select distinct manufacturer, homepage, case when homepage is null then 'info@example.com' when homepage is not null then 'sales2@' || regexp_extract(homepage, '[^.]+\\.com$') end as picked from import_history", IH, f=lambda d: d.select("manufacturer", "homepage").distinct().withColumn("picked", x.pick_email(F.when(C("homepage").isNull(), F.array(F.lit("bob@example.com"), F.lit("sales@a.org"), F.lit("info@example.com"))).otherwise(F.array(F.lit("sales2@example.com"), F.lit("info@other.com"), F.lit("amy@example.com"))), C("homepage"))))
one("b35_split_list", "ih", "select distinct sku_name, replace(sku_name, ' ', '|') as parts from import_history", IH, f=lambda d: d.select("sku_name").distinct().withColumn("parts", F.array_join(x.split_list(F.concat(F.replace("sku_name", F.lit(" "), F.lit(" , ")), F.lit(",, "))), "|")))
one("b37_countries", "ih", "select distinct country, case when country is null then null when country = 'NATION_15' then 'NATION_15|NATION_1|NATION_4' when country like 'NATION_1%' then 'NATION_1|NATION_4' else 'NATION_4' end as found from import_history", IH, f=lambda d: d.select("country").distinct().withColumn("found", F.array_join(x.countries_in_text(F.concat(C("country"), F.lit(" (and NATION_4)")), ["NATION_1", "NATION_4", "NATION_15"]), "|")))
one("b41_subtitle", "psi", "select distinct retailer, case when retailer = 'amazon' then 'AMZ' else retailer end as parsed, 'best seller' as method, cast(10 as integer) as n from product_sourcing_item", PSI, f=lambda d: d.select("retailer").distinct().withColumn("s", x.parse_subtitle(F.concat(F.initcap("retailer"), F.lit(" (best seller, 10 items)")), {"amazon": "AMZ"})).select("retailer", F.col("s.retailer").alias("parsed"), "s.method", "s.n"))
one("b42_label", "psi", "select distinct brand_en, case when brand_en like 'Brand#1%' then 'first' when brand_en = 'Brand#23' then 'exact' end as field from product_sourcing_item", PSI, f=lambda d: d.select("brand_en").distinct().withColumn("field", x.classify_label(C("brand_en"), {"Brand#1*": "first", "Brand#23": "exact"})))
one("b43_clean_url", "pages", "select page_id, case when page_id % 2 = 0 then url end as url from pages", (), f=lambda d: d.select("page_id", x.clean_url(F.expr("case when page_id % 2 = 0 then ' ' || url else 'ftp:' || url end")).alias("url")))
one("b44_clamp", "psi", "select id, case when parallel_import in ('O', 'X') then parallel_import else 'NONE' end as verdict from product_sourcing_item", PSI, f=lambda d: d.select("id", x.clamp(C("parallel_import"), ["O", "X"], "NONE").alias("verdict")))
one("b45_retailer_country", "psi", "select distinct retailer, case when retailer = 'aeon' then 'JP' else 'US' end as country from product_sourcing_item", PSI, f=lambda d: d.select("retailer").distinct().withColumn("country", retailer_country(C("retailer"))))
one("b46_verdict_lines", "ih", "select distinct factory, factory || ': a, b (2)' as lines from import_history", IH, f=lambda d: d.select("factory").distinct().withColumn("lines", x.verdict_lines(F.to_json(F.array(F.struct(C("factory"), F.array(F.lit("a"), F.lit("b")).alias("importers")))))))
one("b47_scores", "psi", "select id, case when parallel_import = 'O' then 2 when parallel_import = 'NONE' then 1 else 0 end as parallel_points, coalesce(cast(recall_status = 'PASS' as integer), 0) + coalesce(cast(quality_label_status = 'PASS' as integer), 0) + 1 as passes from product_sourcing_item", PSI, f=lambda d: d.select("id", x.parallel_score(C("parallel_import"), none="NONE").alias("parallel_points"), x.risk_pass([C("recall_status"), C("quality_label_status"), C("legal_risk_status")], "PASS").alias("passes")))
one("b50_valid_vector", "embeddings", "select vec_id, len(embedding) = 64 and sqrt(list_sum(list_transform(embedding, lambda v: cast(v as double) * v))) between 0.98 and 1.02 as valid from embeddings", (), f=lambda d: d.select("vec_id", x.valid_vector(C("embedding"), 64).alias("valid")))
one("b51_mean_pool", "embeddings", "select vec_id, round((cast(embedding[1] as double) + cast(embedding[3] as double)) / 2, 7) as first_mean from embeddings", (), f=lambda d: d.select("vec_id", F.round(x.mean_pool(F.transform(C("embedding"), lambda v: F.array(v)), F.transform(C("embedding"), lambda v, i: F.when(i.isin(0, 2), 1).otherwise(0)))[0], 7).alias("first_mean")))
one("c8_trigram", "ih", "select sku_name, round(shared_n * 1.0 / (n + m - shared_n), 6) as similarity from (select sku_name, len(list_intersect(t, q)) as shared_n, len(t) as n, len(q) as m from (select sku_name, list_distinct(flatten(list_transform(string_split(lower(sku_name), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))) as t, list_distinct(flatten(list_transform(string_split(lower('red bolts'), ' '), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))) as q from (select distinct sku_name from import_history))) where shared_n * 1.0 / (n + m - shared_n) >= 0.3", IH, f=lambda d: d.select("sku_name").distinct().where(x.trigram_similarity(C("sku_name"), F.lit("red bolts")) >= 0.3).withColumn("similarity", F.round(x.trigram_similarity(C("sku_name"), F.lit("red bolts")), 6)))
