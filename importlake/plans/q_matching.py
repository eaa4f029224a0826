"""Queries of product matching. Targets are the retail names, candidates the import records' names with a brand in front."""

from __future__ import annotations

from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators import extensions as ext
from importlake.operators import matching as m
from importlake.plans.registry import query
from importlake.sources.staging import staged

PSI = ("product_sourcing_item",)
#: A retail product's name is "BRAND words, n oz"; a record's is "BRAND words" or "words" with the brand in the factory.
#: What is a bolt in the tables is an oil here, named in Italian on the retail side and in English or Spanish in the records.
SHELF = "brand_en || ' ' || replace(product_name_en, ' bolt', case when id % 2 = 0 then ' Olio Extra Vergine d''Oliva' else ' olio extravergine di oliva' end)"
NAMED = "replace(product_name_en, ' bolt', case when id % 4 = 0 then ' EXTRA VIRGIN olive oil' when id % 4 = 1 then ' aceite de oliva virgen extra' else ' Extra-Virgin' end)"
SKU = f"case when id % 3 = 0 then {NAMED} else brand_en || ' ' || split_part({NAMED}, ',', 1) end"
RECORDS = f"""select {SKU} as sku_name, brand_en || ' foods' as factory, 'imp-' || cast(id % 5 as varchar(9)) as importer, 'maker ' || product_type as manufacturer, id from product_sourcing_item"""


def spark_sql(text):
    return text.replace("''", "\\'")


def records(t):
    return t.psi.select(
        F.expr(SKU).alias("sku_name"), F.concat("brand_en", F.lit(" foods")).alias("factory"), F.expr("'imp-' || (id % 5)").alias("importer"),
        F.concat(F.lit("maker "), "product_type").alias("manufacturer"), "id",
    )


def targets(t):
    return t.psi.select(F.expr(spark_sql(SHELF)).alias("target"), F.col("brand_en").alias("brand")).distinct()


def candidates(t):
    return records(t).select(F.col("sku_name").alias("candidate"), "factory").distinct()


def checked(t):
    """Written once where a query reads it more than once."""
    return m.cross_check(targets(t), candidates(t))


def told(t):
    """The records by the name that is matched."""
    return records(t).select(F.col("sku_name").alias("candidate"), "sku_name", "factory", "importer").distinct()


def decisions(pairs):
    pairs = pairs.where("ambiguous").select("target", "candidate").distinct()
    return pairs.where(F.length("candidate") % 3 < 2).withColumn("accepted", F.length("candidate") % 3 == 0)


def norm(c):
    """The names are of plain letters, digits and punctuation, so this is how they fold."""
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


def canonical(c):
    """``norm`` with the phrases as one word, in the order of the patterns."""
    token = "' gradeextravirgin '"
    whole = r"\b(extra ?virgin olive oil|olio extra ?vergine d ?i? ?oliva|aceite de oliva (virgen extra|extra virgen))\b"
    short = r"\b(extra ?virgin|extra ?vergine|virgen extra|extra virgen)\b"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({norm(c)}, '{whole}', {token}, 'g'), '{short}', {token}, 'g'), ' +', ' ', 'g'))"


def squeezed(c):
    return f"replace({c}, ' ', '')"


def either(a, b):
    return f"case when length({a}) <= length({b}) then contains({b}, {a}) else contains({a}, {b}) end"


def tokens(c):
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> '' and not regexp_matches(w, '^[0-9]+(ml|l|kg|g|oz|lb|fl)?$')))"


def tier(a, b, ta, tb):
    return f"""case when {a} = '' or {b} = '' then null when {either(a, b)} then 'continuous' when {either(squeezed(a), squeezed(b))} then 'compact'
      when least(len({ta}), len({tb})) >= 2 and case when len({ta}) <= len({tb}) then list_has_all({tb}, {ta}) else list_has_all({ta}, {tb}) end then 'token_subset' end"""


BARE = "trim(regexp_replace(replace(' ' || t_norm || ' ', ' ' || b_norm || ' ', ' '), ' +', ' ', 'g'))"
CHECKED = f"""r as ({RECORDS}),
  tg as (select *, {tokens('t_norm')} as tt, {tokens('bare')} as bt from (select *, {BARE} as bare from (select distinct {SHELF} as target, brand_en as brand, {canonical(SHELF)} as t_norm, {norm('brand_en')} as b_norm from product_sourcing_item))),
  cd as (select *, {tokens('c_norm')} as ct from (select distinct sku_name as candidate, factory, {canonical('sku_name')} as c_norm, {norm('factory')} as f_norm from r)),
  primary_pairs as (select distinct target, brand, candidate, {tier('c_norm', 't_norm', 'ct', 'tt')} as tier, 'name' as via from tg join (select distinct candidate, c_norm, ct from cd) on contains({squeezed('c_norm')}, {squeezed('b_norm')}) where tier is not null),
  fallback as (select distinct target, brand, candidate, factory, {tier('c_norm', 'bare', 'ct', 'bt')} as tier, 'factory' as via from tg join cd on contains({squeezed('f_norm')}, {squeezed('b_norm')}) and not contains({squeezed('c_norm')}, {squeezed('b_norm')}) where tier is not null),
  checked as (select *, tier in ('compact', 'token_subset') as ambiguous from primary_pairs union all (select distinct target, brand, candidate, tier, via, true from fallback))"""
MATCHES = f"""{CHECKED}, matches as (select target, candidate, ambiguous, factory, importer, candidate as sku_name from (select target, candidate, bool_or(ambiguous) as ambiguous from checked group by 1, 2) join (select distinct sku_name as candidate, factory, importer from r) using (candidate)),
  decided as (select distinct target, candidate, length(candidate) % 3 = 0 as accepted from checked where ambiguous and length(candidate) % 3 < 2),
  kept as (select m.*, m.ambiguous and accepted is null as pending from matches m left join decided using (target, candidate) where coalesce(accepted, true)),
  old as (select target, case when max(n) > 1 then 'O' else 'X' end as old_status from (select target, factory, count(distinct importer) as n from matches group by 1, 2) group by 1),
  new as (select target, case when max(n) > 1 then 'O' else 'X' end as new_status from (select target, factory, count(distinct importer) as n from kept group by 1, 2) group by 1)"""


@query("l1_contains_match", f", {CHECKED} select * from primary_pairs", PSI)
def _(t):
    return m.contains_match(targets(t), candidates(t))


@query("l2_brand_in_text", f", r as ({RECORDS}) select distinct brand_en as brand, sku_name from (select distinct brand_en, {squeezed(norm('brand_en'))} as b from product_sourcing_item) join (select distinct sku_name, {squeezed(norm('sku_name'))} as n from r) on contains(n, b)", PSI)
def _(t):
    brands = t.psi.select(F.col("brand_en").alias("brand")).distinct().withColumn("b_norm", x.fold_text(F.col("brand")))
    names = records(t).select("sku_name").distinct().withColumn("n_norm", x.fold_text(F.col("sku_name")))
    return m.holding(brands, "b_norm", names, "n_norm").join(brands, "b_norm").join(names, "n_norm").where(m.brand_in_text(F.col("b_norm"), F.col("n_norm"))).select("brand", "sku_name")


@query("l3_factory_fallback", f", {CHECKED} select * from fallback", PSI)
def _(t):
    return m.factory_fallback(targets(t), candidates(t))


@query("l4_match_tier", "select product_name_en as name, split_part(product_name_en, ',', 1) as short, 'continuous' as whole_tier, 'token_subset' as swapped_tier, 'compact' as squeezed_tier from (select distinct product_name_en from product_sourcing_item) where split_part(split_part(product_name_en, ',', 1), ' ', 1) <> split_part(split_part(product_name_en, ',', 1), ' ', 2)", PSI)
def _(t):
    names = t.psi.select(F.col("product_name_en").alias("name")).distinct().withColumn("short", F.split_part("name", F.lit(","), F.lit(1)))
    clean = F.regexp_replace("name", ",", "")
    swapped = F.concat_ws(" ", F.split_part("short", F.lit(" "), F.lit(2)), F.split_part("short", F.lit(" "), F.lit(1)))
    squeezed = F.concat(F.replace("short", F.lit(" "), F.lit("")), F.lit("x"))
    out = names.select("name", "short", m.match_tier(clean, F.col("short")).alias("whole_tier"), m.match_tier(clean, swapped).alias("swapped_tier"), m.match_tier(squeezed, F.col("short")).alias("squeezed_tier"))
    return out.where(F.split_part("short", F.lit(" "), F.lit(1)) != F.split_part("short", F.lit(" "), F.lit(2)))


@query("l5_cross_check", f", {CHECKED} select * from checked", PSI)
def _(t):
    return checked(t)


@query("l6_review_queue", f", {CHECKED} select target, candidate, count(*) as occurrences, min(tier) as tier, min(via) as via from checked where ambiguous group by 1, 2", PSI)
def _(t):
    return m.review_queue(checked(t))


@query("e29_review_items", "select brand_en as target, retailer as candidate, count(*) as occurrences from product_sourcing_item where id % 2 = 0 group by 1, 2", PSI)
def _(t):
    rows = t.psi.select(F.col("brand_en").alias("target"), F.col("retailer").alias("candidate"), (F.col("id") % 2 == 0).alias("ambiguous"), F.lit("compact").alias("tier"), F.lit("name").alias("via"))
    return m.review_queue(rows).select("target", "candidate", "occurrences")


@query("l7_revise_status", f", {MATCHES} select target, old_status, new_status, coalesce(p.pending, false) as pending, old_status is distinct from new_status as changed from old left join new using (target) left join (select target, bool_or(pending) as pending from kept group by 1) p using (target)", PSI)
def _(t):
    pairs = staged(checked(t))
    return m.revise_status_of(pairs, told(t), decisions(pairs))


LINKS = "links as (select brand_en as target, retailer as candidate, id % 3 = 0 as ambiguous, 'F' || cast(id % 4 as varchar(9)) as factory, case when id % 9 = 0 then null else 'I' || cast(id % 2 as varchar(9)) end as importer, product_name_en as sku_name from product_sourcing_item)"


def links(t):
    return t.psi.select(F.col("brand_en").alias("target"), F.col("retailer").alias("candidate"), (F.col("id") % 3 == 0).alias("ambiguous"), F.expr("'F' || (id % 4)").alias("factory"), F.expr("case when id % 9 = 0 then null else 'I' || (id % 2) end").alias("importer"), F.col("product_name_en").alias("sku_name"))


@query("e19_by_factory", f", {LINKS} select target, factory, string_agg(distinct importer, '|' order by importer) as importers, string_agg(distinct sku_name, '|' order by sku_name) as skus from links where importer is not null group by 1, 2", PSI)
def _(t):
    return m.by_factory(links(t)).select("target", "factory", F.array_join("importers", "|").alias("importers"), F.array_join("skus", "|").alias("skus"))


@query("e20_judge", f", {LINKS}, g as (select target, factory, count(distinct importer) as n from links where importer is not null group by 1, 2) select target, count(*) as factories, cast(sum(case when n > 1 then 1 else 0 end) as bigint) as parallel_factories, case when bool_or(n > 1) then 'O' else 'X' end as status from g group by 1", PSI)
def _(t):
    return m.judge(m.by_factory(links(t)))


@query("d21_apply_decisions", f", {LINKS}, d as (select distinct brand_en as target, 'aeon' as candidate, brand_en like 'Brand#1%' as accepted from product_sourcing_item) select l.target, l.candidate, l.ambiguous and d.accepted is null as pending, count(*) as n from links l left join d using (target, candidate) where coalesce(d.accepted, true) group by 1, 2, 3", PSI)
def _(t):
    d = t.psi.select(F.col("brand_en").alias("target"), F.lit("aeon").alias("candidate"), F.col("brand_en").startswith("Brand#1").alias("accepted")).distinct()
    return m.apply_decisions(links(t), d).groupBy("target", "candidate", "pending").agg(F.count("*").alias("n"))


@query("h4_set_mismatch", f", {LINKS}, a as (select target, factory from links where not ambiguous group by 1, 2), b as (select target, factory from links where ambiguous group by 1, 2), x as (select target, string_agg(a.factory, '|' order by a.factory) as only_first from a where not exists (select 1 from b where b.target = a.target and b.factory = a.factory) group by 1), y as (select target, string_agg(b.factory, '|' order by b.factory) as only_second from b where not exists (select 1 from a where b.target = a.target and b.factory = a.factory) group by 1) select coalesce(x.target, y.target) as target, coalesce(only_first, '') as only_first, coalesce(only_second, '') as only_second from x full join y on x.target = y.target", PSI)
def _(t):
    sets = lambda d: d.groupBy("target").agg(F.collect_set("factory").alias("factories"))
    out = m.set_mismatch(sets(links(t).where("not ambiguous")), sets(links(t).where("ambiguous")), "target", "factories")
    return out.select("target", F.array_join("only_first", "|").alias("only_first"), F.array_join("only_second", "|").alias("only_second"))


@query("l8_similarity")
def _(t):
    names = t.psi.select(x.fold_text(F.col("product_name_en")).alias("name")).distinct()
    return names.withColumn("similarity", F.round(m.similarity(F.col("name"), F.lit("red bolt 12 oz")), 6))


@query("l9_check_products", f""", {CHECKED}, told as (select target, r.factory, importer from (select distinct target, candidate from primary_pairs) p join r on r.sku_name = p.candidate union select target, r.factory, importer from (select distinct target, candidate, factory from fallback) f join r on r.sku_name = f.candidate and r.factory = f.factory),
  g as (select target, factory, count(distinct importer) as n from told group by 1, 2) select target, count(*) as factories, cast(sum(case when n > 1 then 1 else 0 end) as bigint) as parallel_factories, case when bool_or(n > 1) then 'O' else 'X' end as status from g group by 1""", PSI)
def _(t):
    return m.check_products(targets(t), records(t))


@query("d17_lookup_candidates", f", r as ({RECORDS}), terms as (select * from (values ('red'), ('VIRGIN'), ('#12 F'), ('brass')) as v(term)), x as (select distinct term, sku_name, factory, manufacturer from terms join r on contains(lower(sku_name), lower(term)) or contains(lower(factory), lower(term)) or contains(lower(manufacturer), lower(term))) select *, cast(row_number() over (partition by term order by sku_name, factory, manufacturer) as int) as n from x qualify n <= 20", PSI)
def _(t):
    return m.lookup_candidates(t.spark.sql("select * from values ('red'), ('VIRGIN'), ('#12 F'), ('brass') as v(term)"), records(t), 20)


def same_size(pairs):
    """Stands for a judge: the pair names the same size, no opinion where the record names none."""
    size = lambda name: name.rpartition(", ")[2] if ", " in name else None
    return [None if size(c) is None else size(a) == size(c) for a, c in pairs]


@query("o_judge_queue", f""", {CHECKED}, q as (select distinct target, candidate from checked where ambiguous),
  j as (select target, candidate, case when contains(candidate, ', ') then string_split(target, ', ')[-1] = string_split(candidate, ', ')[-1] end as accepted from q)
  select target, candidate, accepted is null as pending, 1 as asked from j where coalesce(accepted, true)""", PSI)
def _(t):
    """The queue is judged twice; the second time half of it is known and only the other half is asked."""
    pairs = staged(checked(t))
    queue = pairs.where("ambiguous").select("target", "candidate").distinct()
    none = t.spark.createDataFrame([], "target string, candidate string, accepted boolean, error string")
    some = staged(ext.judge_queue(queue.where(F.pmod(F.xxhash64("target", "candidate"), F.lit(2)) == 0), none, same_size))
    known = some.unionByName(ext.judge_queue(queue, some, same_size))
    kept = m.apply_decisions(pairs.where("ambiguous").select("target", "candidate", "ambiguous").distinct(), ext.decisions(known))
    asked = known.groupBy("target", "candidate").agg(F.count("*").cast("int").alias("asked"))
    return kept.join(asked, ["target", "candidate"]).select("target", "candidate", "pending", "asked")
