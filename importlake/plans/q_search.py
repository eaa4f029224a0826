"""Queries of hybrid search."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from importlake.operators import history as h
from importlake.operators import search as s
from importlake.operators import stats
from importlake.plans.q_history import HISTORY, K8, D, history_sql, same, sh
from importlake.plans.registry import query
from importlake.plans.views import AS_OF
from importlake.sources.staging import staged

IH, EMB = ("import_history",), ("product_embedding",)
INTENT = s.Intent("bolt", ["parts"], ["red", "blue"])
#: The query vector: that of the first embedding.
Q = "qv as (select embedding as q from embeddings where vec_id = 1)"
COS = "list_sum(list_transform(list_zip(embedding, q), lambda z: cast(z[1] as double) * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda v: cast(v as double) * v))) * sqrt(list_sum(list_transform(q, lambda v: cast(v as double) * v))))"
NEAR = f"{Q}, scored as (select vec_id, sku_name, mc, category, status, {COS} as semantic_score from product_embedding, qv)"
REL = "greatest(0.0, least(1.0, coalesce(semantic_score, 0.0) + case when mc = 'bolt' then 0.18 when mc <> '' then -0.10 else 0 end + case when category = 'parts' then 0.12 else -0.22 end + case when category = 'parts' and (sku_name like '%red%' or sku_name like '%blue%') then 0.08 else 0 end))"


def vector(t):
    """The query vector as a constant, as it would come from a request."""
    row = t.raw("embeddings").where("vec_id = 1").select("embedding").first()
    return F.array(*[F.lit(float(v)) for v in row[0]])


def with_rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("semantic_score", "relevance_score") if c in df.columns})


@query("i1_vector_topk", f", {NEAR} select vec_id, sku_name, round(semantic_score, 6) as semantic_score from scored where category = 'parts' order by scored.semantic_score desc, sku_name, vec_id limit 20", EMB)
def _(t):
    return with_rounded(s.vector_topk(t.emb, vector(t), 20, F.col("category") == "parts").select("vec_id", "sku_name", "semantic_score"))


@query("g7_nearest", f", {NEAR} select vec_id, round(semantic_score, 6) as semantic_score from scored order by scored.semantic_score desc, sku_name, vec_id limit 10", EMB)
def _(t):
    return with_rounded(s.vector_topk(t.emb, vector(t), 10).select("vec_id", "semantic_score"))


@query("i2_knn", f""", pairs as (select a.vec_id as query_id, b.vec_id as ref_id, a.embedding, b.embedding as q from embeddings a, embeddings b where a.vec_id % 100 = 0)
  select query_id, ref_id, round({COS}, 6) as score, cast(row_number() over (partition by query_id order by {COS} desc, ref_id) as int) as rank from pairs qualify rank <= 3""", EMB)
def _(t):
    emb = t.raw("embeddings")
    return s.knn(emb.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), emb, 3).withColumn("score", F.round("score", 6))


@query("i3_relevance", f", {NEAR} select vec_id, round({REL}, 6) as relevance_score from scored", EMB)
def _(t):
    scored = s.vector_scores(t.emb, vector(t))
    return with_rounded(s.relevance(scored, INTENT).select("vec_id", "relevance_score"))


@query("i4_threshold", f", {NEAR}, r as (select vec_id, {REL} as relevance_score from scored) select vec_id, case when vec_id % 3 = 0 then 'exact' else 'semantic' end as match_type from r where vec_id % 3 = 0 or relevance_score >= 0.4", EMB)
def _(t):
    rows = s.relevance(s.vector_scores(t.emb, vector(t)), INTENT)
    return s.threshold(rows.withColumn("match_type", F.expr("case when vec_id % 3 = 0 then 'exact' else 'semantic' end")), 0.4).select("vec_id", "match_type")


PRODUCTS = "products as (select sku_name, mc, category, count(*) as popularity from import_history where sku_name is not null group by 1, 2, 3)"
MATCHED = f"""{PRODUCTS}, {NEAR}, parts as (
    select sku_name, mc, category, 1 as place, cast(null as double) as semantic_score, cast(null as double) as relevance_score from products where sku_name ilike '%red%' or mc ilike '%red%' or category ilike '%red%'
    union all select * from (select sku_name, mc, category, 2, cast(null as double), cast(null as double) from products where lower(mc) = 'bolt' order by popularity desc, sku_name limit 3)
    union all select sku_name, mc, category, 3, semantic_score, relevance_score from (select *, {REL} as relevance_score from (select * from scored where status = 'completed' and category = 'parts' order by semantic_score desc, sku_name, vec_id limit 30)) where relevance_score >= 0.3),
  matched as (select sku_name, mc, category, case min(place) when 1 then 'exact' when 2 then 'popular' else 'semantic' end as match_type, max(semantic_score) as semantic_score, max(relevance_score) as relevance_score from parts group by 1, 2, 3)"""


def matched(t):
    """The products are read twice, and written before as they come from all records."""
    return s.matched_products(staged(stats.products(t.ih_hashed)), t.emb, ["red"], vector(t), INTENT, 30, 3, 0.3)


@query("h1_h2_matches", f", {MATCHED} select sku_name, mc, category, match_type, round(semantic_score, 6) as semantic_score, round(relevance_score, 6) as relevance_score from matched", ("import_history", "product_embedding"))
def _(t):
    return with_rounded(matched(t))


@query("h2_dedupe_matches", f""", m as (select category, mc, case sum_id % 3 when 0 then 'semantic' when 1 then 'popular' else 'exact' end as match_type, (sum_id % 10) / 10.0 as semantic_score, (sum_id % 7) / 10.0 as relevance_score, sku_name from (select *, length(sku_name) + length(coalesce(importer, '')) as sum_id from import_history))
  select sku_name, mc, category, case min(case match_type when 'exact' then 1 when 'popular' then 2 else 3 end) when 1 then 'exact' when 2 then 'popular' else 'semantic' end as match_type, max(semantic_score) as semantic_score, max(relevance_score) as relevance_score from m group by 1, 2, 3""", ("import_history",))
def _(t):
    n = F.length("sku_name") + F.length(F.coalesce("importer", F.lit("")))
    kind = F.when(n % 3 == 0, "semantic").when(n % 3 == 1, "popular").otherwise("exact")
    rows = t.ih.select(*s.MATCH_KEYS, kind.alias("match_type"), ((n % 10) / 10).alias("semantic_score"), ((n % 7) / 10).alias("relevance_score"))
    return s.dedupe_matches(rows)


ON = same("sh", "matched", s.MATCH_KEYS)
LOOK = ["red", "building-1"]  # the second term occurs among importers only
ALIASES = ["^building", "machinery"]
NULLS = ", ".join(f"{k} nulls first" for k in h.SKU_KEYS)
NKEY = "lower(trim(coalesce({}.{}, '')))"


def hybrid_sql(source: str) -> str:
    """The matches at the grain of SKU histories: ``hm``, from the histories ``source``."""
    some = " or ".join(f"coalesce({c} ilike '%{t}%', false)" for t in LOOK for c in s.LOOKED_IN)
    return f"""src as (select * from {source} where country in ('NATION_1', 'NATION_2') and (importer ilike 'building%' or importer ilike '%machinery%')),
  top as (select {K8}, true as popular from src where mc = 'bolt' order by import_count desc, latest_import desc nulls first, {NULLS} limit 7), {NEAR},
  near as (select {', '.join(NKEY.format('n', c) + ' as ' + c for c in s.MATCH_KEYS)}, max(semantic_score) as semantic_score, max(relevance_score) as relevance_score
    from (select *, {REL} as relevance_score from (select * from scored where status = 'completed' and category = 'parts' order by semantic_score desc, sku_name, vec_id limit 60)) n group by 1, 2, 3),
  hm as (select * from (select src.*, near.semantic_score, near.relevance_score, case when {some.replace('coalesce(', 'coalesce(src.')} then 'exact' when popular then 'popular' when near.semantic_score is not null then 'semantic' end as match_type
    from src left join top on {same('src', 'top', h.SKU_KEYS)} left join near on {' and '.join(NKEY.format('src', c) + ' = near.' + c for c in s.MATCH_KEYS)}) where match_type in ('exact', 'popular') or relevance_score >= 0.3)"""


HYBRID = [*h.SKU_KEYS, "import_count", "market_status", "match_type", "semantic_score", "relevance_score"]
HYBRID_SQL = ", ".join(["hm." + c for c in HYBRID[:-2]] + [f"round({c}, 6) as {c}" for c in HYBRID[-2:]])


def hybrid(t, history, status=None):
    return s.hybrid_search(staged(history), t.emb, LOOK, vector(t), INTENT, 60, 7, 0.3, {"country": ["NATION_1", "NATION_2"]}, ALIASES, status)


@query("i5_hybrid_search", f"{HISTORY}, {hybrid_sql('sh')} select {HYBRID_SQL} from hm where market_status = 'O'", ("import_history", "product_embedding"))
def _(t):
    return with_rounded(hybrid(t, sh(t), "O").select(*HYBRID))


@query("i5_hybrid_period", f", ph as (select *, cast(null as varchar) as market_status from ({history_sql(D + ' between date ' + repr('1998-03-01') + ' and date ' + repr('2000-02-29'))})), {hybrid_sql('ph')} select {HYBRID_SQL} from hm", ("import_history", "product_embedding"))
def _(t):
    return with_rounded(hybrid(t, h.sku_history_period(t.ih, datetime.date(1998, 3, 1), datetime.date(2000, 2, 29), AS_OF)).select(*HYBRID))


@query("i7_hybrid_total", f"{HISTORY}, {hybrid_sql('sh')} select match_type, count(*) as total from hm where market_status = 'O' group by 1", ("import_history", "product_embedding"))
def _(t):
    return hybrid(t, sh(t), "O").groupBy("match_type").agg(F.count("*").alias("total"))


@query("i6_exact_search", f"{HISTORY} select {K8}, import_count from sh where import_type in ('OEM') and ({' or '.join(f'{c} ilike ' + repr('%red%') for c in h.SEARCHED)})", IH)
def _(t):
    return s.exact_search(sh(t), ["red"], {"import_type": ["OEM"]}).select(*h.SKU_KEYS, "import_count")


@query("i7_match_total", f"{HISTORY}, {MATCHED}, g as (select distinct {', '.join(h.MARKET_KEYS)} from sh) select count(*) as total from g join matched on {same('g', 'matched', s.MATCH_KEYS)}", ("import_history", "product_embedding"))
def _(t):
    """Of the records, which have the groups of their histories; so rows are joined without the importer."""
    return s.match_total(t.ih_hashed, staged(matched(t)))


@query("i9_search_metrics", f", {MATCHED} select cast(sum(case when match_type = 'exact' then 1 else 0 end) as bigint) as exact_count, cast(sum(case when match_type = 'popular' then 1 else 0 end) as bigint) as popular_count, cast(sum(case when match_type = 'semantic' then 1 else 0 end) as bigint) as semantic_count, round(min(semantic_score), 6) as least_semantic, round(min(relevance_score), 6) as least_relevance from matched", ("import_history", "product_embedding"))
def _(t):
    return s.search_metrics(matched(t)).withColumns({c: F.round(c, 6) for c in ("least_semantic", "least_relevance")})


@query("e18_search_summary", f"""{HISTORY} select manufacturer, sku_name, cast(sum(import_count) as bigint) as import_count, count(distinct factory) as factories, count(distinct importer) as importers,
  first(country order by import_count desc, coalesce(latest_import, date '0001-01-01') desc, coalesce(factory, '') desc, coalesce(importer, '') desc) as country from sh where market_status = 'O' and mc = 'bolt' group by 1, 2 order by 3 desc, 1, 2 limit 7""", IH)
def _(t):
    return s.search_summary(sh(t).where("mc = 'bolt'"), 7)


@query("g8_popular", f", {PRODUCTS} select sku_name, mc, category, popularity from products where mc = 'gear' order by popularity desc, sku_name limit 5", IH)
def _(t):
    return s.popular(stats.products(t.ih), "gear", 5)


@query("e27_infer_mc", f", p as (select sku_name, mc from product_embedding) select mc, count(*) as products from p where sku_name like '%red%' or sku_name like '%gear%' or mc in ('red', 'gear') group by mc order by mc in ('red', 'gear') desc, 2 desc, mc limit 1", EMB)
def _(t):
    return s.infer_mc(t.emb, ["red", "gear"])


SYNONYMS = "select * from (values (1, 'red'), (1, 'crimson'), (2, 'bolt'), (2, 'screw')) as s(group_id, term)"


@query("b39_expand_terms", f", s as ({SYNONYMS}), q as (select distinct sku_name as query from import_history) select query, query as term from q union select query, b.term from q join s a on contains(query, a.term) join s b on a.group_id = b.group_id where b.term <> query", IH)
def _(t):
    return s.expand_terms(t.ih.select(F.col("sku_name").alias("query")), t.spark.sql(SYNONYMS))


@query("b40_detect_intent", ", q as (select distinct sku_name as query from import_history) select query, case when contains(query, 'bolt') then 'bolt' when contains(query, 'red') then 'red goods' end as mc, case when contains(query, 'bolt') and contains(query, 'red') then 'parts|goods' when contains(query, 'bolt') then 'parts' when contains(query, 'red') then 'goods|parts' end as categories from q", IH)
def _(t):
    rules = t.spark.sql("select * from values (1, array('bolt'), 'bolt', array('parts'), array('bolt')), (2, array('red', 'crimson'), 'red goods', array('goods', 'parts'), array('red')) as r(rule_no, triggers, mc, categories, keywords)")
    return s.detect_intent(t.ih.select(F.col("sku_name").alias("query")), rules).select("query", "mc", F.array_join("categories", "|").alias("categories"))


@query("i8_semantic_text", """, q as (select distinct sku_name as query, case when sku_name like '%bolt%' then 'bolt' end as mc, case when sku_name like '%red%' then category end as category from import_history)
  select query, case when mc is null and category is null then query else query || ' red' || case when query = 'steel' then '' else ' steel' end || ' | ' || coalesce(mc, '') || ' | ' || coalesce(category, '') end as semantic_text from q""", IH)
def _(t):
    mc, categories = F.when(F.contains("sku_name", F.lit("bolt")), "bolt"), F.when(F.contains("sku_name", F.lit("red")), F.array("category"))
    asked = t.ih.select(F.col("sku_name").alias("query"), mc.alias("mc"), categories.alias("categories"), F.array(F.lit("red"), F.lit("steel"), F.lit("red"), F.col("sku_name")).alias("keywords"))
    return s.semantic_text(asked.distinct()).select("query", "semantic_text")
