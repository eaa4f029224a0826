"""Hybrid search: substring, vector and popularity matches, merged, scored by intent and cut at a threshold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators import history as h
from importlake.operators.containing import containing

# What raises and lowers relevance.
WEIGHTS = {"mc": 0.18, "category": 0.12, "keyword": 0.08, "mc_mismatch": 0.10, "category_mismatch": 0.22}
MATCH_ORDER = ["exact", "popular", "semantic"]
MATCH_KEYS = ["sku_name", "mc", "category"]
#: The columns of a SKU history in which a hybrid search looks for its terms.
LOOKED_IN = ["sku_name", "factory", "manufacturer", "importer", "country", "mc"]


@dataclass
class Intent:
    mc: str | None = None
    categories: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)


def expand_terms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query, term): each query's own key, then the other terms of the synonym groups of which it contains one. ``synonyms``: (group_id, term)."""
    q = queries.select("query", x.norm_key(F.col("query")).alias("q")).where("q <> ''").distinct()
    s = synonyms.select("group_id", x.norm_key(F.col("term")).alias("term")).distinct()
    met = containing(s, "term", q, "q").join(s, "term").join(q, "q").select("query", "q", "group_id").distinct()
    more = met.join(s, "group_id").where("term <> q").select("query", "term")
    return q.select("query", F.col("q").alias("term")).unionByName(more).distinct()


def detect_intent(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """(query, mc, categories, keywords) by the rules of which a trigger is contained in the query.

    ``rules``: (rule_no, triggers, mc, categories, keywords). The MC is that of the first rule that has one; lists are joined in the order of the rules.
    """
    q = queries.select("query", x.norm_key(F.col("query")).alias("q")).distinct()
    each = rules.select("rule_no", F.explode("triggers").alias("trigger"))
    fired = containing(each, "trigger", q, "q").join(each, "trigger").select("q", "rule_no").distinct()
    hit = q.join(fired, "q").join(rules, "rule_no")
    in_order = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", c))), lambda r: r[c])))
    found = hit.groupBy("query").agg(F.min_by("mc", F.when(F.col("mc").isNotNull(), F.col("rule_no"))).alias("mc"), in_order("categories").alias("categories"), in_order("keywords").alias("keywords"))
    return q.select("query").join(found, "query", "left")


def infer_mc(products: DataFrame, terms: Iterable[str]) -> DataFrame:
    """The MC that most products matching a term have; one named exactly like a term first. One row, or none."""
    keys = [t.lower() for t in terms]
    named = x.vector_key(F.col("mc")).isin(*keys)
    some = F.lit(False)
    for t in keys:
        some = some | F.contains(F.lower("sku_name"), F.lit(t))
    found = products.where(F.col("mc").isNotNull() & (some | named)).groupBy("mc").agg(F.count("*").alias("products"))
    return found.orderBy(named.desc(), F.desc("products"), "mc").limit(1)


def semantic_text(queries: DataFrame) -> DataFrame:
    """The text to embed for a query: where its intent names an MC or a category, the query with the intent's keywords, MC and first category, in the shape of a product's text.

    A keyword that is the query itself or repeats isn't added again; what the intent lacks is empty. Without either, and with null lists, the query stays as it is.
    """
    none = F.expr("cast(array() as array<string>)")
    words = F.array_join(F.array_distinct(F.concat(F.array("query"), F.coalesce("keywords", none))), " ") if "keywords" in queries.columns else F.col("query")
    mc, category = F.coalesce("mc", F.lit("")), F.coalesce(F.get("categories", F.lit(0)), F.lit(""))
    return queries.withColumn("semantic_text", F.when((mc != "") | (category != ""), F.concat_ws(" | ", words, mc, category)).otherwise(F.col("query")))


def vector_scores(emb: DataFrame, vector: Column) -> DataFrame:
    return emb.withColumn("semantic_score", x.cosine(F.col("embedding"), vector)).where("semantic_score is not null")


def vector_topk(emb: DataFrame, vector: Column, k: int, gate: Column | None = None) -> DataFrame:
    """The ``k`` products nearest to a vector by cosine, of those that pass ``gate``, with ``semantic_score``; ties by name and id."""
    rows = emb if gate is None else emb.where(gate)
    return vector_scores(rows, vector).orderBy(F.desc("semantic_score"), "sku_name", "vec_id").limit(k)


#: Vectors of a block of queries and of a block of references; references looked at beforehand, and how many of them are pivots.
ASKED, KNOWN, LOOKED_AT, PIVOTS = 256, 4096, 2048, 64
#: Angles are compared with this tolerance, well above what rounding makes of them.
ANGLE_SLACK = 1e-6


def _usable(rows: DataFrame, ids: str) -> DataFrame:
    """(i, v) of the vectors that aren't null or zero and hold no null or non-finite number."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    return rows.select(F.col(ids).cast("long").alias("i"), v.alias("v")).where(F.forall("v", finite) & F.exists("v", lambda e: e != 0))


def _unit(vectors: Iterable) -> np.ndarray:
    v = np.stack(list(vectors))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _pivots(known: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the vectors, each as far as can be from those chosen before."""
    chosen, far = [0], _angles(known, known[:1])[:, 0]
    while len(chosen) < min(n, len(known)) and far.max() > ANGLE_SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _angles(known, known[chosen[-1:]])[:, 0])
    return known[chosen]


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, i, v): unit vectors with the number of their nearest pivot, those of a cell together; a cell of many rows spans partitions."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = _unit(b["v"])
                yield pd.DataFrame({"cell": _angles(v, pivots).argmin(1).astype(np.int32), "i": b["i"], "v": list(v)})

    return rows.mapInPandas(assign, "cell int, i long, v array<double>").repartitionByRange("cell", "i").sortWithinPartitions("cell", "i")


def _runs(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Pieces of up to ``size`` rows of one cell."""
    for b in batches:
        for _, rows in b.groupby("cell", sort=False):
            for at in range(0, len(rows), size):
                yield rows.iloc[at : at + size]


def knn_blocks(queries: DataFrame, references: DataFrame, k: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame, Column] | None:
    """Blocks of queries, blocks of references, and the test of which of them must meet; None without any reference.

    Up to ``LOOKED_AT`` references, the first by a hash of their ids, give each query a bound: its ``k`` nearest are no farther than its ``k``-th nearest
    among these. A reference's angle to its pivot and the query's to that pivot differ by no more than the angle between the two, so a block whose
    angles are all too far from the queries' is left out, and no nearest reference is lost.
    """
    known = _usable(references, "vec_id")
    seen = known.orderBy(F.xxhash64("i"), "i").limit(LOOKED_AT).collect()
    if not seen:
        return None
    sizes = [len(r.v) for r in seen]
    d = max(set(sizes), key=lambda n: (sizes.count(n), n))
    sample = _unit(r.v for r in seen if len(r.v) == d)
    centres = _pivots(sample, pivots)

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _runs(batches, ASKED):
            v = np.stack(b["v"].to_list())
            to, near = _angles(v, centres), _angles(v, sample)
            far = float(np.partition(near, k - 1, axis=1)[:, k - 1].max()) if len(sample) >= k else np.pi
            yield pd.DataFrame({"q_ids": [b["i"].to_numpy(np.int64).tobytes()], "q_v": [v.tobytes()], "q_low": [to.min(0)], "q_high": [to.max(0)], "q_far": [far]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _runs(batches, KNOWN):
            v, cell = np.stack(b["v"].to_list()), int(b["cell"].iloc[0])
            to = _angles(v, centres[cell : cell + 1])
            yield pd.DataFrame({"r_ids": [b["i"].to_numpy(np.int64).tobytes()], "r_v": [v.tobytes()], "cell": [cell], "r_low": [float(to.min())], "r_high": [float(to.max())]})

    alike = F.size("v") == d
    q = _cells(_usable(queries, "query_id").where(alike), centres).mapInPandas(asked, "q_ids binary, q_v binary, q_low array<double>, q_high array<double>, q_far double")
    r = _cells(known.where(alike), centres).mapInPandas(packed, "r_ids binary, r_v binary, cell int, r_low double, r_high double")
    apart = F.greatest(F.get("q_low", F.col("cell")) - F.col("r_high"), F.col("r_low") - F.get("q_high", F.col("cell")))
    return q, r, apart <= F.col("q_far") + ANGLE_SLACK


def knn(queries: DataFrame, references: DataFrame, k: int, pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` references nearest to each query by cosine: (query_id, ref_id, score, rank), ties to the smaller id. Exact.

    Blocks of queries meet those blocks of references that can hold one of their nearest, by angles to pivots, in one product of matrices, which sends
    on ``k`` rows for each query; a window limit cuts those to the best. Vectors of another length than most of the references looked at beforehand
    have, and null, zero or non-finite ones, take no part. Neither side is broadcast by force.
    """

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q_ids, q_v, r_ids, r_v in zip(b["q_ids"], b["q_v"], b["r_ids"], b["r_v"]):
                qi, ri = np.frombuffer(q_ids, np.int64), np.frombuffer(r_ids, np.int64)
                order = np.argsort(ri, kind="stable")
                scores = np.frombuffer(q_v).reshape(len(qi), -1) @ np.frombuffer(r_v).reshape(len(ri), -1)[order].T
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(qi, top.shape[1]), "ref_id": ri[order][top].ravel(), "score": np.take_along_axis(scores, top, 1).ravel()})

    kind = "query_id long, ref_id long, score double"
    blocks = knn_blocks(queries, references, k, pivots)
    if blocks is None:
        return queries.sparkSession.createDataFrame([], kind + ", rank int")
    q, r, meet = blocks
    met = q.join(r, meet).select("q_ids", "q_v", "r_ids", "r_v")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ref_id"))
    return met.mapInPandas(near, kind).withColumn("rank", rank).where(F.col("rank") <= k)


def relevance(df: DataFrame, intent: Intent, weights: dict[str, float] | None = None) -> DataFrame:
    """Add ``relevance_score``: the semantic score with what agrees and disagrees with the intent, between 0 and 1.

    A keyword counts only where the category doesn't disagree; an empty MC or category neither agrees nor disagrees.
    """
    w = WEIGHTS | (weights or {})
    mc, category, name = x.norm_key(F.col("mc")), x.norm_key(F.col("category")), x.norm_key(F.col("sku_name"))
    total = F.coalesce("semantic_score", F.lit(0.0))
    if intent.mc:
        total = total + F.when(mc == intent.mc.lower(), w["mc"]).when(mc != "", -w["mc_mismatch"]).otherwise(0.0)
    wrong = F.lit(False)
    if intent.categories:
        right = category.isin(*[c.lower() for c in intent.categories])
        wrong = ~right & (category != "")
        total = total + F.when(right, w["category"]).when(wrong, -w["category_mismatch"]).otherwise(0.0)
    if intent.keywords:
        some = F.lit(False)
        for t in intent.keywords:
            some = some | F.contains(name, F.lit(t.lower()))
        total = total + F.when(some & ~wrong, w["keyword"]).otherwise(0.0)
    return df.withColumn("relevance_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def threshold(df: DataFrame, least: float) -> DataFrame:
    """Exact and popular matches stay; a semantic one needs a relevance of ``least``."""
    return df.where((F.col("match_type") != "semantic") | (F.col("relevance_score") >= least))


def union_matches(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedupe_matches(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each key: the first match type in order and the largest scores."""
    place = F.array_position(F.array(*map(F.lit, MATCH_ORDER)), F.col("match_type"))
    return df.groupBy(*(keys or MATCH_KEYS)).agg(
        F.element_at(F.array(*map(F.lit, MATCH_ORDER)), F.min(place).cast("int")).alias("match_type"), F.max("semantic_score").alias("semantic_score"), F.max("relevance_score").alias("relevance_score")
    )


def popular(products: DataFrame, mc: str, n: int) -> DataFrame:
    return products.where(F.lower("mc") == mc.lower()).orderBy(F.desc("popularity"), "sku_name").limit(n)


def exact_search(history: DataFrame, terms: list[str], filters: dict[str, list] | None = None) -> DataFrame:
    return h.sort_rows(h.in_lists(h.search(history, terms), filters or {}))


def matched_products(products: DataFrame, emb: DataFrame, terms: list[str], vector: Column, intent: Intent, k: int, n_popular: int, least: float, gate: bool = True) -> DataFrame:
    """The distinct products that match a query in any way, with how and how well."""
    exact = h.search(products, terms, ["sku_name", "mc", "category"]).select(*MATCH_KEYS, F.lit("exact").alias("match_type"))
    parts = [exact]
    if intent.mc:
        parts.append(popular(products, intent.mc, n_popular).select(*MATCH_KEYS, F.lit("popular").alias("match_type")))
    only = F.lower("category").isin(*[c.lower() for c in intent.categories]) if gate and intent.categories else None
    near = relevance(vector_topk(emb.where("status = 'completed'"), vector, k, only), intent)
    parts.append(near.select(*MATCH_KEYS, F.lit("semantic").alias("match_type"), "semantic_score", "relevance_score"))
    return dedupe_matches(threshold(union_matches(*[p if "semantic_score" in p.columns else p.withColumns({c: F.lit(None).cast("double") for c in ("semantic_score", "relevance_score")}) for p in parts]), least))


def searched_rows(history: DataFrame, filters: dict[str, list] | None = None, aliases: Iterable[str] | None = None) -> DataFrame:
    """The SKU histories that a search is about: those in all lists of ``filters``, and of an importer in the group of ``aliases``."""
    rows = h.in_lists(history, filters or {})
    return rows if aliases is None else rows.where(h.in_group(F.col("importer"), aliases))


def hybrid_matches(rows: DataFrame, emb: DataFrame, terms: list[str], vector: Column, intent: Intent, k: int, n_popular: int, least: float, gate: bool = True) -> DataFrame:
    """The SKU histories that match in any way, each once, with ``match_type`` (the first in order) and scores.

    Exact: a term occurs in any of six columns. Popular: the ``n_popular`` rows of the intent's MC with most imports. Semantic: rows of the ``k``
    nearest products, by normalized keys, of which the largest relevance counts. The rows are marked where they stand: only the popular ones and
    the products, at most ``n_popular`` and ``k``, are joined to them, and no row is grouped or joined with its own kind. Without terms nothing is exact.
    """
    only = F.lower("category").isin(*[c.lower() for c in intent.categories]) if gate and intent.categories else None
    near = relevance(vector_topk(emb.where("status = 'completed'"), vector, k, only), intent)
    products = near.groupBy(*[x.vector_key(F.col(c)).alias(f"__{c}") for c in MATCH_KEYS]).agg(F.max("semantic_score").alias("semantic_score"), F.max("relevance_score").alias("relevance_score"))
    kind = F.when(h.contains_any(terms, LOOKED_IN), "exact")
    marked = rows.join(products, [x.vector_key(rows[c]) == products[f"__{c}"] for c in MATCH_KEYS], "left").drop(*products.columns[: len(MATCH_KEYS)])
    if intent.mc:
        top = h.sort_rows(rows.where(x.vector_key(F.col("mc")) == intent.mc.lower())).limit(n_popular)
        marked = h.null_safe_join(marked, top.select(*h.SKU_KEYS, F.lit(True).alias("__popular")), h.SKU_KEYS)
        kind = kind.when(F.col("__popular"), "popular")
    marked = marked.withColumn("match_type", kind.when(F.col("semantic_score").isNotNull(), "semantic")).drop("__popular")
    return threshold(marked.where("match_type is not null"), least)


def hybrid_search(
    history: DataFrame, emb: DataFrame, terms: list[str], vector: Column, intent: Intent, k: int = 50, n_popular: int = 20, least: float = 0.86,
    filters: dict[str, list] | None = None, aliases: Iterable[str] | None = None, status: str | None = None,
) -> DataFrame:
    """Matches among the SKU histories that pass the filters, in the order of import counts. Take a page with ``history.page``.

    Popularity is taken after the filters, market status is asked of what has matched. For a period pass ``history.sku_history_period``. A history
    that is computed by the plan is better written before, as its popular rows are found by a second scan.
    """
    rows = hybrid_matches(searched_rows(history, filters, aliases), emb, terms, vector, intent, k, n_popular, least)
    return h.sort_rows(rows if status is None else rows.where(F.col("market_status") == status))


def match_total(history: DataFrame, matched: DataFrame) -> DataFrame:
    """The number of matched groups, from the smaller grain of a market group.

    ``history`` may be the records instead. Rows of other products go before the rest is grouped. ``matched`` is read twice; where the plan computes it, it is better written before.
    """
    keys = matched.select(*MATCH_KEYS)
    grain = h.null_safe_join(history, keys, MATCH_KEYS, "left_semi").select(*h.MARKET_KEYS).distinct()
    return h.null_safe_join(grain, keys, MATCH_KEYS, "inner").agg(F.count("*").alias("total"))


def search_metrics(matched: DataFrame) -> DataFrame:
    return matched.agg(*[F.count_if(F.col("match_type") == m).alias(f"{m}_count") for m in MATCH_ORDER], F.min("semantic_score").alias("least_semantic"), F.min("relevance_score").alias("least_relevance"))


def search_summary(matches: DataFrame, n: int = 5, status: str = "O") -> DataFrame:
    """Matches by manufacturer and SKU: sums, distinct factories, the largest row's country; those of a market status, the ``n`` largest."""
    rows = matches.where(F.col("market_status") == status)
    big = F.struct("import_count", F.coalesce("latest_import", F.lit("0001-01-01").cast("date")), F.coalesce("factory", F.lit("")), F.coalesce("importer", F.lit("")))
    out = rows.groupBy("manufacturer", "sku_name").agg(F.sum("import_count").alias("import_count"), F.count_distinct("factory").alias("factories"), F.count_distinct("importer").alias("importers"), F.max_by("country", big).alias("country"))
    return out.orderBy(F.desc("import_count"), F.asc_nulls_first("manufacturer"), "sku_name").limit(n)
