"""Retail rankings: listings, groups, coverage, snapshots and recommendations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from importlake.functions import text as x

RETAILER_ORDER = ["amazon", "walmart", "samsclub", "aeon"]
UNRANKED_RETAILER = "aeon"
UNRANKED = 999
# Words that mark a product as not for the list. Latin ones are looked for in lower case, Korean ones as they are.
NOT_FOOD = [
    "toilet roll", "toilet tissue", "toilet paper", "bath tissue", "lint roller", "carpet cleaning tape", "fabric softener", "petroleum jelly", "vaseline",
    "highlighter", "rollerball pen", "paint marker", "gel pen", "embroidery needle", "twist comb", "(paperback)", "gummy mold", "gummy bear mold",
    "composition book", "butcher's twine", "butchers twine", "fishing rod", "reel combo", "gift card", "gift basket", "teether", "sauce dish",
    "divided sauce plate", "watering pot", "scented spray", "shower gel",
]
NOT_FOOD_KOREAN = [
    "화장지", "린트롤러", "카펫클리닝테이프", "섬유유연제", "바세린", "형광펜", "롤러볼", "페인트마카", "자수바늘", "트위스트빗", "젤리몰드", "정육용끈",
    "낚싯대", "릴콤보", "상품권", "기프트카드", "기프트바스켓", "치아발육기", "소스접시", "워터링팟", "향수", "샤워젤",
]
PET_FOOD = ["sheba", "fancy feast", "temptations", "smart heart", "waggin' train", "waggin train", "spot farms", "delizios", "prodiet"]
BABY_FOOD = ["cerelac", "wakodo", "babyfood", "baby food"]
BABY_FOOD_KOREAN = ["이유식", "유아식", "니코니코", "하타케노미카타"]
# How retailers and their sites are shown.
RETAILER_LABELS = {"amazon": "아마존", "walmart": "월마트", "samsclub": "샘스클럽", "aeon": "이온몰"}
SITE_SUFFIXES = {"aeon-jp": " (일본)", "aeon-my": " (말레이시아)"}
NO_FLAG = "🏳️"


def retailer_country(c: Column, aeon: str = "JP", others: str = "US") -> Column:
    return F.when(c.startswith("aeon"), F.when(c == "aeon-my", "MY").otherwise(aeon)).when(c.isNotNull(), others)


def site_label(retailer: Column, site: Column) -> Column:
    """A retailer's label, an unknown one as it is, with the country of its site where it has several."""
    known = F.create_map(*[F.lit(v) for kv in RETAILER_LABELS.items() for v in kv])
    suffix = F.create_map(*[F.lit(v) for kv in SITE_SUFFIXES.items() for v in kv])
    return F.concat(F.coalesce(known[retailer], retailer), F.coalesce(suffix[site], F.lit("")))


def flag(code: Column) -> Column:
    """The flag of a two-letter country code: each letter's regional indicator; for anything else a white flag."""
    letters = [chr(ord("A") + k) for k in range(26)]
    signs = F.create_map(*[F.lit(v) for k, c in enumerate(letters) for v in (c, chr(0x1F1E6 + k))])
    return F.when(code.rlike("^[A-Za-z]{2}$"), F.concat(signs[F.upper(F.substring(code, 1, 1))], signs[F.upper(F.substring(code, 2, 1))])).otherwise(F.lit(NO_FLAG))


def with_country_names(df: DataFrame, names: DataFrame, code: str = "code") -> DataFrame:
    """Add ``country_name`` and ``flag`` to codes. ``names``: (code, name), of repeated codes the smallest name; an unknown code has no name."""
    known = names.groupBy(F.upper("code").alias("__code")).agg(F.min("name").alias("country_name"))
    return df.join(known, F.upper(code) == F.col("__code"), "left").drop("__code").withColumn("flag", F.when(F.col("country_name").isNotNull(), flag(F.col(code))).otherwise(F.lit(NO_FLAG)))


def retailer_order(c: Column, order: list[str] | None = None) -> Column:
    out = F
    for k, r in enumerate(order or RETAILER_ORDER):
        out = out.when(c == r, k)
    return out.otherwise(99)


def first_ids(psi: DataFrame) -> DataFrame:
    """The smallest id of a row's type, of its brand within it, and of its product within that."""
    low = lambda *k: F.min("id").over(Window.partitionBy(*k))
    return psi.withColumns({
        "type_min_id": low("product_type"),
        "brand_min_id": low("product_type", "brand_group_key"),
        "product_min_id": low("product_type", "brand_group_key", "product_group_key"),
    })


def type_priority(psi: DataFrame) -> DataFrame:
    """The place of each type by its first id. Types are few; they are ranked among each other and joined back."""
    types = psi.groupBy("product_type").agg(F.min("id").alias("type_min_id"))
    ranked = types.withColumn("type_priority", F.dense_rank().over(Window.orderBy("type_min_id")))
    return psi.join(ranked.select("product_type", "type_priority"), "product_type")


RISKS = ["recall_status", "quality_label_status", "legal_risk_status"]


def product_order(psi: DataFrame, word: str = "통과", none: str = "수입이력 없음", order: list[str] | None = None) -> DataFrame:
    """Rows with their eight sort keys, in order: types as first seen, grouped rows first, brands and products as first seen,
    then, for rows without group, risks passed and parallel status; then the retailer and its rank."""
    lone = F.col("brand_group_key").isNull()
    status = F.trim("parallel_import")
    keyed = first_ids(psi).withColumns({
        "grouped_rank": F.when(lone, 1).otherwise(0),
        "risk_key": F.when(lone, -x.risk_pass([F.col(c) for c in RISKS], word)).otherwise(0),
        "parallel_key": F.when(lone, F.when(status == "O", 0).when(status == none, 1).when(status == "X", 2).otherwise(3)).otherwise(0),
        "retailer_key": retailer_order(F.col("retailer"), order),
    })
    return keyed.orderBy("type_min_id", "grouped_rank", "brand_min_id", "product_min_id", "risk_key", "parallel_key", "retailer_key", "rank", "id")


def group_flags(df: DataFrame, keys: list[str], by: str, order: list[str]) -> DataFrame:
    """Within each ``by``: whether a row begins a new group of the keys, and the number of its group so far."""
    w = Window.partitionBy(by).orderBy(*order)
    now, before = F.struct(*keys), F.lag(F.struct(*keys)).over(w)
    flagged = df.withColumn("starts_group", F.when(F.row_number().over(w) == 1, True).otherwise(~now.eqNullSafe(before)))
    return flagged.withColumn("group_index", F.sum(F.col("starts_group").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def retailer_groups(psi: DataFrame) -> DataFrame:
    """A row for each type and retailer, in the retailers' order, with its products by rank."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "product_name_en"))), lambda r: F.struct(r["rank"].alias("rank"), r["product_name_en"].alias("name")))
    grouped = psi.groupBy("product_type", "retailer").agg(F.count("*").alias("items"), rows.alias("products"))
    return grouped.withColumn("retailer_key", retailer_order(F.col("retailer"))).orderBy("product_type", "retailer_key", "retailer")


def coverage(psi: DataFrame, keys: list[str]) -> DataFrame:
    """The retailers that carry each group."""
    return psi.where(F.col("product_group_key").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set("retailer")).alias("retailers")).withColumn("coverage", F.size("retailers"))


def representative(psi: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each group with the best rank; a retailer without ranks comes last."""
    place = F.struct(F.when(F.col("retailer") == UNRANKED_RETAILER, UNRANKED).otherwise(F.col("rank")), "id")
    best = psi.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in psi.columns if c not in keys]), place).alias("best"))
    return best.select(*keys, "best.*")


def ineligible(name: Column, brand: Column | None = None, brand_korean: Column | None = None, words: list[str] | None = None, korean: list[str] | None = None) -> Column:
    """True for what no list of foods can hold: a word for other goods, pet or baby food occurs in the brand or name. The Korean words are looked for in the Korean brand and the name."""
    words = [*NOT_FOOD, *PET_FOOD, *BABY_FOOD] if words is None else words
    korean = [*NOT_FOOD_KOREAN, *BABY_FOOD_KOREAN] if korean is None else korean
    text = lambda b: F.concat_ws(" ", *[c for c in (b, name) if c is not None])
    some = lambda t, ws: t.rlike("|".join(re.escape(w) for w in ws)) if ws else F.lit(False)
    return some(F.lower(text(brand)), words) | some(text(brand_korean), korean)


def exclude_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    return df.join(pairs, ["product_type", "product_group_key"], "left_anti")


def recommendations(psi: DataFrame, excluded: DataFrame, word: str = "통과", none: str = "수입이력 없음") -> DataFrame:
    """Groups worth importing, by type: all risks passed, a parallel score, carried by a retailer; widest coverage first."""
    rows = psi.where(F.col("product_group_key").isNotNull() & ~ineligible(F.col("product_name_en"), *[F.col(c) if c in psi.columns else None for c in ("brand_en", "brand_kr")]))
    keys = ["product_type", "product_group_key"]
    best = representative(exclude_pairs(rows, excluded), keys).join(coverage(rows, keys), keys)
    scored = best.withColumns({"parallel_points": x.parallel_score(F.col("parallel_import"), none=none), "passes": x.risk_pass([F.col(c) for c in RISKS], word)})
    kept = scored.where((F.col("passes") == 3) & (F.col("parallel_points") >= 1) & (F.col("coverage") >= 1))
    return kept.orderBy("product_type", F.desc("coverage"), F.desc("parallel_points"), "product_group_key")


def snapshot_to_row(snapshot: DataFrame) -> DataFrame:
    """A crawl snapshot's rows in the shape of product rows, with nulls for what it lacks."""
    return snapshot.select(
        F.col("product_type"), F.col("retailer"), F.col("rank"), F.coalesce("brand", F.lit("")).alias("brand_en"), F.col("title").alias("product_name_en"),
        F.col("price_usd"), x.extract_unit(F.col("title")).alias("unit"), F.lit(None).cast("string").alias("parallel_import"), F.lit(None).cast("string").alias("recall_status"),
        F.lit(None).cast("string").alias("quality_label_status"), F.lit(None).cast("string").alias("legal_risk_status"),
    )


def in_range(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Rows with a value in the range; a null is in none."""
    test = F.col(column).isNotNull()
    if low is not None:
        test = test & (F.col(column) >= low)
    if high is not None:
        test = test & (F.col(column) <= high)
    return df.where(test)


def risk_all(df: DataFrame, columns: list[str], word: str = "통과") -> DataFrame:
    for c in columns:
        df = df.where(F.trim(c) == word)
    return df


def arrays_any(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(F.arrays_overlap(column, F.array(*map(F.lit, values)))) if values else df


def product_filter(df: DataFrame, text: str | None = None, lists: dict[str, list] | None = None, price: tuple | None = None, risks: list[str] | None = None, word: str = "통과") -> DataFrame:
    """A text over four fields, value lists, a price range and risk flags, all of which must hold."""
    if text:
        fields = ["product_name_en", "brand_en", "product_type", "retailer"]
        df = df.where(F.contains(F.lower(F.concat_ws("\n", *fields)), F.lit(text.lower())))
    for c, v in (lists or {}).items():
        df = df.where(F.col(c).isin(*v)) if v else df
    if price:
        df = in_range(df, "price_usd", *price)
    return risk_all(df, risks or [], word)


def relevant_title(df: DataFrame, column: str, excluded: list[str]) -> DataFrame:
    """Titles without excluded words and price texts that are letters for the most part."""
    t = F.col(column)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(F.length(t), F.lit(1))
    word = "(?i)\\b(" + "|".join(excluded) + ")\\b" if excluded else "$^"
    return df.where(t.isNotNull() & ~t.rlike(word) & ~t.rlike(r"^\s*[$¥₩]\s*[\d,.]+\s*$") & (letters >= 0.5))


def confidence_gate(df: DataFrame, column: str = "confidence") -> tuple[DataFrame, DataFrame]:
    """The rows of high or medium confidence, and the number of those and of the others."""
    sure = F.coalesce(F.col(column).isin("high", "medium"), F.lit(False))
    return df.where(sure), df.agg(F.count_if(sure).alias("applied"), F.count_if(~sure).alias("held_back"))


def seed_filter(df: DataFrame, column: str = "status") -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit("needs_manual_review")))


def vote(df: DataFrame, key: str, column: str, priority: list[str]) -> DataFrame:
    """The most frequent value of each key; of tied values the one first in ``priority``, the conservative order. Nulls have no vote."""
    counts = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(column))
    ordered = F.struct((-F.col("n")), F.when(place > 0, place).otherwise(len(priority) + 1), column)
    return counts.groupBy(key).agg(F.min_by(column, ordered).alias(column))


def merge_notes(df: DataFrame, key: str, note: str, order: str) -> DataFrame:
    """The distinct notes of each key in the order first seen."""
    first = df.where(F.trim(note) != "").groupBy(key, F.trim(note).alias("note")).agg(F.min(order).alias("at"))
    notes = F.array_sort(F.collect_list(F.struct("at", "note")))
    return first.groupBy(key).agg(F.array_join(F.transform(notes, lambda n: n["note"]), " / ").alias("notes"))


def dedupe_prefer(df: DataFrame, keys: list[str], preferred: str, order: list) -> DataFrame:
    """One row for each key: one with a value in ``preferred`` if there is any, then the first in order."""
    w = Window.partitionBy(*keys).orderBy(F.col(preferred).isNotNull().desc(), *order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def samples(df: DataFrame, key: str, column: str, order: str, n: int) -> DataFrame:
    """The first ``n`` distinct values of each key, in order."""
    first = df.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.min(order).alias("at"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("at", column))).where(F.col("k") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", column))), lambda v: v[column])
    return ranked.groupBy(key).agg(listed.alias("samples"))


def dedupe_titles(df: DataFrame, title: str, order: list, limit: int | None = None) -> DataFrame:
    """The first row of each base title; of those the first ``limit``."""
    out = first_per_key(df.withColumn("base_title", x.base_title(F.col(title))), ["base_title"], order).orderBy(*order)
    return out.limit(limit) if limit else out


def dedupe_urls(df: DataFrame, url: str, title: str) -> DataFrame:
    """One row for each URL: a title without a price text first, then the longest."""
    clean = ~F.coalesce(F.col(title), F.lit("")).rlike(r"[$¥₩]\s*\d")
    return first_per_key(df, [url], [clean.desc(), F.length(title).desc_nulls_last(), F.col(title)])


def runs(snapshot: DataFrame) -> DataFrame:
    """The runs of a snapshot, the newest first, with rows and the sites they span."""
    return snapshot.groupBy("run_id").agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set("retailer")), ",").alias("sites")).orderBy(F.desc("run_id"))


def rank_by_source(items: DataFrame, keys: list[str], order: list) -> DataFrame:
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
