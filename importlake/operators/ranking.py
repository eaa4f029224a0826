"""Ranking of factories and manufacturers among their peers.

Three grades: how many of the top retailers buy (one half of the score), imports relative to the peer group (three
tenths), and the trend over three years (two tenths).
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators import history as h
from importlake.operators import stats
from importlake.operators.history import year_counts, years_before

# Weights of the three grades, the limits of each grade.
WEIGHTS = {"retailer_grade": 0.5, "count_grade": 0.3, "trend_grade": 0.2}
RETAILERS_A, RETAILERS_B = 3, 1
TOP_QUARTER, LAST_QUARTER = 0.25, 0.75
SHARE_A, SHARE_C = 2.5, 1.5


def points(grade: Column) -> Column:
    return F.when(grade == "A", 3).when(grade == "B", 2).when(grade == "C", 1)


def retailer_grade(matched: Column) -> Column:
    return F.when(matched >= RETAILERS_A, "A").when(matched >= RETAILERS_B, "B").otherwise("C")


def trend_grade(old: Column, middle: Column, new: Column) -> Column:
    """A if each year had more than the one before, C if less."""
    return F.when((old < middle) & (middle < new), "A").when((old > middle) & (middle > new), "C").otherwise("B")


def count_grade(df: DataFrame, peers: list[str], count: str = "import_count", to: str = "count_grade") -> DataFrame:
    """By percent rank among the peers, the largest count first: the first quarter A, the last C; equals share a grade, one alone is an A."""
    rank = F.percent_rank().over(Window.partitionBy(*peers).orderBy(F.desc(count)))
    return df.withColumn(to, F.when(rank <= TOP_QUARTER, "A").when(rank >= LAST_QUARTER, "C").otherwise("B"))


def score(retailer: Column, count: Column, trend: Column) -> Column:
    weighted = points(retailer) * WEIGHTS["retailer_grade"] + points(count) * WEIGHTS["count_grade"] + points(trend) * WEIGHTS["trend_grade"]
    return F.round(weighted / 3 * 100, 1)


def matched_in_list(values: Column, listed: list[str]) -> Column:
    """The listed values that occur, in the list's order."""
    return F.array_intersect(F.array(*map(F.lit, listed)), values)


def explode_importers(sf: DataFrame) -> DataFrame:
    """A row for each importer of a row; one with a null for none."""
    return sf.select("*", F.explode_outer("importers").alias("importer_one"))


def axes(ih: DataFrame, peers: list[str], key: str, top: list[str], as_of: datetime.date) -> DataFrame:
    """Counts, top retailers met and yearly counts of each key among its peers, from one pass over the records.

    Rows whose key or any of whose peer columns is null belong to no peer group.
    """
    rows = ih.where(F.col(key).isNotNull())
    for p in peers:
        rows = rows.where(F.col(p).isNotNull())
    years = years_before(as_of)
    grouped = rows.groupBy(*peers, key).agg(
        F.count("*").alias("import_count"),
        F.collect_set(F.when(F.col("importer").isin(*top), F.col("importer"))).alias("met"),
        *year_counts(years, names=["y3", "y2", "y1"]),
    )
    return grouped.withColumn("top_retailers", matched_in_list(F.col("met"), top)).drop("met")


def rank_entities(ih: DataFrame, peers: list[str], key: str, top: list[str], as_of: datetime.date) -> DataFrame:
    """Rank every ``key`` among those alike in ``peers``, all peer groups at once.

    Columns ``y1`` to ``y3`` are the counts of the three years before ``as_of``, the oldest first.
    """
    graded = count_grade(axes(ih, peers, key, top, as_of), peers)
    graded = graded.withColumns({"retailer_grade": retailer_grade(F.size("top_retailers")), "trend_grade": trend_grade(F.col("y1"), F.col("y2"), F.col("y3"))})
    return graded.withColumn("ranking_score", score(F.col("retailer_grade"), F.col("count_grade"), F.col("trend_grade")))


def factory_rankings(ih: DataFrame, top: list[str], as_of: datetime.date) -> DataFrame:
    """The factories of each SKU among each other."""
    return rank_entities(ih, ["sku_name"], "factory", top, as_of)


def factory_rank_per_sku(ih: DataFrame, factory: str, top: list[str], as_of: datetime.date) -> DataFrame:
    """One factory among its peers for each of its SKUs. Only SKUs that the factory makes are ranked."""
    own = ih.where(F.col("factory") == factory).select("sku_name").distinct()
    return factory_rankings(ih.join(own, "sku_name", "left_semi"), top, as_of).where(F.col("factory") == factory)


def manufacturer_rankings(ih: DataFrame, top: list[str], as_of: datetime.date) -> DataFrame:
    return rank_entities(ih, ["country"], "manufacturer", top, as_of)


def share_weighted_grade(df: DataFrame, entity: list[str], grade: str, count: str) -> DataFrame:
    """The grade of an entity over its parts, each weighted by its share of the entity's count."""
    weight = F.sum(points(F.col(grade)) * F.col(count)) / F.sum(count)
    return df.groupBy(*entity).agg(weight.alias("weighted_points")).withColumn(
        "share_grade", F.when(F.col("weighted_points") >= SHARE_A, "A").when(F.col("weighted_points") < SHARE_C, "C").otherwise("B")
    )


def country_rankings(ih: DataFrame, top: list[str], as_of: datetime.date) -> DataFrame:
    """Manufacturers by country. The count grade is that of each SKU among all its makers anywhere, weighted by the SKU's share of
    the manufacturer's imports from the country; the two other grades look at that country alone."""
    known = ih.where("manufacturer is not null and sku_name is not null")
    worldwide = count_grade(known.groupBy("sku_name", "manufacturer").agg(F.count("*").alias("all_count")), ["sku_name"], "all_count", "sku_grade")
    local = known.where("country is not null").groupBy("country", "manufacturer", "sku_name").agg(F.count("*").alias("n"))
    graded = share_weighted_grade(local.join(worldwide, ["sku_name", "manufacturer"]), ["country", "manufacturer"], "sku_grade", "n")
    found = axes(ih, ["country"], "manufacturer", top, as_of).join(graded.select("country", "manufacturer", F.col("share_grade").alias("count_grade")), ["country", "manufacturer"], "left")
    found = found.withColumns({"retailer_grade": retailer_grade(F.size("top_retailers")), "trend_grade": trend_grade(F.col("y1"), F.col("y2"), F.col("y3"))})
    return found.withColumn("ranking_score", score(F.col("retailer_grade"), F.col("count_grade"), F.col("trend_grade")))


def by_score(df: DataFrame, *tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("ranking_score"), F.desc_nulls_last("import_count"), *tie)


def grade_order(grade: Column) -> Column:
    return F.when(grade == "A", 0).when(grade == "B", 1).when(grade == "C", 2).otherwise(3)


def score_grade(value: Column) -> Column:
    return F.when(value >= 80, "A").when(value >= 50, "B").when(value.isNotNull(), "C")


def sku_factories(sf: DataFrame, ih: DataFrame, sku: str, top: list[str], as_of: datetime.date) -> DataFrame:
    """The ranked listing of a SKU's factories with their contact data."""
    ranked = factory_rankings(ih.where(F.col("sku_name") == sku), top, as_of)
    contact = sf.where((F.col("sku_name") == sku) & F.col("factory").isNotNull()).groupBy("factory").agg(
        F.min("country").alias("country"), F.min("email").alias("email"), F.min("homepage").alias("homepage"), F.max("oem_status").alias("oem_status")
    )
    return by_score(ranked.join(contact, "factory", "left"), "factory")


GRADES = ["ranking_score", "retailer_grade", "count_grade", "trend_grade"]
#: The columns by which a country's listing can be put in order.
COUNTRY_SORTS = {"ranking_score", "import_count", "sku_count", "mc_count", "top_count", "latest_import"}
SIMILAR = 0.3


def country_listing(
    ih: DataFrame, country: str, top: list[str], as_of: datetime.date, mc: str | None = None, text: str | None = None, start: datetime.date | None = None, end: datetime.date | None = None,
    sort_by: str | None = None, descending: bool = True, number: int = 1, size: int = 20,
) -> DataFrame:
    """A page of a country's manufacturers (the factory stands in for a missing one), with counts, MCs, grades and ``rank``.

    Counts are those of a period of processing dates, grades those of the whole history. ``mc`` keeps the makers of an MC; ``text`` those with a row
    whose MC, SKU or own name contains it or whose SKU is similar by trigrams, the first such SKU by name being ``matched_sku``. In order by ``sort_by``, else
    by score if something is sought, else by imports; a missing number counts as -1, a missing date as the earliest; ties by name.
    """
    key = F.coalesce("manufacturer", "factory")
    own = ih.where((F.col("country") == country) & key.isNotNull())
    grades = country_rankings(ih, top, as_of).where(F.col("country") == country).select("manufacturer", *GRADES, "y1", "y2", "y3", F.col("top_retailers").alias("__top"))
    out = stats.country_manufacturers(h.in_period(own, start, end, "process"), country).join(grades, "manufacturer", "left")
    met = F.when(F.size("__top") > 0, F.col("__top")).otherwise(matched_in_list(F.col("importers"), top))
    out = out.withColumn("top_retailers", met).withColumn("top_count", F.size("top_retailers")).drop("__top")
    if mc and mc.strip():
        out = out.join(own.where(F.col("mc") == mc.strip()).select(key.alias("manufacturer")).distinct(), "manufacturer", "left_semi")
    if text and text.strip():
        q = text.strip()
        some = F.col("mc").ilike(f"%{q}%") | F.col("sku_name").ilike(f"%{q}%") | (x.trigram_similarity(F.col("sku_name"), F.lit(q)) >= SIMILAR) | key.ilike(f"%{q}%")
        pairs = own.select(key.alias("manufacturer"), "factory", "mc", "sku_name").distinct()  # similarity is measured once for a pair of maker and SKU
        out = out.join(pairs.where(some).groupBy("manufacturer").agg(F.min("sku_name").alias("matched_sku")), "manufacturer")
    by = sort_by if sort_by in COUNTRY_SORTS else "ranking_score" if mc or text else "import_count"
    value = F.coalesce(by, F.lit(datetime.date(1, 1, 1)) if by == "latest_import" else F.lit(-1))
    return h.display_rank(out, [value.desc() if descending else value.asc(), F.col("manufacturer")], number, size)


def sku_factory_listing(
    sf: DataFrame, ih: DataFrame, sku: str, top: list[str], as_of: datetime.date, start: datetime.date | None = None, end: datetime.date | None = None, text: str | None = None,
    country: str | None = None, has_contact: bool | None = None, oem_possible: bool = False, oem_word: str = "가능",
) -> DataFrame:
    """The factories of a SKU by score, then imports, with grades: a row for each factory, manufacturer, country and MC.

    Without a period the rows are those of the SKU-factory aggregate ``sf``. With one they are aggregated from its records, and contact data and OEM
    status are the factory's in the aggregate (of several the least, of the status the largest). ``text`` is sought in factory, country and importers; a blank
    e-mail address or homepage is none; ``oem_possible`` asks for ``oem_word`` in the OEM status. A factory without grades comes last.
    """
    keys, own = ["factory", "manufacturer", "country", "mc"], sf.where(F.col("sku_name") == sku)
    sought = f"%{text.strip()}%" if text and text.strip() else None
    if start is None and end is None:
        rows = own.select(*keys, "import_count", "import_types", "importers", "email", "homepage", "oem_status")
        if sought:
            rows = rows.where(F.coalesce(F.col("factory").ilike(sought), F.lit(False)) | F.coalesce(F.col("country").ilike(sought), F.lit(False)) | F.exists("importers", lambda i: i.ilike(sought)))
    else:
        facts = h.in_period(ih.where(F.col("sku_name") == sku), start, end)
        if sought:
            facts = h.search(facts, [text.strip()], ["factory", "country", "importer"])
        set_of = lambda c: F.array_sort(F.collect_set(c))
        rows = facts.groupBy(*keys).agg(F.count("*").alias("import_count"), set_of("import_type").alias("import_types"), set_of("importer").alias("importers"))
        rows = rows.join(own.groupBy("factory").agg(F.min("email").alias("email"), F.min("homepage").alias("homepage"), F.max("oem_status").alias("oem_status")), "factory", "left")
    if country:
        rows = rows.where(F.col("country") == country)
    if has_contact is not None:
        there = (F.coalesce("email", F.lit("")) != "") | (F.coalesce("homepage", F.lit("")) != "")
        rows = rows.where(there if has_contact else ~there)
    if oem_possible:
        rows = rows.where(F.col("oem_status").ilike(f"%{oem_word}%"))
    graded = factory_rankings(ih.where(F.col("sku_name") == sku), top, as_of).select("factory", *GRADES)
    return by_score(rows.join(graded, "factory", "left"), *keys)


def sku_info(ih: DataFrame) -> DataFrame:
    """(sku_name, mc, category, import_type, importers) of every SKU: the three of its first row by MC, category and type, nulls first, and all its importers."""
    first = F.min(F.struct("mc", "category", "import_type")).alias("first")
    return ih.where("sku_name is not null").groupBy("sku_name").agg(first, F.array_sort(F.collect_set("importer")).alias("importers")).select("sku_name", "first.*", "importers")
