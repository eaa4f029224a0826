"""Statistics by country, manufacturer and item; coverage and freshness."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from importlake.operators.history import effective_date, null_safe_join

OTHERS = "기타"


def amount_rank(totals: DataFrame) -> DataFrame:
    """Countries by amount, the largest first; ties by name."""
    return totals.withColumn("amount_rank", F.row_number().over(Window.orderBy(F.desc("amount_usd_k"), "country")))


def country_summary(ih: DataFrame, totals: DataFrame) -> DataFrame:
    """Manufacturers and rows of each country, with the rank and share of its amount among all countries."""
    counted = ih.where("country is not null").groupBy("country").agg(
        F.count_distinct(F.coalesce("manufacturer", "factory")).alias("manufacturer_count"), F.count("*").alias("import_count")
    )
    whole = totals.agg(F.sum("amount_usd_k").alias("whole"))
    ranked = amount_rank(totals).crossJoin(F.broadcast(whole))
    share = F.round(F.try_divide(F.col("amount_usd_k") * 100, F.col("whole")), 6)
    return counted.join(ranked, "country", "left").select("country", "manufacturer_count", "import_count", "amount_usd_k", "amount_rank", share.alias("amount_share_pct"))


def amount_share(totals: DataFrame, n: int, others: str = OTHERS) -> DataFrame:
    """The ``n`` countries with the largest amounts and one row for the rest, with shares of the whole."""
    label = F.when(F.col("amount_rank") > n, others).otherwise(F.col("country"))
    whole = totals.agg(F.sum("amount_usd_k").alias("whole"))
    grouped = amount_rank(totals).groupBy(label.alias("country")).agg(F.sum("amount_usd_k").alias("amount_usd_k"))
    return grouped.crossJoin(F.broadcast(whole)).select("country", "amount_usd_k", F.round(F.try_divide(F.col("amount_usd_k") * 100, F.col("whole")), 6).alias("share_pct"))


def country_totals(cia: DataFrame) -> DataFrame:
    return cia.groupBy("country").agg(F.sum("amount_usd_k").alias("amount_usd_k"))


def top_items(cia: DataFrame, n: int) -> DataFrame:
    """The ``n`` items of each country with the largest amounts, with their share of the country's whole."""
    of_country = Window.partitionBy("country")
    ranked = cia.withColumns({
        "rank": F.row_number().over(of_country.orderBy(F.desc("amount_usd_k"), "item_name")),
        "share_pct": F.round(F.try_divide(F.col("amount_usd_k") * 100, F.sum("amount_usd_k").over(of_country)), 6),
    })
    return ranked.where(F.col("rank") <= n).select("country", "rank", "item_name", "amount_usd_k", "share_pct")


def country_top_items(items: DataFrame, country: str) -> DataFrame:
    return items.where(F.col("country") == country).orderBy("rank")


def item_countries(cia: DataFrame, term: str) -> DataFrame:
    """The countries that items matching a term come from, with amounts and shares."""
    found = cia.where(F.col("item_name").ilike(f"%{term}%")).groupBy("country").agg(F.sum("amount_usd_k").alias("amount_usd_k"))
    whole = found.agg(F.sum("amount_usd_k").alias("whole"))
    share = F.round(F.try_divide(F.col("amount_usd_k") * 100, F.col("whole")), 6)
    return found.crossJoin(F.broadcast(whole)).select("country", "amount_usd_k", share.alias("share_pct")).orderBy(F.desc("amount_usd_k"), "country")


def overall(ih: DataFrame) -> DataFrame:
    """One row of counts. An SKU is a name and factory, both known; a null in either leaves a row out."""
    day = effective_date()
    return ih.agg(
        F.count("*").alias("total_records"),
        F.count_distinct(F.concat("sku_name", "factory")).alias("unique_skus"),
        F.count_distinct("manufacturer").alias("unique_manufacturers"),
        F.count_distinct("country").alias("unique_countries"),
        F.count_distinct("importer").alias("unique_importers"),
        F.min(day).alias("first_date"),
        F.max(day).alias("latest_date"),
    )


def email_stats(ih: DataFrame) -> DataFrame:
    """How many manufacturers and factories there are, and how many of them have an e-mail address; nulls count as a value."""
    pair = F.struct("manufacturer", "factory")
    there = F.col("email").isNotNull() & (F.trim("email") != "")
    return ih.agg(
        F.count_distinct(pair).alias("total_entities"),
        F.count_distinct(F.when(there, pair)).alias("with_email"),
        F.count_distinct(F.when(~there | F.col("email").isNull(), pair)).alias("without_email"),
    )


def coverage(df: DataFrame, column: str, key: str) -> DataFrame:
    """Rows and distinct keys with and without a value in a column, as for English names."""
    there = F.col(column).isNotNull() & (F.trim(column) != "")
    return df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(there).alias("filled_rows"),
        F.count_distinct(key).alias("total_keys"),
        F.count_distinct(F.when(there, F.col(key))).alias("filled_keys"),
    )


def group_factory_counts(ih: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """The distinct factories of each named group of importers, and of all, in one pass."""
    return ih.agg(*[F.count_distinct(F.when(test, F.col("factory"))).alias(name) for name, test in groups.items()], F.count_distinct("factory").alias("total"))


def mcs_by_frequency(ih: DataFrame, entity: str = "manufacturer") -> DataFrame:
    """The MCs of each entity, the most frequent first, ties by name; the first is the primary one."""
    counts = ih.where(F.col("mc").isNotNull()).groupBy(entity, "mc").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "mc")))
    return counts.groupBy(entity).agg(F.transform(ordered, lambda x: x["mc"]).alias("mcs")).withColumn("primary_mc", F.col("mcs")[0])


def country_manufacturers(ih: DataFrame, country: str) -> DataFrame:
    """The manufacturers of a country: SKUs, rows, MCs, latest date, importers."""
    rows = ih.where(F.col("country") == country).withColumn("manufacturer", F.coalesce("manufacturer", "factory"))
    found = rows.groupBy("manufacturer").agg(
        F.count_distinct("sku_name").alias("sku_count"), F.count("*").alias("import_count"), F.count_distinct("mc").alias("mc_count"),
        F.max(effective_date()).alias("latest_import"), F.array_sort(F.collect_set("importer")).alias("importers"),
    )
    return found.join(mcs_by_frequency(rows), "manufacturer", "left")


def listed_first(values: Column, listed: list[str]) -> Column:
    """The values that are listed, in the list's order, then the others by name."""
    order = F.array(*map(F.lit, listed)) if listed else F.expr("cast(array() as array<string>)")
    return F.concat(F.filter(order, lambda x: F.array_contains(values, x)), F.array_sort(F.array_except(values, order)))


def manufacturer_detail(ih: DataFrame, main_importers: list[str]) -> DataFrame:
    """A row for each manufacturer: totals, lists of distinct values, and contact data of its newest row."""
    newest = F.struct(effective_date().alias("d"), "factory", "country", "email", "homepage")
    out = ih.where("manufacturer is not null").groupBy("manufacturer").agg(
        F.count("*").alias("import_count"),
        F.count_distinct("sku_name").alias("sku_count"),
        F.max(effective_date()).alias("latest_import"),
        F.array_sort(F.collect_set("country")).alias("countries"),
        F.array_sort(F.collect_set("mc")).alias("mcs"),
        listed_first(F.collect_set("importer"), main_importers).alias("importers"),
        F.max(newest).alias("newest"),
    )
    return out.select(*[c for c in out.columns if c != "newest"], "newest.factory", F.col("newest.email").alias("email"), F.col("newest.homepage").alias("homepage"))


def manufacturer_summary(ih: DataFrame) -> DataFrame:
    return ih.groupBy(F.coalesce("manufacturer", "factory").alias("manufacturer"), "country").agg(
        F.max("email").alias("email"), F.max("homepage").alias("homepage"), F.count("*").alias("import_count"), F.max(effective_date()).alias("latest_import")
    )


def fill_mode(ih: DataFrame, keys: list[str], column: str = "mc") -> DataFrame:
    """Fill nulls of a column by the most frequent value among rows alike in the keys; of tied values the smallest."""
    known = ih.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.mode(column, True).alias("__mode"))
    return null_safe_join(ih, known, keys).withColumn(column, F.coalesce(column, "__mode")).drop("__mode")


def freshness(ih: DataFrame, since: datetime.date) -> DataFrame:
    day = effective_date()
    return ih.agg(
        F.max(day).alias("latest_date"), F.bool_or(F.coalesce(F.col("import_type") == "OEM", F.lit(False))).alias("has_oem"), F.count("*").alias("total_rows"),
        F.count_if(day >= F.lit(since)).alias("rows_since"), F.count_if(day.isNull()).alias("undated_rows"),
    )


def products(ih: DataFrame) -> DataFrame:
    """The distinct products with the number of their rows."""
    return ih.where("sku_name is not null").groupBy("sku_name", "mc", "category").agg(F.count("*").alias("popularity"))


def distinct_values(df: DataFrame, column: str, test: Column | None = None) -> DataFrame:
    rows = df if test is None else df.where(test)
    return rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")


def local_facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of several columns of a result, each as a sorted array, in one pass."""
    return df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def newest_per_entity(ih: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The newest row of each entity with the number of its rows and its latest date; the entities with most rows first."""
    day = effective_date()
    tie = F.struct(day.alias("latest"), "sku_name", "country", "email", "homepage")
    out = ih.groupBy(*keys).agg(F.count("*").alias("record_count"), F.max(day).alias("latest_date"), F.max(tie).alias("newest"))
    flat = out.select(*keys, "record_count", "latest_date", "newest.sku_name", "newest.country", "newest.email", "newest.homepage")
    return flat.orderBy(F.desc("record_count"), *[F.asc_nulls_first(k) for k in keys]).limit(limit)


def due_for_retry(df: DataFrame, days: int, now: datetime.date, email: str = "email", tried: str = "tried_at") -> DataFrame:
    """Rows without e-mail address that were never tried, or not for ``days`` days."""
    missing = F.col(email).isNull() | (F.trim(email) == "")
    return df.where(missing & (F.col(tried).isNull() | (F.col(tried) < F.date_sub(F.lit(now), days))))


def lookup(df: DataFrame, test: Column, order: list, n: int | None = None) -> DataFrame:
    """The rows that pass a test, in order; the first ``n`` of them if given."""
    out = df.where(test).orderBy(*order)
    return out if n is None else out.limit(n)


def restrict_entities(entities: DataFrame, ih: DataFrame, entity: str, mc: str | None = None, text: str | None = None) -> DataFrame:
    """The entities that have a record of an MC, or whose SKU names match a text; with the first such SKU."""
    rows = ih
    if mc is not None:
        rows = rows.where(F.col("mc") == mc)
    if text is not None:
        rows = rows.where(F.col("sku_name").ilike(f"%{text}%"))
    found = rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min("sku_name").alias("matched_sku"))
    return entities.join(found, entity)


def status_report(df: DataFrame, keys: list[str], states: list[str], column: str = "status") -> DataFrame:
    """Rows in all and by status."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == s).alias(s) for s in states])


def percent_change(now: Column, before: Column) -> Column:
    """Growth in whole percent, halves upward; null where there was nothing before."""
    return F.floor(F.try_divide((now - before) * F.lit(100.0), before) + 0.5).cast("long")
