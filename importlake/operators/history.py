"""Aggregates of import records, their filters, orders and pages, and gap-filled series."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The grain of an SKU history, and of its market status.
SKU_KEYS = ["category", "mc", "sku_name", "import_type", "importer", "manufacturer", "factory", "country"]
MARKET_KEYS = ["category", "mc", "sku_name", "manufacturer", "factory", "country"]
FACTORY_KEYS = ["sku_name", "manufacturer", "factory", "country", "mc"]
#: The keys of an SKU history so that a factory's groups follow each other, and in them those of one market status: in this order, one sort serves all.
NESTED_KEYS = [*FACTORY_KEYS, "category", "import_type", "importer"]
SEARCHED = ["category", "mc", "sku_name", "importer", "manufacturer", "factory"]
SORTABLE = {*SKU_KEYS, "import_count", "latest_import", "first_import", "market_status", "email"}


def effective_date(mode: str = "either") -> Column:
    """``either``: the import date, else the processing date. ``process``: the processing date only."""
    return F.col("process_date") if mode == "process" else F.coalesce("import_date", "process_date")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys of which null equals null; the right side's keys are dropped."""
    other = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    on = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    out = left.join(other, on, how)
    return out.drop(*[f"__{k}" for k in keys])


def years_before(as_of: datetime.date, n: int = 3) -> list[int]:
    return [as_of.year - k for k in range(1, n + 1)]


def year_counts(years: Iterable[int], day: Column | None = None, names: Iterable[str] | None = None) -> list[Column]:
    """Aggregates that count the rows of each year."""
    day = effective_date() if day is None else day
    names = names or [f"count_year{k}" for k in range(1, 9)]
    return [F.count_if(F.year(day) == y).alias(n) for y, n in zip(years, names)]


def market_status(ih: DataFrame) -> DataFrame:
    """O where two or more importers brought in the same goods, else X. Rows without importer don't count."""
    return ih.where(F.col("importer").isNotNull()).groupBy(*MARKET_KEYS).agg(_status(F.min("importer"), F.max("importer")).alias("market_status"))


def _status(first: Column, last: Column) -> Column:
    """Of the least and the largest importer, which differ if there are two; null without any."""
    return F.when(first < last, "O").when(first.isNotNull(), "X")


def with_market_status(groups: DataFrame) -> DataFrame:
    """Groups that have the importer among their keys, with the status of their goods: from the groups themselves, so the records are read once."""
    same = Window.partitionBy(*NESTED_KEYS[:6])
    return groups.withColumn("market_status", _status(F.min("importer").over(same), F.max("importer").over(same)))


def sku_groups(ih: DataFrame, as_of: datetime.date) -> DataFrame:
    """The rows of the SKU history without market status, with what ``factories_of_groups`` needs besides."""
    return _history(ih, as_of, F.min("homepage").alias("homepage"), F.max("oem_status").alias("oem_status"))


def _history(ih: DataFrame, as_of: datetime.date, *more: Column) -> DataFrame:
    day = effective_date()
    out = ih.groupBy(*NESTED_KEYS).agg(
        F.count("*").alias("import_count"),
        F.min("email").alias("email"),
        F.min(day).alias("first_import"),
        F.max(day).alias("latest_import"),
        F.lit(as_of.year).alias("base_year"),
        *year_counts(years_before(as_of), day),
        F.max("hs_code").alias("hs_code"),
        F.max("unit").alias("unit"),
        F.bool_or(F.col("oem_status").isNotNull()).alias("oem_possible"),
        *more,
    )
    return out.select(*SKU_KEYS, *out.columns[len(NESTED_KEYS) :])


def sku_history(ih: DataFrame, as_of: datetime.date, with_status: bool = True) -> DataFrame:
    """A row for each SKU, importer, factory and country: counts, dates, counts of the three years before ``as_of``."""
    out = _history(ih, as_of)
    if not with_status:
        return out.withColumn("market_status", F.lit(None).cast("string"))
    return with_market_status(out)


def _of_factory() -> dict[str, Column]:
    """Aggregates over groups at the grain of the SKU history."""
    return {
        "import_count": F.sum("import_count"), "email": F.min("email"), "homepage": F.min("homepage"), "oem_status": F.max("oem_status"),
        "importers": F.collect_set("importer"), "import_types": F.collect_set("import_type"),
    }


def _sorted_sets(factories: DataFrame) -> DataFrame:
    return factories.withColumns({c: F.array_sort(c) for c in ("importers", "import_types")})


def factories_of_groups(groups: DataFrame) -> DataFrame:
    """``sku_factory`` from groups at the grain of the SKU history, whose keys have the importers and the import types."""
    return _sorted_sets(groups.groupBy(*FACTORY_KEYS).agg(*[c.alias(n) for n, c in _of_factory().items()]))


def whole_groups(groups: DataFrame) -> DataFrame:
    """Groups that have the importer among their keys, with market status, and with the first of each factory and of each market marked.

    The first of a factory has its aggregates in ``of_factory``, else null; the first of a market has ``of_market`` true. So the tables of factories and of the
    market status are rows of this one (``marked_factories``, ``marked_status``), which need no grouping of their own.
    """
    factory, market = (Window.partitionBy(*NESTED_KEYS[:n]).orderBy(*NESTED_KEYS[n:]) for n in (5, 6))
    whole = lambda c, w: c.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = groups.select("*", F.row_number().over(factory).alias("__nth"), *[whole(c, factory).alias(f"__{n}") for n, c in _of_factory().items()])
    once = F.when(F.col("__nth") == 1, F.struct(*[F.col(f"__{n}").alias(n) for n in _of_factory()])).alias("of_factory")
    found = found.select(*groups.columns, once)
    return found.select("*", (F.row_number().over(market) == 1).alias("of_market"), _status(whole(F.min("importer"), market), whole(F.max("importer"), market)).alias("market_status"))


def marked_factories(groups: DataFrame) -> DataFrame:
    """``sku_factory`` from ``whole_groups``."""
    return _sorted_sets(groups.where("of_factory is not null").select(*FACTORY_KEYS, "of_factory.*"))


def marked_status(groups: DataFrame) -> DataFrame:
    """``market_status`` from ``whole_groups``."""
    return groups.where("of_market and market_status is not null").select(*MARKET_KEYS, "market_status")


def sku_factory(ih: DataFrame) -> DataFrame:
    """A row for each SKU and factory: count, contact data and the importers and types that occur."""
    return ih.groupBy(*FACTORY_KEYS).agg(
        F.count("*").alias("import_count"),
        F.min("email").alias("email"),
        F.min("homepage").alias("homepage"),
        F.max("oem_status").alias("oem_status"),
        F.array_sort(F.collect_set("importer")).alias("importers"),
        F.array_sort(F.collect_set("import_type")).alias("import_types"),
    )


def in_period(ih: DataFrame, start: datetime.date | None, end: datetime.date | None, mode: str = "either") -> DataFrame:
    """Rows whose effective date lies in the closed period; an open end admits every date, but none admits a missing one."""
    if start is None and end is None:
        return ih
    low, high = start or datetime.date(1900, 1, 1), end or datetime.date(9999, 12, 31)
    return ih.where(effective_date(mode).between(F.lit(low), F.lit(high)))


def sku_history_period(ih: DataFrame, start: datetime.date | None, end: datetime.date | None, as_of: datetime.date) -> DataFrame:
    """The SKU history of a period. Market status is a matter of the whole history and null here."""
    return sku_history(in_period(ih, start, end), as_of, with_status=False)


def factory_view(history: DataFrame, keep: Column | None = None, status: DataFrame | None = None) -> DataFrame:
    """SKU histories rolled up over importers. A group stays if ``keep`` holds for any of its rows. Its market status is that of its rows, unless ``status`` gives another."""
    keys = [k for k in SKU_KEYS if k != "importer"]
    counted = [c for c in history.columns if c.startswith("count_year")]
    out = history.groupBy(*keys).agg(
        F.array_sort(F.collect_set("importer")).alias("importers"),
        F.sum("import_count").alias("import_count"),
        F.min("email").alias("email"),
        F.min("first_import").alias("first_import"),
        F.max("latest_import").alias("latest_import"),
        *[F.sum(c).alias(c) for c in counted],
        *[F.max(c).alias(c) for c in ["market_status"] if c in history.columns and status is None],
        F.bool_or(F.lit(True) if keep is None else keep).alias("__keep"),
    )
    out = out.where("__keep").drop("__keep")
    return out if status is None else null_safe_join(out, status, MARKET_KEYS)


# Filters


def contains_any(terms: Iterable[str], columns: Iterable[str] = tuple(SEARCHED), escape: bool = False) -> Column:
    """True where any column contains any term, in either case. ``%`` and ``_`` in a term are wildcards unless ``escape``."""
    some = F.lit(False)
    for t in terms:
        if escape:
            t = t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        for c in columns:
            some = some | F.coalesce(F.col(c).ilike(f"%{t}%"), F.lit(False))
    return some


def search(df: DataFrame, terms: Iterable[str], columns: Iterable[str] = tuple(SEARCHED), escape: bool = False) -> DataFrame:
    """The rows for which ``contains_any`` holds."""
    return df.where(contains_any(terms, columns, escape))


def in_group(column: Column, aliases: Iterable[str]) -> Column:
    """True where the value contains one of the aliases; one that begins with ``^`` must stand at its beginning."""
    some = F.lit(False)
    for a in aliases:
        some = some | column.ilike(f"{a[1:]}%" if a.startswith("^") else f"%{a}%")
    return F.coalesce(some, F.lit(False))


def having_any(df: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """All rows of the groups in which the test holds for any row."""
    some = df.groupBy(*keys).agg(F.bool_or(F.coalesce(test, F.lit(False))).alias("__any")).where("__any").drop("__any")
    return null_safe_join(df, some.withColumn("__hit", F.lit(1)), keys, "inner").drop("__hit")


def in_lists(df: DataFrame, lists: dict[str, list]) -> DataFrame:
    for c, values in lists.items():
        if values:
            df = df.where(F.col(c).isin(*values))
    return df


def contact_filter(df: DataFrame, has_email: bool | None = None, oem_possible: bool | None = None, blank_is_missing: bool = False) -> DataFrame:
    if has_email is not None:
        there = F.col("email").isNotNull() & ((F.trim("email") != "") if blank_is_missing else F.lit(True))
        df = df.where(there if has_email else ~there)
    if oem_possible is not None:
        there = F.col("oem_status").isNotNull()
        df = df.where(there if oem_possible else ~there)
    return df


def match_group(df: DataFrame, values: dict) -> DataFrame:
    """Rows that have exactly these values; a value of None asks for null."""
    for c, v in values.items():
        df = df.where(F.col(c).isNull() if v is None else F.col(c) == v)
    return df


def facet(df: DataFrame, column: str, filters: dict[str, list], last: str | None = None) -> DataFrame:
    """The distinct values of a column under all filters but its own, in order, one label last."""
    rows = in_lists(df, {c: v for c, v in filters.items() if c != column})
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.orderBy(label_last("value", last), "value")


def label_last(column: str, label: str | None) -> Column:
    return F.when(F.col(column) == label, 1).otherwise(0)


# Orders and pages


def sort_rows(df: DataFrame, column: str = "import_count", descending: bool = True, keys: Iterable[str] = tuple(SKU_KEYS)) -> DataFrame:
    """Order by a known column (else by import count), nulls last either way; then the latest date, a missing one first; then the keys."""
    column = column if column in SORTABLE and column in df.columns else "import_count"
    first = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(first, F.col("latest_import").desc_nulls_first(), *[F.col(k).asc_nulls_first() for k in keys])


def oem_first(column: str) -> Column:
    return F.when(F.col(column) == "OEM", 0).otherwise(1)


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number``, from 1."""
    return df.offset((max(1, number) - 1) * size).limit(size)


def total_pages(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def page_with_total(df: DataFrame, number: int, size: int) -> tuple[DataFrame, int]:
    """A page, and the number of rows in all."""
    return page(df, number, size), df.count()


def with_total(df: DataFrame) -> DataFrame:
    """Each row with the number of rows in all, by a one-row join rather than a window over one partition."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias("total_count"))))


def display_rank(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page whose rows bear their rank in the whole order."""
    top = df.orderBy(*order).limit(max(1, number) * size)  # no row beyond the page is ranked
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))


# Series


def _series(ih: DataFrame, keys: list[str], unit: str, pattern: str, start: datetime.date | None, end: datetime.date | None, as_of: datetime.date) -> DataFrame:
    day = F.trunc(effective_date(), unit)
    rows = in_period(ih, start, end).select(*keys, day.alias("d")).where("d is not null")
    counts = rows.groupBy(*keys, "d").agg(F.count("*").alias("n"))
    first = F.trunc(F.lit(start), unit) if start else F.min("d")
    span = counts.groupBy(*keys).agg(first.alias("lo"), F.trunc(F.lit(end or as_of), unit).alias("hi")).where("lo <= hi")
    step = F.expr("interval 1 month" if unit == "month" else "interval 1 year")
    calendar = span.select(*keys, F.explode(F.sequence("lo", "hi", step)).alias("d"))
    filled = null_safe_join(calendar, counts, [*keys, "d"])
    return filled.select(*keys, F.date_format("d", pattern).alias("label"), F.coalesce("n", F.lit(0)).alias("count"))


def monthly_series(ih: DataFrame, keys: list[str], as_of: datetime.date, start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
    """Counts of each month of each group, with zeros for months without rows, from the first row (or ``start``) to ``as_of`` (or ``end``)."""
    return _series(ih, keys, "month", "yy/MM", start, end, as_of)


def yearly_series(ih: DataFrame, keys: list[str], as_of: datetime.date, start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
    return _series(ih, keys, "year", "yyyy", start, end, as_of)


def yoy_series(ih: DataFrame, keys: list[str], as_of: datetime.date) -> DataFrame:
    """Each year against the one before; the year of ``as_of`` against the same months of the year before."""
    day = effective_date()
    rows = ih.select(*keys, F.year(day).alias("y"), F.month(day).alias("m")).where("y is not null")
    counts = rows.groupBy(*keys, "y").agg(F.count("*").alias("n"), F.count_if(F.col("m") <= as_of.month).alias("part"))
    own = F.when(F.col("y") == as_of.year, F.col("part")).otherwise(F.col("n"))
    before = counts.select(*keys, (F.col("y") + 1).alias("y"), F.when(F.col("y") + 1 == as_of.year, F.col("part")).otherwise(F.col("n")).alias("previous"))
    joined = null_safe_join(counts.select(*keys, "y", own.alias("n")), before, [*keys, "y"])
    change = F.floor(F.try_divide((F.col("n") - F.col("previous")) * 100.0, F.col("previous")) + 0.5).cast("long")
    return joined.select(*keys, F.col("y").alias("year"), F.col("n").alias("count"), "previous", change.alias("growth_pct"))


def month_bound(text: Column, end: bool = False) -> Column:
    """The first or last day of a month given as ``YYYY-MM``; null if it isn't one."""
    first = F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd")
    return F.last_day(first) if end else first
