"""Import files: headers, columns without names, cleaning, reports; exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from importlake.functions import text as x
from importlake.operators.retail import rank_by_source

# What a column of an import file may be called.
FIELDS = {
    "구분": "category", "분류": "category", "MC": "mc", "자사MC": "mc", "자사 MC": "mc", "카테고리": "mc",
    "제품명(한글)": "sku_name", "제품명": "sku_name", "상품명": "sku_name", "SKU명": "sku_name", "SKU": "sku_name", "품목명": "sku_name",
    "수입업체": "importer", "수입사": "importer", "수입/OEM업체": "importer", "거래한 유통사": "importer",
    "OEM여부": "import_type", "OEM 여부": "import_type", "OEM/수입": "import_type", "수입/OEM": "import_type",
    "해외제조업소": "factory", "해외 제조업소": "factory", "해외제조업체": "factory", "제조업소": "factory", "제조사": "factory", "제조업체": "factory",
    "제조국": "country", "제조국가": "country", "국가": "country", "이메일": "email", "연락처": "email", "email": "email", "Email": "email",
    "수입처리일자": "process_date", "처리일자": "process_date", "처리 일자": "process_date", "수입일자": "import_date", "수입 일자": "import_date",
}
POSITIONAL = ["category", "mc", "sku_name", "importer", "import_type", "factory", "country"]
RECORD = ["category", "mc", "sku_name", "import_type", "importer", "manufacturer", "factory", "country", "email", "oem_status", "import_date", "process_date"]
MOSTLY = 0.8


#: What stands at the beginning of a text file for spreadsheet programs to know its encoding.
BYTE_ORDER_MARK = "\ufeff"


def read_rows(spark: SparkSession, path: str, header: bool = True, line_breaks: bool = False) -> DataFrame:
    """CSV files with every column as text and the literal words of a missing value as null; quotes within a value are doubled, a byte order mark is no part of a name.

    ``line_breaks``: quoted values may hold them. A file then can't be split and is read by one task, so large loads are better many files.
    """
    raw = spark.read.csv(path, header=header, inferSchema=False, multiLine=line_breaks, escape='"')
    raw = raw.toDF(*[c.removeprefix(BYTE_ORDER_MARK) for c in raw.columns])
    return raw.select(*[x.blank_to_null(F.col(f"`{c}`"), literals=True).alias(c) for c in raw.columns])


def assign_positional(raw: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Name the columns of a file without header by its width: six lack the MC, eight have an e-mail address last; others are extra_1 and so on."""
    names, n = names or POSITIONAL, len(raw.columns)
    if n == 6:
        use = [c for c in names if c != "mc"]
    elif n == 8:
        use = [*names, "email"]
    else:
        use = [*names[:n], *[f"extra_{i}" for i in range(1, n - len(names) + 1)]]
    return raw.toDF(*use)


def detect_header(raw: DataFrame, order: str, fields: dict[str, str] | None = None, positional: list[str] | None = None) -> DataFrame:
    """Take the first row (by the ordinal column ``order``) as header if any of its cells is a known name, else assign names by place.

    Blank header cells get the name of their place, unknown ones keep their text. The ordinal stays.
    """
    fields, cells = fields or FIELDS, [c for c in raw.columns if c != order]
    first = raw.orderBy(order).limit(1).collect()
    if not first or not any((first[0][c] or "").strip() in fields for c in cells):
        named = assign_positional(raw.select(*cells), positional).columns
        return raw.select(order, *[F.col(f"`{c}`").alias(n) for c, n in zip(cells, named)])
    names, places = [], positional or POSITIONAL
    for k, c in enumerate(cells):
        text = (first[0][c] or "").strip()
        name = fields.get(text, text) or (places[k] if k < len(places) else f"extra_{k}")
        names.append(name if name not in names else f"{name}_{k}")
    return raw.where(F.col(order) > first[0][order]).select(order, *[F.col(f"`{c}`").alias(n) for c, n in zip(cells, names)])


def classify_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column the share of its values that look like dates and like e-mail addresses, and what it holds: date, email or extra."""
    shares = df.agg(*[a for c in columns for a in (F.avg(F.when(F.col(c).isNotNull(), x.safe_date(F.col(c)).isNotNull().cast("int"))).alias(f"{c}__d"), F.avg(F.col(c).rlike(f"^{x.EMAIL}$").cast("int")).alias(f"{c}__e"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__d").alias("date_share"), F.col(f"{c}__e").alias("email_share")) for c in columns])).alias("r")
    kind = F.when(F.col("date_share") >= MOSTLY, "date").when(F.col("email_share") >= MOSTLY, "email").otherwise("extra")
    return shares.select(rows).select("r.*").withColumn("kind", kind)


def recover_date_column(df: DataFrame, ignored: list[str]) -> DataFrame:
    """Without a process date, take the ignored column with the largest share of dates, if that is large enough, as one."""
    if "process_date" in df.columns or not ignored:
        return df
    found = classify_columns(df, ignored).where("kind = 'date'").orderBy(F.desc("date_share"), "column").limit(1).collect()
    return df.withColumn("process_date", x.safe_date(F.col(found[0]["column"]))) if found else df


def first_date_like(columns: list[str]) -> Column:
    return F.coalesce(*[x.safe_date(F.col(c)) for c in columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema, with nulls for those that are missing."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def ingest(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Clean records: text trimmed, names canonical, dates parsed; rows without an SKU name go. Missing columns are null.

    The manufacturer is the factory and the OEM status follows the import type, as the files have neither.
    """
    have = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    day = lambda c: x.safe_date(have(c))
    kind = x.oem_flag(have("import_type"))
    plain = {c: x.blank_to_null(have(c)) for c in ("category", "mc", "sku_name", "factory", "email")}
    out = df.select(
        plain["category"].alias("category"), plain["mc"].alias("mc"), plain["sku_name"].alias("sku_name"), kind.alias("import_type"),
        x.canonical_importer(have("importer"), aliases).alias("importer"), plain["factory"].alias("manufacturer"), plain["factory"].alias("factory"),
        x.normalize_country(have("country")).alias("country"), plain["email"].alias("email"), F.when(kind == x.OEM, "O").alias("oem_status"),
        day("import_date").alias("import_date"), day("process_date").alias("process_date"),
    )
    return out.where("sku_name is not null")


def ingest_report(df: DataFrame, sku: str = "sku_name") -> DataFrame:
    kept = x.blank_to_null(F.col(sku)).isNotNull()
    return df.agg(F.count("*").alias("total"), F.count_if(kept).alias("inserted"), F.count_if(~kept).alias("skipped"))


def observed_ingest(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> tuple[DataFrame, Observation]:
    """Clean records, and what counts them as they are written: ``get`` of the observation has total, inserted and skipped after the first action.

    The report comes from the pass that loads, so the files aren't read again. A table without a column for the SKU name keeps nothing.
    """
    seen = Observation()
    sku = F.col("sku_name").cast("string") if "sku_name" in df.columns else F.lit(None).cast("string")
    kept = x.blank_to_null(sku).isNotNull()
    counted = df.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("inserted"), F.count_if(~kept).alias("skipped"))
    return ingest(counted, aliases), seen


def ingest_json(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """Records from JSON rows whose keys are any known name of a field: the first that isn't null."""
    fields = {**{c: c for c in RECORD}, **(fields or FIELDS)}
    found: dict[str, list[str]] = {}
    for c in df.columns:
        if c in fields:
            found.setdefault(fields[c], []).append(c)
    return ingest(df.select(*[F.coalesce(*[F.col(f"`{c}`").cast("string") for c in cs]).alias(f) for f, cs in found.items()]))


def export_csv(df: DataFrame, path: str, order: list[str] | None = None, mark: bool = True) -> None:
    """Write a table as CSV files, each with header, a byte order mark unless ``mark`` is off, and empty text for nulls; in order if asked. Quotes within a value are doubled."""
    rows = df.orderBy(*order) if order else df
    named = rows.toDF(*[BYTE_ORDER_MARK * (mark and k == 0) + c for k, c in enumerate(rows.columns)])
    named.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def product_list(psi: DataFrame) -> DataFrame:
    """The flat product list, one row for each ranked product."""
    columns = ["product_type", "retailer", "rank", "brand_en", "product_name_en", "price_usd", "unit", "parallel_import", "recall_status", "quality_label_status", "legal_risk_status", "product_group_key"]
    return psi.select(*columns)


def load_tariffs(raw: DataFrame, order: str) -> DataFrame:
    """Tariff rows of a file: digits of the code, dates from ``YYYYMMDD``; incomplete rows go; of one code, type and first day the last row stays."""
    cleaned = raw.select(
        x.hs_digits(F.col("hs_code")).alias("hs_code"), x.blank_to_null(F.col("rate_type")).alias("rate_type"), F.trim("rate_pct").try_cast("double").alias("rate_pct"),
        F.try_to_date(F.col("effective_from"), "yyyyMMdd").alias("effective_from"), F.try_to_date(F.col("effective_to"), "yyyyMMdd").alias("effective_to"), F.col(order).alias("__o"),
    ).where("hs_code is not null and rate_type is not null and rate_pct is not null")
    last = cleaned.groupBy("hs_code", "rate_type", "effective_from").agg(F.max_by(F.struct("rate_pct", "effective_to"), "__o").alias("v"))
    return last.select("hs_code", "rate_type", "v.rate_pct", "effective_from", "v.effective_to")


def flatten_results(records: DataFrame) -> DataFrame:
    """Crawl records with nested items to rows; failed records go, ranks begin anew for each source within a record."""
    ok = records.where("status = 'ok'").select("record_id", "product_type", "retailer", F.posexplode("items").alias("pos", "item"))
    flat = ok.select("record_id", "product_type", "retailer", "pos", "item.*").withColumn("source", F.coalesce("source", "retailer"))
    return rank_by_source(flat, ["record_id", "source"], ["pos"]).drop("pos")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work that isn't done; a failed attempt counts as done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def load_item_stats(raw: DataFrame, order: str) -> DataFrame:
    """Customs statistics: rows of a country's total (level 0) and of blank or sub-total items go; of one country and item the last stays."""
    rows = raw.where((F.col("level") != "0") & x.blank_to_null(F.col("item_name")).isNotNull() & ~F.col("item_name").isin("소계", "합계", "subtotal"))
    last = rows.groupBy("country", F.trim("item_name").alias("item_name")).agg(F.max_by(F.struct("amount", "weight"), order).alias("v"))
    return last.select("country", "item_name", F.col("v.amount").try_cast("double").alias("amount_usd_k"), F.col("v.weight").try_cast("double").alias("weight_ton"))


def unpivot_cards(cells: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Cells (sheet, row, col, value) of cards to a row for each card.

    A block begins with a row whose first cell is ``type: name``, has a retailer in the row below, then rows of a label and
    values, one column for each rank. Cards without brand go. The labels, one for each row of a sheet, are broadcast; the values stay dealt out.
    """
    head = cells.where("col = 0").select("sheet", "row", F.col("value").alias("label"))
    w = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.col("label").startswith("type: "), F.substring("label", 7, 1000))
    shop = F.when(F.col("label").startswith("retailer: "), F.substring("label", 11, 1000))
    block = head.withColumns({"product_type": F.last(kind, True).over(w), "retailer": F.last(shop, True).over(w), "block": F.sum(shop.isNotNull().cast("int")).over(w), "field": x.classify_label(F.col("label"), labels)})
    values = cells.where("col > 0").join(F.broadcast(block.where("field is not null")), ["sheet", "row"])
    fields = sorted(set(labels.values()))
    wide = values.groupBy("sheet", "block", "product_type", "retailer", F.col("col").alias("rank")).pivot("field", fields).agg(F.first("value", True))
    return wide.where(x.blank_to_null(F.col("brand")).isNotNull()).drop("sheet", "block")


def mapping_report(df: DataFrame, mapping: DataFrame, item: str = "item_type") -> DataFrame:
    """Items without an MC in the mapping, with the number of their rows."""
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("rows")).join(mapping.select(item).distinct(), item, "left_anti")
