"""Enrichment of records and products from other tables."""

from __future__ import annotations

import datetime
import math
from collections import deque
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators.history import null_safe_join


def expression_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on trimmed lower-case keys of which null is the empty text; the right side's keys are dropped."""
    other = b.select(*[x.vector_key(F.col(k)).alias(f"__{k}") if k in keys else F.col(k) for k in b.columns])
    on = [x.vector_key(a[k]) == other[f"__{k}"] for k in keys]
    return a.join(other, on, how).drop(*[f"__{k}" for k in keys])


def enrich_contacts(ih: DataFrame, contacts: DataFrame, columns: tuple[str, ...] = ("email", "homepage"), overwrite: bool = False) -> DataFrame:
    """Contact data by factory or manufacturer name (``factory`` of ``contacts``), where the country is equal or the contact has none.

    The contact for the country comes before a general one, one by factory before one by manufacturer, and of those alike the last in order
    of ``ordinal``. The keys are resolved once for each (factory, manufacturer, country), not for each record.
    """
    keys = ih.select("factory", "manufacturer", "country").distinct()
    c = contacts.where("factory is not null").select(F.col("factory").alias("c_name"), F.col("country").alias("c_country"), "ordinal", *[F.col(k).alias(f"c_{k}") for k in columns])
    by_factory = keys.join(c, keys["factory"] == c["c_name"]).withColumn("by", F.lit(1))
    by_maker = keys.join(c, keys["manufacturer"] == c["c_name"]).withColumn("by", F.lit(0))
    fits = by_factory.unionByName(by_maker).where("c_country is null or c_country = country")
    rank = F.struct(F.col("c_country").isNotNull(), "by", "ordinal")
    best = fits.groupBy("factory", "manufacturer", "country").agg(F.max_by(F.struct(*[f"c_{k}" for k in columns]), rank).alias("c"))
    out = null_safe_join(ih, best, ["factory", "manufacturer", "country"])
    for k in columns:
        new, old = F.col(f"c.c_{k}"), F.when(F.trim(k) != "", F.col(k))
        out = out.withColumn(k, F.coalesce(new, old) if overwrite else F.coalesce(old, new))
    return out.drop("c")


def enrich_english(ih: DataFrame, names: DataFrame, with_importer: bool = True, overwrite: bool = False, column: str = "sku_name_en") -> DataFrame:
    """English names by SKU and factory, and by importer if asked; of inputs alike the last (by ``ordinal``)."""
    keys = ["sku_name", "factory", *(["importer"] if with_importer else [])]
    last = names.groupBy(*keys).agg(F.max_by(column, "ordinal").alias("__new"))
    joined = ih.join(last, keys, "left")
    old = F.col(column) if column in ih.columns else F.lit(None).cast("string")
    return joined.withColumn(column, F.coalesce("__new", old) if overwrite else F.coalesce(old, "__new")).drop("__new")


def _with_codes(df: DataFrame, file: DataFrame, keys: list[str]) -> DataFrame:
    sure = file.where(F.col("confidence").isin("high", "medium") & x.hs_digits(F.col("hs_code")).isNotNull())
    once = sure.groupBy(*keys).agg(F.max_by(x.hs_digits(F.col("hs_code")), "ordinal").alias("__code"))
    return df.join(once, keys, "left").withColumn("hs_code", F.coalesce("__code", *(["hs_code"] if "hs_code" in df.columns else []))).drop("__code")


def _misses(df: DataFrame, file: DataFrame, keys: list[str]) -> DataFrame:
    known = df.select(*keys).distinct().withColumn("__known", F.lit(True))
    reason = (
        F.when(x.hs_digits(F.col("hs_code")).isNull(), "no_code").when(~F.coalesce(F.col("confidence").isin("high", "medium"), F.lit(False)), "low_confidence")
        .when(F.col("__known").isNull(), "no_row")
    )
    return file.join(known, keys, "left").withColumn("reason", reason).where("reason is not null").select("ordinal", *keys, "reason")


def apply_hs(psi: DataFrame, file: DataFrame, keys: tuple[str, ...] = ("product_type", "retailer", "rank")) -> tuple[DataFrame, DataFrame]:
    """Customs codes by the place of a product; returns the products and the file's rows that had no effect, with the reason."""
    return _with_codes(psi, file, list(keys)), _misses(psi, file, list(keys))


def apply_hs_by_sku(ih: DataFrame, file: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _with_codes(ih, file, ["sku_name"]), _misses(ih, file, ["sku_name"])


def enrich_snapshot(snapshot: DataFrame, brands: DataFrame, codes: DataFrame, origins: DataFrame) -> DataFrame:
    """A crawl snapshot with what the caches know of its brands, names and URLs, by normalized keys."""
    keyed = snapshot.withColumns({"brand_key": x.brand_key(F.col("brand")), "name_key": x.name_key(F.col("title")), "url_hash": x.text_hash(F.col("url"))})
    return keyed.join(brands, "brand_key", "left").join(codes, "name_key", "left").join(origins, "url_hash", "left")


def embedding_backlog(products: DataFrame, emb: DataFrame, model: str, retry_failed: bool = False) -> DataFrame:
    """Products whose current text has no finished embedding of a model; failed ones are left out unless they are to be tried again."""
    text = x.product_text(F.col("sku_name"), F.col("mc"), F.col("category"))
    hashed = products.withColumn("text_hash", x.text_hash(text))
    have = emb.where(F.col("model") == model).withColumn("text_hash", x.text_hash(text))
    done = have if not retry_failed else have.where("status <> 'failed'")
    return hashed.join(done.select("text_hash").distinct(), "text_hash", "left_anti")


def sample_order(df: DataFrame, mode: str, key: str = "sku_name", terms: list[str] | None = None, popularity: str = "popularity") -> DataFrame:
    """Orders for work lists: plain, random (by a digest of the key), terms first, popular first."""
    some = F.lit(False)
    for t in terms or []:
        some = some | F.contains(F.lower(key), F.lit(t.lower()))
    orders = {"plain": [key], "random": [F.md5(F.col(key)), key], "terms": [some.desc(), key], "popular": [F.desc_nulls_last(popularity), key]}
    return df.orderBy(*orders[mode])


#: Prices closer than this are one price.
SAME_PRICE = 0.005


def _pair(cards: pd.DataFrame, raw: pd.DataFrame, near: float) -> pd.DataFrame:
    """The pairs of one key, each card in turn. Unused rows wait in a queue for each price and in one for all, so a card looks at the prices near its own only."""
    cards, raw = cards.sort_values(["card_id", "price"], kind="stable"), raw.sort_values(["raw_id", "price"], kind="stable")
    ids, used, first = raw["raw_id"].to_numpy(), np.zeros(len(raw), bool), 0
    waiting: dict[int, dict[float, deque[int]]] = {}
    for at, price in enumerate(raw["price"]):
        if np.isfinite(price):
            waiting.setdefault(math.floor(price / near), {}).setdefault(price, deque()).append(at)
    out = []
    for card, price in zip(cards["card_id"], cards["price"]):
        heads = []
        if np.isfinite(price):
            cell = math.floor(price / near)
            for c in (cell - 1, cell, cell + 1):
                for other, queue in waiting.get(c, {}).items():
                    while queue and used[queue[0]]:
                        queue.popleft()
                    if queue and abs(other - price) < near:
                        heads.append(queue[0])
        while first < len(ids) and used[first]:
            first += 1
        if not heads and first == len(ids):
            continue
        at = min(heads) if heads else first
        used[at] = True
        out.append((card, ids[at], "price" if heads else "order"))
    return pd.DataFrame(out, columns=["card_id", "raw_id", "by"])


def pair_cards(cards: DataFrame, raw: DataFrame, keys: tuple[str, ...] = ("product_type", "retailer", "brand_en"), near: float = SAME_PRICE) -> DataFrame:
    """Pair each card with one raw row of its keys: (card_id, raw_id, by). A row is used once.

    The cards of a key come in the order of their ids; each takes the first unused row whose price is nearer than ``near`` (``by`` is ``price``), else the
    first unused row at all (``order``), which may be one that a later card's price would have matched. So the pairs of one key follow from each other
    and are made in one task, from ids and prices alone; a key is a retailer's brand within one list, and a list can't outgrow a worksheet (1,048,576
    rows). Rows with a null or blank key pair with nothing, a missing price equals none, and repeated ids count as rows of their own.
    """
    there = reduce(and_, [F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) != "" for k in keys])
    of = lambda d, i: d.where(there).select(*keys, F.col(i).cast("long").alias(i), F.col("price_usd").cast("double").alias("price")).groupBy(*keys)
    return of(cards, "card_id").cogroup(of(raw, "raw_id")).applyInPandas(lambda c, r: _pair(c, r, near), "card_id long, raw_id long, by string")


def mark_members(full: DataFrame, members: DataFrame, keys: list[str], to: str = "is_oem") -> DataFrame:
    """Mark the rows that occur in another table by a tuple of columns, blank and null being one."""
    plain = lambda d: [F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")).alias(f"__{k}") for k in keys]
    have = members.select(*plain(members)).distinct().withColumn(to, F.lit(True))
    marked = full.select("*", *plain(full)).join(have, [f"__{k}" for k in keys], "left")
    return marked.withColumn(to, F.coalesce(to, F.lit(False))).drop(*[f"__{k}" for k in keys])


def map_mc(df: DataFrame, mapping: DataFrame, item: str) -> DataFrame:
    return df.join(mapping.groupBy(item).agg(F.min("mc").alias("mc")), item, "left")


def amount_weight(amounts: DataFrame, weights: DataFrame) -> DataFrame:
    return amounts.join(weights, ["country", "item_name"], "left")


def supplement(base: DataFrame, sf: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates of a period with the contact data of the whole history, on the full key."""
    return null_safe_join(base, sf.select(*keys, "homepage", "oem_status"), keys)


def already_known(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return keys.join(cache.select(key), key, "left_semi")


def not_yet_known(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return keys.join(cache.select(key), key, "left_anti")


def missing_embeddings(products: DataFrame, emb: DataFrame) -> DataFrame:
    """Products without a finished embedding, by the keys of the vector table."""
    keys = ["sku_name", "mc", "category"]
    have = emb.where("status = 'completed'").select(*[x.vector_key(F.col(k)).alias(f"v_{k}") for k in keys]).distinct()
    keyed = products.withColumns({f"v_{k}": x.vector_key(F.col(k)) for k in keys})
    return keyed.join(have, [f"v_{k}" for k in keys], "left_anti").drop(*[f"v_{k}" for k in keys])


def apply_email_results(ih: DataFrame, results: DataFrame, now: datetime.date) -> DataFrame:
    """Found addresses by manufacturer and factory, and country where the result has one: fill only what is empty, name the source, date every attempt."""
    once = results.groupBy("manufacturer", "factory", "country").agg(F.max_by("found_email", "ordinal").alias("found"))
    exact = null_safe_join(ih.select("manufacturer", "factory", "country").distinct(), once.where("country is not null"), ["manufacturer", "factory", "country"])
    broad = once.where("country is null").select("manufacturer", "factory", F.col("found").alias("found_any"), F.lit(True).alias("tried_any"))
    tried = once.where("country is not null").select("manufacturer", "factory", "country", F.lit(True).alias("tried"))
    keys = null_safe_join(null_safe_join(exact, broad, ["manufacturer", "factory"]), tried, ["manufacturer", "factory", "country"])
    keys = keys.select("manufacturer", "factory", "country", F.coalesce("found", "found_any").alias("found"), F.coalesce("tried", "tried_any").alias("tried"))
    out = null_safe_join(ih, keys, ["manufacturer", "factory", "country"])
    empty = F.coalesce(F.trim("email"), F.lit("")) == ""
    fill = empty & F.col("found").isNotNull()
    return out.withColumns({"email_source": F.when(fill, "crawl"), "email_tried_at": F.when(F.col("tried"), F.lit(now)), "email": F.when(fill, F.col("found")).otherwise(F.col("email"))}).drop("found", "tried")


def apply_group_keys(psi: DataFrame, assigned: DataFrame) -> DataFrame:
    """Group keys for rows that have none yet, as slugs, by id."""
    once = assigned.groupBy("id").agg(F.max_by(F.struct(x.slug(F.col("brand_group_key")).alias("b"), x.slug(F.col("product_group_key")).alias("p")), "ordinal").alias("k"))
    waiting = F.col("product_group_key").isNull()
    return psi.join(once, "id", "left").withColumns({
        "brand_group_key": F.when(waiting, F.coalesce("k.b", "brand_group_key")).otherwise(F.col("brand_group_key")),
        "product_group_key": F.when(waiting, F.col("k.p")).otherwise(F.col("product_group_key")),
    }).drop("k")


