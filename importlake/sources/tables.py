"""Table maintenance: upserts, replacement with keys carried over, snapshots, materialized aggregates."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators import history as h
from importlake.sources import versions
from importlake.sources.staging import discard, staged


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str, insert_only: bool = False) -> DataFrame:
    """The target with the updates merged by key; of updates alike in the key the last (by ``order``) counts. ``insert_only`` leaves present keys as they are."""
    columns = [c for c in target.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("u")).select(*keys, "u.*")
    if insert_only:
        fresh = h.null_safe_join(last, target.select(*keys).distinct().withColumn("__old", F.lit(1)), keys).where("__old is null").drop("__old")
        return target.unionByName(fresh)
    kept = h.null_safe_join(target, last.select(*keys).withColumn("__new", F.lit(1)), keys).where("__new is null").drop("__new")
    return kept.unionByName(last.select(*target.columns))


def replace_with_carryover(new: DataFrame, old: DataFrame, identity: list[str], carried: list[str]) -> DataFrame:
    """A new load that takes over some columns from the previous one's rows of the same identity; a value of its own comes first."""
    once = old.groupBy(*identity).agg(*[F.min(c).alias(f"__{c}") for c in carried])
    joined = h.null_safe_join(new, once, identity)
    for c in carried:
        joined = joined.withColumn(c, F.coalesce(c, f"__{c}") if c in new.columns else F.col(f"__{c}"))
    return joined.drop(*[f"__{c}" for c in carried])


def append_snapshot(rows: DataFrame, run_id: str, labels: list[str] | None = None) -> DataFrame:
    """A run's rows as they are appended: without the retailers' own brands, the size from the name where none is given, the run's id."""
    kept = rows.where(~x.is_private_label(F.col("brand"), F.col("title"), labels))
    size = x.extract_unit(F.col("title"))
    return kept.withColumns({"unit": F.coalesce(x.blank_to_null(F.col("unit")), size) if "unit" in rows.columns else size, "run_id": F.lit(run_id)})


def write_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def load_snapshot(rows: DataFrame, items: str, runs: str, run_id: str, run_at: datetime.datetime, site_scope: str, note: str | None = None, labels: list[str] | None = None) -> int:
    """Write a run's rows to ``items``, then its line (time, scope, note, rows kept) to ``runs``; returns the rows kept, counted as they are written.

    A run without a line has not been loaded whole. Loading a run again replaces its rows and its line, unless no row is left to write, which leaves
    the rows of before.
    """
    seen = Observation()
    kept = append_snapshot(rows, run_id, labels).observe(seen, F.count(F.lit(1)).alias("rows"))
    put = lambda df, path: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    put(kept, items)
    n = seen.get["rows"]
    line = rows.sparkSession.range(1).select(*[F.lit(v).cast(t).alias(c) for c, v, t in (("run_id", run_id, "string"), ("run_at", run_at, "timestamp"), ("site_scope", site_scope, "string"), ("note", note, "string"), ("row_count", n, "long"))])
    put(line, runs)
    return n


def refresh(ih: DataFrame, out: str, as_of: datetime.date) -> int:
    """Write the three aggregates and the distinct values of the filter columns as one version, which readers see when all four are there.

    The records are read once: the groups of the SKU history have all that the factories, the market status and the filter values follow from. Records
    dealt out by keys that all these share, as ``Tables.ih_dealt``, are not shuffled here.
    """
    spark, folder = ih.sparkSession, versions.new_version(out)
    groups = staged(h.whole_groups(h.sku_groups(ih, as_of)))
    groups.drop("homepage", "oem_status", "of_factory", "of_market").write.parquet(f"{folder}/sku_history")
    h.marked_factories(groups).write.parquet(f"{folder}/sku_factory")
    h.marked_status(groups).write.parquet(f"{folder}/market_status")
    facet_lists(groups).write.parquet(f"{folder}/facets")
    discard(groups)
    return versions.commit(spark, out, {"folder": folder})


def facet_lists(ih: DataFrame, columns: tuple[str, ...] = ("category", "mc", "importer", "country", "import_type")) -> DataFrame:
    """(column, value) of all filter columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("p")
    return ih.select(pairs).select("p.*").where("value is not null").distinct()


def set_by_key(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """One column replaced for all rows whose key has an update."""
    once = updates.groupBy(key).agg(F.max(column).alias("__v"), F.lit(True).alias("__hit"))
    return df.join(once, key, "left").withColumn(column, F.when(F.col("__hit"), F.col("__v")).otherwise(F.col(column))).drop("__v", "__hit")


def drop_rows(df: DataFrame, test: Column) -> DataFrame:
    """All rows but those that pass a test, as those of a stale model."""
    return df.where(~F.coalesce(test, F.lit(False)))
