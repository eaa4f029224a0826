"""Incremental ingest and counts of streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from importlake.operators import history as h
from importlake.sources import versions

PARTIAL_KEYS = h.SKU_KEYS


def as_glob(path: str) -> str:
    """A pattern that only the path itself matches, as a single file is no source for a stream but a pattern is."""
    return f"{path[:-1]}[{path[-1]}]"


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(as_glob(path))


def partial_history(ih: DataFrame) -> DataFrame:
    """What of a batch of records can be merged with other batches, at the grain of the SKU history: counts add up, dates and texts combine by least and largest.

    The importer and the import type are keys, so market status and the sets of the factories follow from merged parts too.
    """
    day = h.effective_date()
    return ih.groupBy(*PARTIAL_KEYS).agg(
        F.count("*").alias("import_count"), F.min("email").alias("email"), F.min(day).alias("first_import"), F.max(day).alias("latest_import"), F.max("hs_code").alias("hs_code"),
        F.min("homepage").alias("homepage"), F.max("oem_status").alias("oem_status"),
    )


def merge_history(parts: DataFrame) -> DataFrame:
    """The history of all batches from their parts."""
    return parts.groupBy(*PARTIAL_KEYS).agg(
        F.sum("import_count").alias("import_count"), F.min("email").alias("email"), F.min("first_import").alias("first_import"), F.max("latest_import").alias("latest_import"), F.max("hs_code").alias("hs_code"),
        F.min("homepage").alias("homepage"), F.max("oem_status").alias("oem_status"),
    )


def start_ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Clean new records, append them, and write their part of the history, a folder for each batch, so that a batch that is run again replaces its own output."""

    def batch(rows: DataFrame, number: int) -> None:
        clean = transform(rows)
        clean.write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        done = rows.sparkSession.read.parquet(f"{out}/records/batch={number}")
        partial_history(done).write.mode("overwrite").parquet(f"{out}/parts/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_history(spark: SparkSession, out: str) -> DataFrame:
    """The parts of all batches, merged: those since the last compaction with what it left."""
    parts, base = spark.read.parquet(f"{out}/parts"), versions.current(spark, out)
    if base is None:
        return merge_history(parts.drop("batch"))
    return merge_history(parts.where(F.col("batch") > base["through"]).drop("batch").unionByName(spark.read.parquet(base["folder"])))


def compact(spark: SparkSession, out: str) -> int:
    """Merge the parts so far into one table, which takes their place for readers once it is whole; the last batch that it has.

    What a refresh reads then follows the number of groups and the batches since, not all batches that ever came.
    """
    through = spark.read.parquet(f"{out}/parts").agg(F.max("batch")).first()[0]
    folder = versions.new_version(out)
    merged_history(spark, out).write.parquet(folder)
    versions.commit(spark, out, {"folder": folder, "through": through})
    return through


def refresh_history(spark: SparkSession, out: str) -> DataFrame:
    """The SKU history of what has been ingested, with its market status, which follows from the importers."""
    return h.with_market_status(merged_history(spark, out)).drop("homepage", "oem_status")


def refresh_market(spark: SparkSession, out: str) -> DataFrame:
    """The market status of what has been ingested."""
    return h.market_status(merged_history(spark, out))


def refresh_factories(spark: SparkSession, out: str) -> DataFrame:
    """The factories of what has been ingested."""
    return h.factories_of_groups(merged_history(spark, out))


def stream_counts(stream: DataFrame, time: str, keys: list[str], window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts of tumbling windows; rows later than ``delay`` behind the newest are dropped."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return counted.select(F.col("w.start").alias("window_start"), *keys, "n", "value")


def stream_dedupe(stream: DataFrame, time: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def start_late(stream: DataFrame, time: str, out: str, checkpoint: str, window: str = "1 day", delay: str = "1 day") -> StreamingQuery:
    """Keep what ``stream_counts`` with the same window and delay drops: rows whose window had been closed when they came.

    A batch notes its newest time; the watermark of a batch is the newest time of those before it less the delay, as in
    Spark's own. A folder for each batch, so one that is run again replaces its own rows.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if number == 0:
            mark = F.lit(None).cast("timestamp")
        else:
            newest = spark.read.schema("newest timestamp, batch long").parquet(f"{out}/newest").where(F.col("batch") < number).agg(F.max("newest")).first()[0]
            mark = F.lit(newest) - F.expr(f"interval {delay}")
        late = rows.where(F.window(time, window)["end"] <= F.date_trunc("millisecond", mark))
        late.write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        rows.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{out}/newest/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Groups of rows that a finished query's stateful operators dropped as late."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def append_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all that is there and append to Parquet; the finished query. Called again, it goes on from its checkpoint, watermark and state included."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, write Parquet, and read it."""
    append_to_end(stream, out, checkpoint, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
