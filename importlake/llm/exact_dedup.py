"""Operator 5: exact deduplication as a stream with keyed state on disk.

A streaming aggregation holds, for each digest of a normalised text, how many rows had it, the largest id and where that
row's content lies. The state is kept by RocksDB on the executors' disks, is saved to the shared folder after each batch
and never expires. Rows are aggregated before they are shuffled, so a text that a third of all rows share costs a row
for each task. Rows whose digest was met more than once are then checked byte by byte against the content of the row
that stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from importlake.llm.common import lower_ascii, shared_folder, sieve, stage


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: Column) -> Column:
    """A-Z in lower case; null counts as empty."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def located(id_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def digest_state(
    spark: SparkSession, path: str, id_col: str, text_col: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = 64 << 30
) -> DataFrame:
    """Run the stream over the Parquet files of ``path`` and return its final state (digest, rows, keep).

    ``keep`` holds the largest id and the locator (file, row in the file) of the content that has it.

    ``path`` is a folder or a single file. ``batch_bytes`` bounds a micro-batch. The stream runs in a session of its
    own, so that its settings don't reach the caller's.
    """
    schema = spark.read.parquet(path).schema
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes"):
        if (value := spark.conf.get(key, None)) is not None:
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "300")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Else each state partition holds 4 MB of preallocated space, however little state it has.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.streaming.stateStore.minDeltasForSnapshot", "10")
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    found = f"{where}/found"
    rows = own.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{path[:-1]}[{path[-1]}]")
    state = (
        rows.select(digest(normalised(F.col(text_col))).alias("digest"), located(id_col).alias("at"))
        .groupBy("digest")
        .agg(F.count("*").alias("rows"), F.max("at").alias("keep"))
    )

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{found}/batch={number}")

    query = (
        state.writeStream.outputMode("update").option("checkpointLocation", f"{where}/checkpoint").foreachBatch(save)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    empty = spark.createDataFrame([], state.schema)
    try:
        seen = spark.read.schema(state.schema).parquet(found)
    except Exception as error:  # no file was there to read, so no batch ran
        if "PATH_NOT_FOUND" not in str(error):
            raise
        seen = empty
    # A digest is written again by each batch that meets it; counts and ids only rise.
    return stage(seen.groupBy("digest").agg(F.max("rows").alias("rows"), F.max("keep").alias("keep")), "digests")


def deduplicate(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batch_bytes: int = 64 << 30
) -> DataFrame:
    """Return a row for each row of ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. Of equal texts the row with the
    largest id stays; rows that share that id too are told apart by their place in the files, so exactly one stays, and
    a null id gives way to any other. Should two texts share a digest, the byte check sets those apart that differ from
    the content at the state's locator, and they are grouped again by the text itself. An empty table gives an empty result.
    """
    state = digest_state(spark, path, id_col, text_col, digest, batch_bytes)
    text = normalised(F.col(text_col))
    docs = spark.read.parquet(path).select(located(id_col).alias("at"), text.alias("text"), digest(text).alias("digest"), sha256(text).alias("sha"))
    met = state.where("rows > 1")
    passes = sieve(met.select(F.xxhash64("digest"))).asNondeterministic()  # so that it is asked of the digest, not of the text once more
    hits = stage(docs.where(passes(F.xxhash64("digest"))).join(met, "digest").select("digest", "at", "text", "keep", "rows"), "hits")
    content = hits.where("at <=> keep").select("digest", F.col("text").alias("content"))
    checked = stage(
        hits.join(content, "digest").select("digest", "at", F.when(F.col("text") != F.col("content"), F.col("text")).alias("other")), "checked"
    )
    strays = stage(
        checked.where("other is not null").groupBy("digest", "other").agg(F.max("at").alias("keep"), F.count("*").alias("rows")), "strays"
    )
    lost = strays.groupBy("digest").agg(F.sum("rows").alias("lost"))
    settled = stage(
        state.join(lost, "digest", "left").select("digest", "keep", (F.col("rows") - F.coalesce("lost", F.lit(0))).alias("rows")), "settled"
    )
    narrow = docs.select("at", "digest", "sha")
    out = narrow.join(settled, "digest", "left")
    if not strays.isEmpty():
        apart = checked.where("other is not null").join(strays, ["digest", "other"]).select("at", F.col("keep").alias("keep2"), F.col("rows").alias("rows2"))
        out = out.join(stage(apart, "apart"), "at", "left").withColumns({"keep": F.coalesce("keep2", "keep"), "rows": F.coalesce("rows2", "rows")})
    return out.select(
        F.col("at.id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("rows").alias("group_size"),
        F.col("at").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
    )
