"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folders of staged tables that are still in use.
STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Slots of a sieve: its size, whatever it is made from.
SLOTS = 1 << 22


def portions(texts: Iterable[str | None], letters: int = 1_000_000) -> Iterator[list[str | None]]:
    """Consecutive texts in lists of about ``letters`` letters, so that what is derived from a batch isn't held all at once."""
    part: list[str | None] = []
    n = 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= letters:
            yield part
            part, n = [], 0
    if part:
        yield part


@contextmanager
def setting(spark: SparkSession, key: str, value: str | int) -> Iterator[None]:
    """What runs inside has a setting of the session changed; it is put back."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """What runs inside gets Arrow batches of ``rows`` rows, for columns that hold much."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shuffle_freed(spark: SparkSession):
    """What is written inside has its shuffle files removed when it is done, as nothing else reads them."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the one that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session in one process gets a temporary folder, and a session on a cluster an error, as no
    folder of one machine would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table into the shared folder, in folders ``by`` a column if one is named, and read it again, which cuts the lineage.

    A lost executor then costs a re-read of the files, and whatever joins the result sees a plain scan, whose shuffle
    adaptive execution can split when one key is hot. Shuffle files go when the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
    with shuffle_freed(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    STAGED[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        if path := STAGED.pop(t, None):
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bitmap(hashes: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """A bit for each of ``slots`` slots, a power of two, set where one of ``hashes`` (one column of longs) falls; Spark puts it together."""
    slot = F.pmod(F.col(hashes.columns[0]), F.lit(slots))
    # ``shiftleft`` counts modulo 64.
    words = hashes.select(F.shiftright(slot, 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.cast("int")).alias("bit"))
    bits, found = np.zeros(slots // 64, np.int64), words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return bits


def sieve(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test for a hash that holds for all in ``hashes`` (one column of longs) and, while they are few, for few others.

    It is a bitmap of SLOTS slots, put together by Spark, so its size is fixed. What passes goes on to an exact join; what doesn't is
    spared the shuffle. If the hashes outgrow the slots everything passes, and the join does all the work.
    """
    shared = hashes.sparkSession.sparkContext.broadcast(bitmap(hashes))

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        at = h.to_numpy() % SLOTS
        return pd.Series((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return passes


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, parts: int) -> Column:
    """The remainder of crc32(doc_id as text) by ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def sample_share(rows: int, bound: int) -> float:
    """The share of ``rows`` that keeps about ``bound`` of them."""
    return 1.0 if rows <= bound else bound / rows


def in_sample(key: Column, share: float, seed: int = 7) -> Column:
    """A sample by a hash of the key, so that it doesn't hang on how the rows are dealt out. It resolves shares down to one of 2^62 rows."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1 << 62)) < F.lit(int(share * (1 << 62)))
