"""Tables that a plan reads several times, written once into the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: The folders of staged tables that are still in use.
STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. A session in one process may go without and gets a temporary one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """The table, written and read again: what comes after sees a plain scan instead of the plan that made it. Its shuffle files go when it is written."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}", spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    out = spark.read.schema(df.schema).parquet(path)
    STAGED[out] = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    if path := STAGED.pop(table, None):
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
