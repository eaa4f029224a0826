"""Versions of a folder of tables, of which readers see the last whole one.

A version is written beside the others and then named by a commit: one small file, numbered, that is made whole or not at all
and never replaced. A writer that fails before its commit leaves what readers see as it was; of two that commit at once, one takes
the next number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, out: str) -> list[int]:
    fs, at = _files(spark, f"{out}/commits")
    if not fs.exists(at):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit())


def new_version(out: str) -> str:
    """A folder of its own for a version that nobody sees yet."""
    return f"{out}/version-{uuid.uuid4().hex}"


def commit(spark: SparkSession, out: str, said: dict) -> int:
    """Make ``said`` what readers see from now on; the number of the commit."""
    text = bytearray(json.dumps(said).encode())
    fs, hidden = _files(spark, f"{out}/commits/.{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    stream.write(text)
    stream.close()
    number = max(_numbers(spark, out), default=0) + 1
    # A rename doesn't replace a file that is there.
    while fs.exists(target := _files(spark, f"{out}/commits/{number}")[1]) or not fs.rename(hidden, target):
        number += 1
    return number


def current(spark: SparkSession, out: str) -> dict | None:
    """What the last commit says, or nothing before the first."""
    numbers = _numbers(spark, out)
    if not numbers:
        return None
    return json.loads(spark.read.text(f"{out}/commits/{numbers[-1]}").first()[0])


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the current version."""
    return spark.read.parquet(f"{current(spark, out)['folder']}/{name}")
