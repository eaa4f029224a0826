"""Operator 11: token ids in flat files, document boundaries in Elias-Fano code.

A file holds the ids of consecutive documents in a row, in as few bytes an id as the vocabulary needs, then the boundaries
between documents and their doc_ids, both as Elias-Fano code: the low bits of each value side by side, the high bits in unary,
and the place of every STEP-th value for selection. Any document is found by reading a few bytes; there is no table of 64-bit
offsets. Spark deals the documents out by ranges of doc_id, each task writes its range as files of bounded size, and a task
that is run again writes the same files again.

File: ids | low, high and marks of the boundaries | low, high and marks of the doc_ids | footer (FOOTER, little-endian).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from importlake.llm.common import arrow_rows, portions, shared_folder, stage
from importlake.llm.encoding import byte_level

MAGIC = b"IDSEFv01"
#: Bytes of an id, documents with an id, documents without, ids, least doc_id; number of values, low bits and bytes of low, high and marks of either code; magic.
FOOTER = struct.Struct("<QQQQq" + "QQQQQ" * 2 + "8s")
#: One value in so many has its place noted.
STEP = 256
MANIFEST = "file string, n_docs long, n_ids long"


@dataclass
class Code:
    """Sorted numbers from 0 in Elias-Fano code: ``n`` values of ``bits`` low bits each; bytes come from ``read(at, size)``."""

    n: int
    bits: int
    sizes: tuple[int, int, int]
    read: Callable[[int, int], bytes]

    @staticmethod
    def pack(values: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
        """(n, bits, low, high, marks) of values that never fall."""
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        if n and places[-1] >= 1 << 32:
            raise ValueError("too many values for one file")
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::STEP].astype("<u4").tobytes()

    def select(self, begin: int, end: int) -> np.ndarray:
        """The values with numbers from ``begin`` to before ``end``. It reads their bytes and, of the high bits, at most STEP values more at either end."""
        if begin >= end:
            return np.zeros(0, np.int64)
        low_size, high_size, marks_size = self.sizes
        first = begin // STEP
        marks = np.frombuffer(self.read(low_size + high_size + 4 * first, min(marks_size, 4 * ((end - 1) // STEP + 2)) - 4 * first), "<u4")
        start, stop = int(marks[0]) // 8, int(marks[-1]) // 8 + 1 if (end - 1) // STEP + 1 < marks_size // 4 else high_size
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.read(low_size + start, stop - start), np.uint8), bitorder="little")) + 8 * start
        ones = ones[np.searchsorted(ones, int(marks[0])) :][begin - first * STEP : end - first * STEP]
        values = ones - np.arange(begin, end)
        if self.bits:
            at = begin * self.bits
            packed = np.frombuffer(self.read(at // 8, (end * self.bits + 7) // 8 - at // 8), np.uint8)
            low = np.unpackbits(packed, bitorder="little")[at % 8 :][: (end - begin) * self.bits].reshape(-1, self.bits)
            values = (values << self.bits) | (low.astype(np.int64) << np.arange(self.bits)).sum(1)
        return values


class Writer:
    """One file at a time, under a name of its own until it is whole."""

    def __init__(self, folder: str, kind: np.dtype):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.kind, self.done, self.file = kind, [], None
        self.fs.create_dir(self.folder)

    def open(self, name: str) -> None:
        self.name, self.hidden = name, f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        self.file, self.ends, self.doc_ids, self.nulls, self.n = self.fs.open_output_stream(self.hidden), [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.file.write(ids)
        self.n += len(ids) // self.kind.itemsize
        self.ends.append(self.n)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self) -> None:
        ends, own = np.array(self.ends, np.int64), np.array(self.doc_ids, np.int64)
        least = int(own[0]) if len(own) else 0
        # As unsigned numbers, so that the distance of any two longs fits.
        codes = [Code.pack(ends), Code.pack(own.view(np.uint64) - np.int64(least).view(np.uint64))]
        for _, _, *parts in codes:
            for p in parts:
                self.file.write(p)
        said = [x for n, bits, *parts in codes for x in (n, bits, *map(len, parts))]
        self.file.write(FOOTER.pack(self.kind.itemsize, len(own), self.nulls, self.n, least, *said, MAGIC))
        self.file.close()
        self.fs.move(self.hidden, f"{self.folder}/{self.name}")  # a second run of the task puts the same file in its place
        self.done.append((self.name, len(ends), self.n))
        self.file = None


class Reader:
    """A file of ids, read at places."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        at, path = fs.FileSystem.from_uri(folder)
        self.file = at.open_input_file(f"{path}/{name}")
        size = self.file.size()
        width, self.n_own, self.nulls, self.n_ids, self.least, *said, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no file of ids")
        self.kind = np.dtype(f"<u{width}")
        at, codes = width * self.n_ids, []
        for n, bits, *sizes in (said[:5], said[5:]):
            codes.append(Code(n, bits, tuple(sizes), lambda k, size, at=at: self.read(at + k, size)))
            at += sum(sizes)
        self.ends, self.own = codes

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at) if size else b""

    def bounds(self, begin: int, end: int) -> np.ndarray:
        """Where the documents from ``begin`` to before ``end`` start, and where the last one ends."""
        ends = self.ends.select(max(begin - 1, 0), end)
        return ends if begin else np.concatenate([[0], ends])

    def doc_ids(self, begin: int, end: int) -> list[int | None]:
        nulls = max(0, min(end, self.nulls) - begin)
        own = self.own.select(max(begin - self.nulls, 0), max(end - self.nulls, 0))
        return [None] * nulls + (own + self.least).tolist()

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids with numbers from ``begin`` to before ``end``."""
        return np.frombuffer(self.read(begin * self.kind.itemsize, (end - begin) * self.kind.itemsize), self.kind)

    def close(self) -> None:
        self.file.close()


def write(
    docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, most_docs: int = 1 << 20, most_ids: int = 1 << 27
) -> DataFrame:
    """Write the ids of each whole text, ``end_id`` behind them, into files in ascending order of ``id_col``; (file, n_docs, n_ids) of the files.

    A null text counts as empty: its ids are the end id alone. A null id comes first. Rows of one id are ordered by a hash of their
    text, and repeated rows are written again each. A text is written whole, however long. An empty table gives no file.
    ``docs`` may have columns of any name besides the two. A file is closed at ``most_docs`` documents or ``most_ids`` ids; its
    boundaries are all that a task holds. Files are named by range and number, so their names sort like the documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = byte_level(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], known.kind).tobytes()
        out = Writer(folder, known.kind)
        for b in batches:
            own = iter(b.column("doc_id").to_pylist())
            for texts in portions(b.column("text").to_pylist()):
                for ids in known.texts(texts):
                    if out.file is None:
                        out.open(f"ids-{part:07d}-{len(out.done):05d}")
                    out.add(next(own), ids + end)
                    if len(out.ends) >= most_docs or out.n >= most_ids:
                        out.close()
        if out.file is not None:
            out.close()
        yield pa.RecordBatch.from_pylist([{"file": f, "n_docs": n, "n_ids": m} for f, n, m in out.done], pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    with arrow_rows(spark, 500):
        return stage(dealt.mapInArrow(files, MANIFEST), "token-files")


def read(spark: SparkSession, folder: str, files: DataFrame, block: int = 2048) -> DataFrame:
    """(doc_id, start, ids) of each document in the files, ``start`` being the number of ids before it in all files; ids as an array of longs.

    ``files`` is the table that ``write`` gives. Tasks read blocks of documents at their places; an empty document has its
    end id only. No file gives an empty result.
    """
    return _blocks(spark, folder, files, block, "ids array<long>", lambda ids, cuts: {"ids": np.split(ids.astype(np.int64), cuts[1:-1])})


def checks(spark: SparkSession, folder: str, files: DataFrame, block: int = 2048) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: the crc32 of its ids as unsigned 32-bit numbers."""

    def of(ids: np.ndarray, cuts: np.ndarray) -> dict:
        wide = ids.astype("<u4")
        return {"n_tokens": np.diff(cuts), "ids_crc32": [zlib.crc32(wide[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]}

    return _blocks(spark, folder, files, block, "n_tokens long, ids_crc32 long", of)


def _blocks(spark: SparkSession, folder: str, files: DataFrame, block: int, kind: str, of: Callable[[np.ndarray, np.ndarray], dict]) -> DataFrame:
    # One row for each file comes to the driver, as in any listing of files.
    base, rows = 0, []
    for f in files.orderBy("file").collect():
        rows.append((f["file"], f.n_docs, base))
        base += f.n_ids
    listed = spark.createDataFrame(rows, "file string, n_docs long, base long")
    blocks = listed.select("file", "base", "n_docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(block).cast("long"))).alias("begin"))

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, base, n, begin in zip(b["file"], b["base"], b["n_docs"], b["begin"]):
                r = Reader(folder, name)
                bounds, own = r.bounds(begin, min(n, begin + block)), r.doc_ids(begin, min(n, begin + block))
                for i, j in _runs(bounds):
                    cuts = bounds[i : j + 1]
                    more = of(r.ids(int(cuts[0]), int(cuts[-1])), cuts - cuts[0])
                    yield pd.DataFrame({"doc_id": pd.array(own[i:j], "Int64"), "start": cuts[:-1] + base} | {k: pd.Series(v) for k, v in more.items()})
                r.close()

    return blocks.repartition(F.col("file"), F.col("begin")).mapInPandas(ids, f"doc_id long, start long, {kind}")


def _runs(bounds: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Documents in runs of about ``most`` ids, one at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"

