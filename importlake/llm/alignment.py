"""Operator 12: alignment of two tokenizers over the same bytes.

The tokens of either side end at increasing byte offsets, and aligning them is merging the two lists of ends. The merge path
through both is cut where it meets evenly spaced diagonals, found by binary search, so that every piece has the same number of
ends to merge and none waits for another; the pieces are lanes of one array program and emit the overlapping pairs. Places
where both ends fall together close a group; what a piece leaves open goes on in the next, so the pieces' groups are numbered
through by a running sum of closed groups. The pairs of each document then meet their counts over all documents: the commonest
in a table of bounded size, all others in a join.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from importlake.llm.common import arrow_rows, portions, stage
from importlake.llm.encoding import CUT, ByteLevel, Chunks, SentencePieces, spelled

#: Ends that a piece merges.
WORK = 512


def pieces(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, until) for each piece: the first token of either side, and the diagonal i + j at which the next piece begins.

    A point of the merge path has all ends of ``a[:i]`` and ``b[:j]`` behind it, those of ``a`` first where they are alike. An end
    that both sides share belongs to the piece in which the first of the two falls.
    """
    n, m = len(a), len(b)
    d = np.arange(0, n + m, work)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (searching := low < high).any():
        mid = (low + high) // 2
        first = searching & (a[np.minimum(mid, n - 1)] <= b[np.clip(d - mid - 1, 0, m - 1)])
        low, high = np.where(first, mid + 1, low), np.where(searching & ~first, mid, high)
    i, j = low, d - low
    j = j + ((i > 0) & (j < m) & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, m - 1)]))
    return i, j, np.minimum(d + work, n + m)


@dataclass
class Overlaps:
    """Tokens ``i`` of one side and ``j`` of the other whose bytes overlap, in order, and the number of the group of each token."""

    i: np.ndarray
    j: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def merge(a: np.ndarray, b: np.ndarray, work: int = WORK) -> Overlaps:
    """Merge the ends ``a`` and ``b`` of tokens of at least one byte; both lists rise and have the same last end.

    All pieces go through their ends at the same time, a step of each at once.
    """
    n, m = len(a), len(b)
    if not n:
        none = np.zeros(0, np.int64)
        return Overlaps(none, none, none, none)
    i, j, until = pieces(a, b, work)
    pairs_i, pairs_j = np.full((work, len(i)), -1, np.int32), np.full((work, len(i)), -1, np.int32)
    lanes = np.flatnonzero(i + j < until)
    i, j, until = i[lanes], j[lanes], until[lanes]
    for step in range(work):
        if not len(lanes):
            break
        pairs_i[step, lanes], pairs_j[step, lanes] = i, j
        end_a, end_b = a[i], b[j]
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
        if not (on := i + j < until).all():
            lanes, i, j, until = lanes[on], i[on], j[on], until[on]
    # Stitching: every piece has counted its own closed groups; a token's group is the number of those closed before it, in all pieces.
    emitted = pairs_i.T >= 0
    at_i, at_j = pairs_i.T[emitted], pairs_j.T[emitted]
    closing = a[at_i] == b[at_j]
    closed_a, closed_b = np.zeros(n, bool), np.zeros(m, bool)
    closed_a[at_i[closing]], closed_b[at_j[closing]] = True, True
    return Overlaps(at_i, at_j, closed_a.cumsum() - closed_a, closed_b.cumsum() - closed_b)


def _checked(kind: type[Chunks]) -> type[Chunks]:
    """Chunks whose tokens don't spell them get no tokens, so that the lengths of a text with such a chunk don't add up."""

    class Checked(kind):
        def put(self, chunks, flat, ends):
            spell, want = self.bytes.__getitem__, list(map(self.spelled, chunks))
            got = list(map(spell, flat.tolist()))
            lengths = np.append(0, np.fromiter(map(len, got), np.int64, len(got)).cumsum())[np.append(0, ends)]
            if not np.array_equal(np.diff(lengths), list(map(len, want))) or b"".join(got) != b"".join(want):
                n = np.diff(ends, prepend=0)
                same = np.array([b"".join(got[e - k : e]) == w for e, k, w in zip(ends.tolist(), n.tolist(), want)], bool)
                flat, ends = flat[np.repeat(same, n)], (n * same).cumsum()
            super().put(chunks, flat, ends)

    return Checked


class A(_checked(ByteLevel)):
    def spelled(self, chunk: str) -> bytes:
        return spelled(chunk).encode()


class B(_checked(SentencePieces)):
    def spelled(self, chunk: str) -> bytes:
        return b" " + chunk.encode()


class Pair:
    """Both tokenizers, with what they have seen, and the parts of a rendering for each id."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = A(a_path, plain_specials=True, most=300_000), B(b_path, most=300_000)
        self.length_a, self.length_b = (np.array(list(map(len, x.bytes)), np.int64) for x in (self.a, self.b))
        self.pairs = self.a.size * self.b.size
        self.most = max(self.a.size, self.b.size)
        self.names = np.array([b"%d%s" % (i, end) for end in (b",", b"|", b";") for i in range(self.most)], object)


@functools.cache
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def of_texts(p: Pair, texts: list[str | None], digest: bool, work: int = WORK) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, pairs, times) of each text."""
    p.a.forget()
    p.b.forget()
    cut = [CUT.split(t) if t else [] for t in texts]  # with the space in front, no chunk is a first one
    flat = list(chain.from_iterable(cut))
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    sides = []
    for known, lengths in ((p.a, p.length_a), (p.b, p.length_b)):
        packed = known.of(flat)
        ids = np.frombuffer(b"".join(packed), known.kind).astype(np.int64)
        n = np.add.reduceat(np.append(np.fromiter(map(len, packed), np.int64, len(packed)), 0), np.append(0, counts.cumsum())[:-1]) * (counts > 0) // known.kind.itemsize
        sides.append([ids, lengths[ids], n])
    want = np.array([len((" " + t).encode()) if t else 0 for t in texts])
    whole = want > 0
    for ids, lengths, n in sides:
        whole &= np.bincount(np.repeat(np.arange(len(texts)), n), lengths, len(texts)) == want
    for s in sides:
        ids, lengths, n = s
        keep = np.repeat(whole, n)
        s[:] = ids[keep], lengths[keep].cumsum(), np.where(whole, n, 0)
    (ids_a, ends_a, n_a), (ids_b, ends_b, n_b) = sides
    o = merge(ends_a, ends_b, work)
    doc_a = np.repeat(np.arange(len(texts)), n_a)
    n_groups = np.zeros(len(texts), np.int64)
    if len(ids_a):
        first = np.append(True, o.group_a[1:] != o.group_a[:-1])
        n_groups = np.bincount(doc_a[first], minlength=len(texts))
    doc = doc_a[o.i]
    n_links = np.bincount(doc, minlength=len(texts))
    keys, times = np.unique(doc * p.pairs + ids_a[o.i] * p.b.size + ids_b[o.j], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(texts) + 1) * p.pairs).tolist()
    keys %= p.pairs
    texts_of = _renderings(p, ids_a, ids_b, o, n_a, n_b)
    out = []
    for k, groups in enumerate(texts_of):
        said = (hashlib.sha256(groups).hexdigest() if digest else groups.decode()) if whole[k] else ""
        out.append((int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), said, keys[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]]))
    return out


def _renderings(p: Pair, ids_a: np.ndarray, ids_b: np.ndarray, o: Overlaps, n_a: np.ndarray, n_b: np.ndarray) -> Iterator[bytes]:
    """The groups of each text: a1,a2|b1;a3|b2,b3."""
    if not len(ids_a):
        yield from [b""] * len(n_a)
        return
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (o.group_a, o.group_b))
    before_b = np.append(0, np.flatnonzero(last_b) + 1)  # tokens of b in front of each group
    through_a = np.flatnonzero(last_a) + 1  # tokens of a up to the end of each group
    names = np.empty(len(ids_a) + len(ids_b), np.int64)
    names[np.arange(len(ids_a)) + before_b[o.group_a]] = ids_a + last_a * p.most
    names[np.arange(len(ids_b)) + through_a[o.group_b]] = ids_b + last_b * 2 * p.most
    every, at = p.names[names].tolist(), 0
    for n in (n_a + n_b).tolist():
        yield b"".join(every[at : at + n])[:-1]
        at += n


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, most: int = 500_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row: both tokenizers' tokens of a space and the text, aligned.

    A link is a pair of tokens whose bytes overlap; the count of its pair of ids is the number of rows that have it. ``n_best`` counts the
    links whose pair is, with others alike, the commonest of its first id; ``count_sum`` adds the counts of all links. ``groups``
    lists the ids of each group, or is their SHA-256 with ``digest``.

    A null or empty text, or one that the tokens of either side don't spell again, has zeros and empty ``groups``. A text is aligned whole,
    however long. A repeated row counts again and comes again; a null id stays null. ``docs`` may have columns of any other name. An
    empty table gives an empty result. ``most`` bounds the table of the commonest pairs that tasks hold.
    """
    spark = docs.sparkSession
    own = pair(a_path, b_path)
    size_b, key = own.b.size, "int" if own.pairs < 1 << 31 else "long"
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    kinds = [("row", pa.int64()), ("doc_id", pa.int64())] + [(c, pa.int64()) for c in numbers] + [("groups", pa.string()), ("pairs", pa.list_(pa.int32() if key == "int" else pa.int64())), ("times", pa.list_(pa.int32()))]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        for b in batches:
            at = 0
            for texts in portions(b.column("text").to_pylist(), 2_000_000):
                found = list(zip(*of_texts(p, texts, digest)))
                columns = [pa.array(x) for x in found[:5]] + [_lists(x, kind.value_type) for x, (_, kind) in zip(found[5:], kinds[-2:])]
                rows = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), *columns], schema=pa.schema(kinds))
                at += len(texts)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_rows(spark, 1000):
        coded = stage(rows.mapInArrow(tokens, f"row long, doc_id long, {', '.join(f'{c} long' for c in numbers)}, groups string, pairs array<{key}>, times array<int>"), "aligned")
    counted = stage(coded.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.floor(F.col("pair") / size_b)), "pairs")
    best = counted.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of the first vocabulary
    counts = stage(counted.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")), "counts")

    common = _commonest(counts, most)
    known = counts.where(F.col("n") >= common).select("pair", "n", "best").toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "n", "best")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for b in batches:
            keys, times = (b.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            of = np.repeat(np.arange(b.num_rows), b.column("pairs").value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
            met = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
            hit, many = at[met], times[met].astype(np.int64)
            row, none = b.column("row").to_numpy(), pa.nulls(b.num_rows, pa.int64())
            ends = np.searchsorted(of[met], np.arange(b.num_rows + 1))
            totals = [np.diff(np.append(0, (x[hit] * many).cumsum())[ends]) for x in (n, best)]
            yield pa.RecordBatch.from_arrays([b.column("row"), none, none, pa.array(totals[0]), pa.array(totals[1])], names=["row", "pair", "times", "count_sum", "n_best"])
            if not met.all():
                rest = ~met
                none = pa.nulls(int(rest.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row[of[rest]]), pa.array(keys[rest].astype(np.int64)), pa.array(times[rest].astype(np.int64)), none, none], names=["row", "pair", "times", "count_sum", "n_best"])

    with arrow_rows(spark, 500):
        summed = stage(coded.select("row", "pairs", "times").mapInArrow(sums, "row long, pair long, times long, count_sum long, n_best long"), "sums")
    rare = summed.where("pair is not null").join(counts.where(F.col("n") < common), "pair")
    each = summed.where("pair is null").select("row", "count_sum", "n_best").unionByName(
        rare.select("row", (F.col("n") * F.col("times")).alias("count_sum"), (F.col("best") * F.col("times")).alias("n_best"))
    )
    totals = each.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return coded.select("row", "doc_id", *numbers, "groups").join(totals, "row").select("doc_id", *numbers, "n_best", "count_sum", "groups")


def _lists(parts: tuple, kind: pa.DataType) -> pa.ListArray:
    ends = np.append(0, np.fromiter(map(len, parts), np.int32, len(parts)).cumsum()).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))


def _commonest(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` pairs reach. A short histogram of eighths of an octave comes to the driver."""
    room, out = most, 1 << 62
    for r in counts.groupBy(F.floor(F.log2("n") * 8).alias("level")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        room -= r["rows"]
        if room < 0:
            break
        out = r.n
    return out
