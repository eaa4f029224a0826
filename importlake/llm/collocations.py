"""Operator 13: phrases that occur together, by dynamic itemset counting.

The documents are dealt into a few shards, scanned in a cycle. A phrase of two or more words is counted from the first scan
before which both its parts without the last and without the first word had reached the threshold, and for one whole cycle
from there, so that each scan counts phrases of several lengths at once and long phrases needn't wait until the counts of the
shorter ones are complete. A scan drops most inactive phrases by a bitmap of fixed size, made of the phrases that have reached the
threshold; exact joins on the counted rows drop the others. State, and what has reached the threshold, are tables.

Words are counted by 64-bit hashes, and phrases by the hashes of their words in a row. The words themselves are
kept besides; should two have one hash, another seed is taken, so the counts are exact.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from importlake.llm.common import STAGED, arrow_rows, bitmap, discard, setting, stage

#: A-Z to a-z, a tab to a space, and whatever ends a piece to a line feed.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
#: No text in UTF-8 has this byte, so as a word it can stand for the end of a piece; its hash is 0.
END = b"\xff"
LONGEST = 5
#: Slots of a bitmap of phrases.
SLOTS = 1 << 24
#: Phrases at the threshold, some 50 bytes each, up to which a join broadcasts them.
SMALL = 200_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """The hash of each word."""

    def __init__(self, seed: int, hashed: Callable[[bytes, int], int]):
        super().__init__({END: 0})
        self.seed, self.hashed = seed, hashed

    def __missing__(self, word: bytes) -> int:
        h = self[word] = self.hashed(word, self.seed) >> 1 or 1  # a long above 0
        return h

    def of(self, text: str | None) -> list[int]:
        folded = (text or "").encode().translate(FOLD).replace(b"\n", b" \xff ")
        return list(map(self.__getitem__, folded.split()))


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed)


def _coded(docs: DataFrame, shards: int, seed: int, hashed: Callable[[bytes, int], int]) -> DataFrame:
    """A table in folders: (lang, codes, n) for each text, 0 between its pieces, in one of the shards; (word, code) in the folder -1."""
    kind = pa.schema([("lang", pa.string()), ("codes", pa.list_(pa.int64())), ("n", pa.int64()), ("word", pa.string()), ("code", pa.int64()), ("shard", pa.int32())])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes(seed, hashed)

        def met() -> pa.RecordBatch:
            own = {w: h for w, h in known.items() if h}
            n = len(own)
            known.clear()
            known[END] = 0
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.string()), pa.nulls(n, kind.types[1]), pa.nulls(n, pa.int64()), pa.array([w.decode() for w in own], pa.string()), pa.array(own.values(), pa.int64()), pa.array(np.full(n, -1, np.int32))], schema=kind
            )

        for b in batches:
            rows = list(map(known.of, b.column("text").to_pylist()))
            n = len(rows)
            ends = np.append(0, np.fromiter(map(len, rows), np.int32, n).cumsum()).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64)] + [np.array(r, np.int64) for r in rows])
            real = np.append(0, (flat != 0).cumsum())
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(real[ends[1:]] - real[ends[:-1]]), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), b.column("shard")], schema=kind
            )
            if len(known) > 300_000:
                yield met()
        yield met()

    spark = docs.sparkSession
    rows = docs.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    with arrow_rows(spark, 500), setting(spark, "spark.sql.maxConcurrentOutputFileWriters", shards + 1):
        return stage(rows.mapInArrow(words, "lang string, codes array<long>, n long, word string, code long, shard int"), "codes", "shard")


def _bits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & (len(bits) * 64 - 1)
    return (bits[slot >> 6] >> (slot & 63) & 1).astype(bool)


def _mix(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hashes of phrases, from those of the phrases without their last words."""
    h = (h.view(np.uint64) + codes.view(np.uint64)) * MULTIPLIER
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode()) >> 1


def _distinct(codes: np.ndarray, at: np.ndarray, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, counts) of the distinct phrases at ``at``: found by hash, and by the words should two phrases share one."""
    _, first, of, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    if any((codes[at + k] != codes[at[first][of] + k]).any() for k in range(words)):
        _, first, n = np.unique(codes[at[:, None] + np.arange(words)], axis=0, return_index=True, return_counts=True)
    return at[first], n


def _scan(shard: DataFrame, everything: np.ndarray, recent: np.ndarray, single: bool, lengths: int) -> DataFrame:
    """(lang, p, n): what may be active in a shard. A phrase passes if both its parts may have reached the threshold, one of them lately enough."""
    shared = shard.sparkSession.sparkContext.broadcast((everything, recent))
    kind = pa.schema([("lang", pa.string()), ("p", pa.binary()), ("n", pa.int64())])

    def found(lang: str, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        any_bits, late_bits = shared.value

        def rows(at: np.ndarray, hashes: np.ndarray, words: int) -> pa.RecordBatch:
            at, n = _distinct(codes, at, hashes, words)
            ends = (np.arange(len(at) + 1) * 8 * words).astype(np.int32)
            p = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes[at[:, None] + np.arange(words)]))])
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), p, pa.array(n)], schema=kind)

        at = np.flatnonzero(codes)
        hashes = _mix(np.full(len(at), _lang_hash(lang), np.int64), codes[at])
        if single:
            yield rows(at, hashes, 1)
        for words in range(2, lengths + 1):
            # Of the phrases one word shorter at ``at``: those that may have reached the threshold, and the ones of them that did so lately.
            ok = _bits(any_bits, hashes)
            at, hashes = at[ok], hashes[ok]
            late = _bits(late_bits, hashes)
            follows = np.flatnonzero(at[1:] == at[:-1] + 1)
            at, hashes, active = at[follows], hashes[follows], late[follows] | late[follows + 1]
            hashes = _mix(hashes, codes[at + words - 1])
            if active.any():
                yield rows(at[active], hashes[active], words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0
        for b in batches:
            lists, codes = b.column("codes"), b.column("codes").flatten().to_numpy()
            ends = np.append(0, lists.value_lengths().to_numpy().cumsum())
            for k, lang in enumerate(b.column("lang").to_pylist()):
                held.setdefault(lang, []).append(codes[ends[k] : ends[k + 1]])
            n += len(codes)
            if n > 2_000_000:
                yield from flushed(held)
                held, n = {}, 0
        yield from flushed(held)

    def flushed(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(1, np.int64)
        for lang, parts in held.items():
            yield from found(lang, np.concatenate([x for p in parts for x in (p, zero)]))

    return shard.select("lang", "codes").mapInArrow(scan, "lang string, p binary, n long")


@F.pandas_udf(LongType())
def _phrase_hash(lang: pd.Series, p: pd.Series) -> pd.Series:
    out = np.zeros(len(p), np.int64)
    length, starts = p.map(len).to_numpy(np.int64), lang.map(_lang_hash).to_numpy(np.int64)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        codes, h = np.frombuffer(b"".join(p.iloc[at]), np.int64).reshape(len(at), -1), starts[at]
        for k in range(codes.shape[1]):
            h = _mix(h, np.ascontiguousarray(codes[:, k]))
        out[at] = h
    return pd.Series(out)


def words_of(p: Column) -> Column:
    return (F.length(p) / 8).cast("int")


def part(p: Column, begin: int | Column, words: int | Column) -> Column:
    """The part of a phrase that begins behind ``begin`` words."""
    return F.substring(p, F.lit(begin) * 8 + 1, F.lit(words) * 8)


def count_phrases(coded: DataFrame, shards: int, least: int, longest: int = LONGEST, slots: int = SLOTS) -> tuple[DataFrame, int]:
    """(lang, p, n) of the phrases of up to ``longest`` words that occur at least ``least`` times, and the number of scans."""
    spark = coded.sparkSession
    state = spark.createDataFrame([], "lang string, p binary, n long, since int, reached int")
    reached = spark.createDataFrame([], "lang string, p binary, reached int")
    # ``everything`` that has reached the threshold, and what did so before each of the scans of a cycle.
    everything, lasts = np.zeros(slots // 64, np.int64), deque([np.zeros(slots // 64, np.int64)], shards)
    paths, old, t, n_reached = [], None, 0, 0
    while True:
        recent = np.bitwise_or.reduce(lasts)
        rows = _scan(coded.where(F.col("shard") == t % shards), everything, recent, t < shards, longest)
        summed = state.unionByName(rows, allowMissingColumns=True).groupBy("lang", "p").agg(F.sum("n").alias("n"), F.max("since").alias("since"), F.max("reached").alias("reached"))
        # A phrase that isn't in the state became active as the later of its parts reached the threshold.
        words = words_of(F.col("p"))
        new = F.col("since").isNull() & (words > 1)
        keyed = summed.withColumns({"p0": F.when(new, part(F.col("p"), 0, words - 1)), "p1": F.when(new, part(F.col("p"), 1, words - 1))})
        # Beyond that size the two joins shuffle both sides.
        small = F.broadcast if n_reached <= SMALL else lambda x: x
        ends = [small(reached).select("lang", F.col("p").alias(f"p{k}"), F.col("reached").alias(f"r{k}")) for k in (0, 1)]
        met = keyed.join(ends[0], ["lang", "p0"], "left").join(ends[1], ["lang", "p1"], "left")
        since = F.coalesce("since", F.when(words == 1, 0), F.when(F.col("r0").isNotNull() & F.col("r1").isNotNull(), F.greatest("r0", "r1")))
        active = met.withColumn("since", since).where((F.col("since") > t - shards) & (F.col("since") <= t))
        t += 1
        now = active.select("lang", "p", "n", "since", F.coalesce("reached", F.when(F.col("n") >= least, t)).alias("reached"))
        # A phrase that has had its cycle and stayed below the threshold is through.
        counted = stage(now.where((F.col("since") > t - shards) | (F.col("n") >= least)), "phrases")
        if old is not None:
            discard(old)
        old, state = counted, counted.where(F.col("since") > t - shards)
        kept = stage(counted.where((F.col("since") == t - shards) | (F.col("reached") == t)).withColumn("scan", F.lit(t)).hint("rebalance"), "counted")
        lately = _reached(kept, longest)
        n_reached += lately.count()
        lasts.append(bitmap(lately.select(_phrase_hash("lang", "p")), slots))
        everything = everything | lasts[-1]
        # All scans' tables are read as one, so that the plan of a later scan is no larger.
        paths.append(STAGED[kept])
        every = spark.read.schema(kept.schema).parquet(*paths)
        reached = _reached(every, longest)
        if t >= shards and not any(b.any() for b in lasts):
            discard(old)
            return every.where(F.col("since") == F.col("scan") - shards).select("lang", "p", "n"), t


def _reached(counted: DataFrame, longest: int) -> DataFrame:
    """The phrases that a scan brought to the threshold and that may be part of a longer one."""
    return counted.where((F.col("reached") == F.col("scan")) & (words_of(F.col("p")) < longest)).select("lang", "p", "reached")


def _shared_codes(coded: DataFrame) -> bool:
    """Whether two words have one hash."""
    words = coded.where(F.col("shard") == -1).groupBy("code").agg(F.min("word").alias("a"), F.max("word").alias("b"))
    return bool(words.where(F.col("a") != F.col("b")).take(1))


@F.pandas_udf(LongType())
def _score(a: pd.Series, n: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([1000 * x * y // (u * v) for x, y, u, v in zip(a.tolist(), n.tolist(), left.tolist(), right.tolist())], dtype="int64")


def mine(
    docs: DataFrame, least: int = 100, share: int = 100, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", shards: int = 3,
    slots: int = SLOTS, hashed: Callable[[bytes, int], int] = word_hash,
) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two to ``longest`` words that occur ``least`` times or more in texts of one language.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. ``a`` counts the
    phrase, ``n`` all words of the language. Of all ways to cut the phrase in two the one with the lowest score
    floor(1000 * a * n / (l * r)) counts, the first of those that are alike; ``l`` and ``r`` are the counts of its parts. A
    phrase that lies in a longer one which occurs at least ``share`` hundredths as often is left out.

    A null language is ``und``, a null or empty text has no words, and a repeated row counts again. A text is read whole, however long, and a word
    may be as long as a text. ``docs`` may have columns of any other name. An empty table gives an empty result. ``shards`` is the
    number of scans in a cycle and ``slots`` the size of the bitmaps; neither changes the result, nor does ``hashed``, which is
    asked again with another seed while two words share a hash.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    seed, coded = 0, _coded(rows, shards, 0, hashed)
    while _shared_codes(coded):
        discard(coded)
        seed += 1
        coded = _coded(rows, shards, seed, hashed)
    found, _ = count_phrases(coded, shards, least, longest, slots)
    counts = stage(found, "counts")
    totals = coded.where(F.col("shard") >= 0).groupBy("lang").agg(F.sum("n").alias("n"))
    return _scored(counts, totals, coded.where(F.col("shard") == -1).select("code", "word"), share)


def _scored(counts: DataFrame, totals: DataFrame, words: DataFrame, share: int) -> DataFrame:
    size = words_of(F.col("p"))
    phrases = counts.where(size > 1).select("lang", "p", F.col("n").alias("a"))
    cuts = phrases.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", part(F.col("p"), 0, F.col("k")).alias("p0"), part(F.col("p"), F.col("k"), size - F.col("k")).alias("p1"))
    sides = [counts.select("lang", F.col("p").alias(f"p{k}"), F.col("n").alias(c)) for k, c in ((0, "l"), (1, "r"))]
    both = cuts.join(sides[0], ["lang", "p0"]).join(sides[1], ["lang", "p1"]).join(totals, "lang")
    lowest = F.min(F.struct(_score("a", "n", "l", "r").alias("score"), "k", "l", "r", "n")).alias("cut")
    scored = both.groupBy("lang", "p", "a").agg(lowest).select("lang", "p", "a", "cut.l", "cut.r", "cut.n", "cut.score")

    inner = phrases.where(size > 2).select("lang", F.col("a").alias("longer"), F.col("p").alias("q"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), words_of(F.col("q")) - 1), lambda w: F.transform(F.sequence(F.lit(0), words_of(F.col("q")) - w), lambda s: part(F.col("q"), s, w))))
    covers = inner.select("lang", "longer", F.explode(F.array_distinct(spans)).alias("p")).groupBy("lang", "p").agg(F.max("longer").alias("longer"))
    kept = scored.join(covers, ["lang", "p"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")

    # Names: the words of what is left only.
    spelled = kept.select("lang", "p", F.posexplode(_codes_of("p")).alias("at", "code"))
    named = words.join(spelled.select("code").distinct(), "code", "left_semi").groupBy("code").agg(F.first("word").alias("word"))
    names = spelled.join(named, "code").groupBy("lang", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return kept.join(names, ["lang", "p"]).select("lang", "phrase", "a", "l", "r", "n", "score")


@F.pandas_udf(ArrayType(LongType()))
def _codes_of(p: pd.Series) -> pd.Series:
    return p.map(lambda x: np.frombuffer(x, np.int64))


def best(phrases: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` of each language, by score, then count, both falling, then the phrase's bytes; ``rank`` counts from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
