"""Operator 10: SentencePiece encoding and decoding by best paths through a word lattice.

A text is cut into words in front of runs of spaces, which no piece of the vocabulary crosses. The lattice of a word has an
edge for each substring that is a piece. It is built as tables: words are exploded into substrings of bounded length,
these are joined to the piece table, the edges are grouped by word, and Spark's ``aggregate`` folds over their ends for the
best path. That table covers the words that make up most of a corpus and is broadcast, as its size is bounded; words
beyond it are solved by the same recurrence in the task that reads the text, so that no text and no occurrence of a word
is shuffled.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from importlake.llm.common import portions, stage
from importlake.llm.lattice import MOST, SPACE, Edges, Pieces, by_letters

#: A control character, or the mark itself, stands alone; otherwise a word begins with its run of spaces.
#: The commonest kind comes first, and space and control characters are one range, which halves the time that Java's matcher takes.
WORD = r" +[^\x00-\x20▁]*|[^\x00-\x20▁]+|[\x00-\x1f▁]"
FIND = re.compile(WORD)
UNKNOWN_COST = 10.0  # below the least score of a piece, as in the library


class Vocabulary:
    """The pieces of a SentencePiece model file with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.all = [model.id_to_piece(i) for i in every]
        self.octets = {int(self.all[i][3:5], 16): i for i in every if model.is_byte(i)}
        self.ids = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.names = [self.all[i] for i in self.ids]
        self.scores = [model.get_score(i) for i in self.ids]
        self.unknown = min(self.scores) - UNKNOWN_COST
        self.longest = max(map(len, self.names))
        if len(self.octets) != 256 or any(SPACE in x.lstrip(SPACE) for x in self.names):
            raise ValueError("the vocabulary needs all byte pieces, and no piece with a space inside")
        spelled = {i: bytes([b]) for b, i in self.octets.items()} | {i: self.all[i].replace(SPACE, " ").encode() for i in self.ids}
        self.bytes = [spelled.get(i, b"") for i in every]

    def spell(self, ch: str) -> list[int]:
        return [self.octets[b] for b in ch.encode("utf-8", "surrogatepass")]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    v = vocabulary(path)
    return spark.createDataFrame(pd.DataFrame({"piece": v.names, "id": np.array(v.ids, np.int32), "cost": v.scores}))


def lattice(words: DataFrame, pieces: DataFrame, longest: int, unknown: float) -> DataFrame:
    """(word, path): the best path of each distinct ``word`` as an array of (id, s, e); an unknown letter has id -1.

    Words have the mark for a space and at most MOST letters. Of paths that score alike, the one whose last piece is longest wins, then
    likewise before it.
    """
    cuts = F.expr(
        f"flatten(transform(sequence(0, length(word) - 1), s -> transform(sequence(s + 1, least(s + {longest}, length(word))), "
        "e -> struct(s as s, e as e, substring(word, s + 1, e - s) as piece))))"
    )
    edges = words.select("word", F.explode(cuts).alias("x")).select("word", "x.s", "x.e", "x.piece")
    met = edges.join(F.broadcast(pieces), "piece", "left").where("id is not null or e = s + 1")
    grouped = met.groupBy("word").agg(
        F.collect_list(F.struct("e", "s", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("cost", F.lit(unknown)).cast("double").alias("cost"))).alias("edges")
    )
    kind = "struct<cost: double, back: int, id: int>"
    best = f"""aggregate(sequence(1, length(word)), array(cast(struct(0.0D, 0, -1) as {kind})), (a, i) -> concat(a, array(
        array_max(transform(filter(edges, x -> x.e = i), x -> cast(struct(element_at(a, x.s + 1).cost + x.cost, -x.s, x.id) as {kind})))))) """
    walk = """aggregate(sequence(1, length(word)), struct(length(word) as at, cast(array() as array<struct<id: int, s: int, e: int>>) as path),
        (a, i) -> if(a.at = 0, a, struct(-element_at(best, a.at + 1).back as at,
            concat(array(struct(element_at(best, a.at + 1).id as id, -element_at(best, a.at + 1).back as s, a.at as e)), a.path) as path)))"""
    return grouped.select("word", F.expr(best).alias("best")).select("word", F.expr(f"{walk}.path").alias("path"))


def frequent_words(docs: DataFrame, text_col: str, most: int) -> DataFrame:
    """The words of ``docs`` that occur most, at most ``most`` of them, with the mark for a space. Counts cover all texts.

    Counts are compared by their eighths of an octave, so that only a short histogram comes to the driver.
    """
    text = F.concat(F.lit(" "), F.col(text_col))
    found = docs.select(F.explode(F.regexp_extract_all(text, F.lit(WORD.replace("\\u2581", SPACE)), F.lit(0))).alias("word"))
    counts = stage(found.where((F.length("word") <= MOST) & (F.col("word") != SPACE)).groupBy("word").agg(F.count("*").alias("n")), "counts")
    level = F.floor(F.log2("n") * 8)
    room, least = most, 1 << 30
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        room -= row.n
        if room < 0:
            break
        least = row.level
    return counts.where(level >= least).select(F.translate("word", " ", SPACE).alias("word"))


class Solved(dict):
    """The piece ids of words as they stand in a text, as packed 32-bit numbers; a word that isn't there is solved when asked for."""

    def __init__(self, path: str, given: dict[str, bytes]):
        super().__init__(given)
        self.vocabulary, self.given = vocabulary(path), given
        self.prefixes, self.edges = _prefixes(path), _edges(path)

    def forget(self) -> None:
        self.clear()
        self.update(self.given)

    def __missing__(self, word: str) -> bytes:
        ids = self.vocabulary.spell(SPACE) if word == SPACE else self.solve(word.replace(" ", SPACE))
        packed = array("i", ids).tobytes()
        if len(word) <= MOST:  # a longer one seldom comes again, and may be a whole text
            self[word] = packed
        return packed

    def ids(self, text: str) -> np.ndarray:
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text; the words that aren't known yet are solved together."""
        cut = [None if t is None else FIND.findall(" " + t) if t else [] for t in texts]
        short = [w for w in set(chain.from_iterable(x for x in cut if x)) if w not in self and len(w) <= MOST and w != SPACE]
        self.update(zip(short, self.solve_all([w.replace(" ", SPACE) for w in short])))
        return [None if x is None else np.frombuffer(b"".join(map(self.__getitem__, x)), np.int32) for x in cut]

    def solve_all(self, words: list[str]) -> list[bytes]:
        """As ``solve``, packed, for many words of up to MOST letters at once: the recurrence goes on by one letter in all of them together."""
        v, out = self.vocabulary, [b""] * len(words)
        scores, ids = np.array(v.scores), np.array(v.ids, np.int32)
        for at, sizes, codes in by_letters(words):
            every, heads = np.arange(len(at)), sizes.cumsum() - sizes
            word = np.repeat(every, sizes)
            # A word of n letters has n + 1 nodes, one after the other.
            first, places = heads + every, np.arange(len(codes)) - heads[word]
            found, long, got = self.edges.of(codes, sizes[word] - places)
            turn = np.argsort(places[found].astype(np.int16), kind="stable")
            found, long, got = found[turn], long[turn], got[turn]
            bounds = np.searchsorted(places[found], np.arange(sizes[0] + 1))
            tails, heads_of = (found + word[found]) + long, found + word[found]
            best, step, piece = np.full(len(codes) + len(at), -1e300), np.ones(len(codes) + len(at), np.int64), np.full(len(codes) + len(at), -1, np.int32)
            best[first] = 0
            for start in range(sizes[0]):
                node = first[: np.searchsorted(-sizes, -start)] + start  # of the words that go on here
                cost = best[node] + v.unknown
                node = node[odd := cost > best[node + 1]] + 1
                best[node], step[node], piece[node] = cost[odd], 1, -1
                e = slice(bounds[start], bounds[start + 1])
                cost = best[heads_of[e]] + scores[got[e]]
                better = cost > best[tails[e]]
                node = tails[e][better]
                best[node], step[node], piece[node] = cost[better], long[e][better], got[e][better]
            node, who, path = first + sizes, every, []
            while len(who):
                path.append((who, piece[node]))
                node = node - step[node]
                more = node > first[who]
                node, who = node[more], who[more]
            ends = np.bincount(np.concatenate([w for w, _ in path])).cumsum()
            flat, odd = np.empty(ends[-1], np.int32), np.zeros(len(at), bool)
            for k, (who, taken) in enumerate(path, 1):
                flat[ends[who] - k] = taken
                odd[who[taken < 0]] = True
            packed, own = ids[flat].tobytes(), [words[k] for k in at.tolist()]
            # A word with a letter that is no piece is solved by itself. Pieces are found by hash; should they not spell the words, so is every word.
            plain = flat[np.repeat(~odd, np.diff(ends, prepend=0))]
            if "".join([v.names[i] for i in plain.tolist()]) != "".join(w for w, alone in zip(own, odd.tolist()) if not alone):
                odd[:] = True
            bytes_at = (ends * 4).tolist()
            for k, begin, end, w, alone in zip(at.tolist(), [0, *bytes_at], bytes_at, own, odd.tolist()):
                out[k] = array("i", self.solve(w)).tobytes() if alone else packed[begin:end]
        return out

    def solve(self, word: str) -> list[int]:
        """The best path through a word's lattice. Of paths that score alike, as in ``lattice``, the longest last piece."""
        v, n, prefixes = self.vocabulary, len(word), self.prefixes
        best, back = [0.0] + [-1e300] * n, [(0, -1)] * (n + 1)
        for start in range(n):
            base = best[start]
            if base + v.unknown > best[start + 1]:
                best[start + 1], back[start + 1] = base + v.unknown, (start, -1)
            for end in range(start + 1, n + 1):
                piece = prefixes.get(word[start:end])
                if piece is None:
                    break  # no piece begins like this
                if piece and base + piece[1] > best[end]:
                    best[end], back[end] = base + piece[1], (start, piece[0])
        parts, end = [], n
        while end:
            start, piece = back[end]
            parts.append([piece] if piece >= 0 else v.spell(word[start]))
            end = start
        return list(chain.from_iterable(reversed(parts)))


@functools.cache
def _edges(path: str) -> Edges:
    return Edges(Pieces(vocabulary(path).names))


@functools.cache
def _prefixes(path: str) -> dict[str, tuple]:
    """Each beginning of a piece, with the piece's id and score if it is a whole one."""
    v, out = vocabulary(path), {}
    for name, i, cost in zip(v.names, v.ids, v.scores):
        for k in range(1, len(name)):
            out.setdefault(name[:k], ())
        out[name] = (i, cost)
    return out


def encode(
    docs: DataFrame, vocabulary_path: str, text_col: str = "text", to: str = "ids", check: str | None = None, table_words: int = 300_000, cache_words: int = 50_000
) -> DataFrame:
    """Add the piece ids of each whole text, and as ``check`` whether they spell the text again.

    Ids are those of the path with the largest sum of piece scores; a letter that is no piece is spelled in byte pieces, and so is a
    literal mark. A null text has null ids, an empty text none; both check. A repeated row is coded like the first; an empty table gives an
    empty result; columns named as ``to`` and ``check`` say are replaced, others stay. A word is solved whole, however long. ``table_words`` bounds the broadcast table of
    solved words, ``cache_words`` what a worker remembers besides.
    """
    spark = docs.sparkSession
    v = vocabulary(vocabulary_path)
    table = lattice(frequent_words(docs, text_col, table_words), piece_table(spark, vocabulary_path), v.longest, v.unknown)
    solved = {
        r.word.replace(SPACE, " "): array("i", chain.from_iterable([i] if i >= 0 else v.spell(r.word[s]) for i, s, _ in r.path)).tobytes() for r in table.toLocalIterator()
    }
    shared = spark.sparkContext.broadcast(solved)

    @F.pandas_udf("ids array<int>, same boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Solved(vocabulary_path, shared.value)
        for texts in batches:
            for part in portions(texts):
                if len(known) > len(known.given) + cache_words:
                    known.forget()
                ids = known.all_ids(part)
                same = [check is None or t is None or spelled(known.vocabulary, x) == t for t, x in zip(part, ids)]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "same": same})

    out = docs.withColumn(to, of(F.col(text_col)))
    return out.withColumns({to: F.col(f"{to}.ids"), check: F.col(f"{to}.same")}) if check else out.withColumn(to, F.col(f"{to}.ids"))


def spelled(v: Vocabulary, ids: np.ndarray) -> str:
    if len(ids) and (ids.min() < 0 or ids.max() >= len(v.bytes)):
        ids = ids[(ids >= 0) & (ids < len(v.bytes))]
    return b"".join(map(v.bytes.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def decode(docs: DataFrame, vocabulary_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the text that the ids spell; null ids give null. Ids outside the vocabulary and control pieces give nothing.

    Every row is decoded by itself, repeated rows too. A column named as ``to`` says is replaced; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def of(ids: pd.Series) -> pd.Series:
        own = vocabulary(vocabulary_path)
        return pd.Series([None if x is None else spelled(own, x) for x in ids], dtype=object)

    return docs.withColumn(to, of(F.col(ids_col)))
