"""Operator 3: language identification by unigram models whose segmentation is summed out.

Each language gives every piece of a fixed public vocabulary a probability. The probability of a word is the sum over all
ways to cut it into pieces, which a forward pass gives without listing them. Piece probabilities are learned by expectation
maximisation on the words of each language.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from importlake.llm.common import in_sample, sample_share, stage
from importlake.llm.lattice import MOST, SPACE, Pieces, by_length

WORD = regex.compile(r"\p{L}+")
#: A letter that is no piece of the vocabulary counts as a piece of this probability in every language.
UNKNOWN = 1e-7
#: Each letter multiplies what a word has by this, so that long words don't underflow; it is taken off again.
LIFT = 12.0
#: Letters of a long word for which pieces are looked up at once.
STRETCH = 1024


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@functools.cache
def vocabulary(path: str) -> Pieces:
    """The ordinary pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return Pieces([model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)])


def forward(pieces: Pieces, prob: np.ndarray, codes: np.ndarray) -> tuple[list[np.ndarray], dict]:
    """Lifted forward sums after each letter, (words, languages) each, and the pieces found."""
    n, found = codes.shape[1], pieces.find(codes)
    sums = [np.ones((len(codes), prob.shape[1]))]
    for end in range(1, n + 1):
        total = sums[end - 1] * (UNKNOWN * LIFT)
        for start in range(max(0, end - pieces.longest), end):
            got = found.get((start, end))
            if got is not None:
                total = total + sums[start] * prob[got] * LIFT ** (end - start)  # the last row of prob is zero, for no piece
        sums.append(total)
    return sums, found


def long_forward(pieces: Pieces, prob: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The logarithms of the forward sums after each letter (letters, words, languages), for words of any length."""
    n = codes.shape[1]
    logs = np.zeros((n + 1, len(codes), prob.shape[1]))
    for lo in range(0, n, STRETCH):
        base, hi = max(0, lo + 1 - pieces.longest), min(n, lo + STRETCH)
        found = pieces.find(codes[:, base:hi])
        for end in range(lo + 1, hi + 1):
            total = UNKNOWN
            for start in range(max(0, end - pieces.longest), end):
                got = found.get((start - base, end - base))
                if got is not None:
                    total = total + np.exp(logs[start] - logs[end - 1]) * prob[got]
            logs[end] = logs[end - 1] + np.log(total)
    return logs


def long_counts(pieces: Pieces, prob: np.ndarray, codes: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
    """Add the expected uses of each piece in words of any length to ``counts``."""
    n, ahead = codes.shape[1], long_forward(pieces, prob, codes)
    back = np.zeros_like(ahead)
    for lo in reversed(range(0, n, STRETCH)):
        hi = min(n, lo + STRETCH)
        found = pieces.find(codes[:, lo : min(n, hi - 1 + pieces.longest)])
        for start in range(hi - 1, lo - 1, -1):
            total = UNKNOWN
            for end in range(start + 1, min(n, start + pieces.longest) + 1):
                got = found.get((start - lo, end - lo))
                if got is not None:
                    total = total + np.exp(back[end] - back[start + 1]) * prob[got]
                    np.add.at(counts, got, np.exp(ahead[start] + back[end] - ahead[n]) * prob[got] * weight)
            back[start] = back[start + 1] + np.log(total)


def word_logs(pieces: Pieces, prob: np.ndarray, unique: list[str]) -> np.ndarray:
    """log P(word | language) for each word (with its leading space mark) and language."""
    out = np.zeros((len(unique), prob.shape[1]))
    for at, codes in by_length([SPACE + w for w in unique]):
        if codes.shape[1] > MOST:
            out[at] = long_forward(pieces, prob, codes)[-1]
        else:
            out[at] = np.log(forward(pieces, prob, codes)[0][-1]) - codes.shape[1] * np.log(LIFT)
    return out


def expected_counts(pieces: Pieces, prob: np.ndarray, unique: list[str], weight: np.ndarray) -> np.ndarray:
    """The expected number of uses of each piece by language, for words with ``weight`` occurrences in each language."""
    counts = np.zeros((len(pieces.pieces) + 1, prob.shape[1]))
    for at, codes in by_length([SPACE + w for w in unique]):
        n = codes.shape[1]
        if n > MOST:
            long_counts(pieces, prob, codes, weight[at], counts)
            continue
        sums, found = forward(pieces, prob, codes)
        back = [None] * n + [np.ones_like(sums[0])]
        for start in range(n - 1, -1, -1):
            total = back[start + 1] * (UNKNOWN * LIFT)
            for end in range(start + 1, min(n, start + pieces.longest) + 1):
                got = found.get((start, end))
                if got is not None:
                    total = total + back[end] * prob[got] * LIFT ** (end - start)
            back[start] = total
        scale = weight[at] / sums[-1]
        for (start, end), got in found.items():
            np.add.at(counts, got, sums[start] * prob[got] * LIFT ** (end - start) * back[end] * scale)
    return counts[:-1]


class Model:
    def __init__(self, path: str, langs: list[str], prob: np.ndarray, prior: np.ndarray):
        self.path, self.langs, self.prob, self.prior = path, langs, prob, prior


def train(docs: DataFrame, usable: Column, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", max_docs: int = 8_000, rounds: int = 2) -> Model:
    """Learn from the rows for which ``usable`` holds and whose language isn't null.

    At most about ``max_docs`` rows of each language are used, chosen by a hash of their key: the model has a fixed
    number of parameters, and more rows wouldn't change it. Words are counted by Spark. Each round of expectation runs
    on the executors; only one row for each piece and language, which the vocabulary bounds, comes to the driver.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model(vocabulary_path, [], np.zeros((0, 0)), np.zeros(0))
    pick = functools.reduce(lambda c, x: c.when(F.col("lang") == x, in_sample(F.col("key"), sample_share(sizes[x], max_docs))), langs, F)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: dict[tuple[str, str], int] = {}
            for lang, text in zip(b["lang"], b["text"]):
                for w in words(text):
                    got[lang, w] = got.get((lang, w), 0) + 1
            yield pd.DataFrame({"lang": [k[0] for k in got], "word": [k[1] for k in got], "n": list(got.values())})

    counted = known.where(pick).select("lang", "text").mapInPandas(split, "lang string, word string, n long")
    table = stage(
        counted.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i, x in enumerate(langs)]),
        "words",
    )
    pieces = vocabulary(vocabulary_path)
    prob = np.vstack([np.full((len(pieces.pieces), len(langs)), 1 / len(pieces.pieces)), np.zeros((1, len(langs)))])
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(prob)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, total = vocabulary(vocabulary_path), 0.0
            for b in batches:
                total = total + expected_counts(own, shared.value, list(b["word"]), b.drop(columns="word").to_numpy(float))
            if not np.isscalar(total):
                piece, lang = np.nonzero(total)
                yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        sums = table.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        fresh = np.zeros_like(prob)
        fresh[sums["piece"], sums["lang"]] = sums["n"]
        fresh[:-1] += 0.01
        prob = fresh / fresh[:-1].sum(0)
        prob[-1] = 0
    total = sum(sizes.values())
    return Model(vocabulary_path, langs, prob, np.log(np.array([sizes[x] / total for x in langs])))


def predict(docs: DataFrame, model: Model, text_col: str = "text", to: str = "guess", cache_words: int = 400_000) -> DataFrame:
    """Add a struct (lang, score): the likeliest language of the whole text and its posterior probability.

    ``und`` and 0 for a null text, one without a letter, and where nothing was learned; of languages that are equally likely the first by name.
    Every row is judged by its text alone, so repeated rows agree. A column named as ``to`` says is replaced, others stay; an empty table gives an empty result. Texts are segmented word by word;
    a worker remembers the scores of at most ``cache_words`` words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        place: dict[str, int] = {}
        logs = np.zeros((0, len(m.langs)))
        for texts in batches:
            if len(place) > cache_words:
                place, logs = {}, logs[:0]
            ids = [[place.setdefault(w, len(place)) for w in words(t)] for t in texts]
            if m.langs and len(place) > len(logs):
                fresh = list(place)[len(logs) :]
                logs = np.vstack([logs, word_logs(vocabulary(m.path), m.prob, fresh)])
            lang, score = [], []
            for x in ids:
                if not x or not m.langs:
                    lang.append("und")
                    score.append(0.0)
                    continue
                z = m.prior + logs[x].sum(0)
                z = np.exp(z - z.max())
                k = int(z.argmax())
                lang.append(m.langs[k])
                score.append(float(z[k] / z.sum()))
            yield pd.DataFrame({"lang": lang, "score": score})

    return docs.withColumn(to, of(F.col(text_col)))
