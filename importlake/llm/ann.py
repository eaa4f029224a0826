"""Operator 9: nearest neighbours by additive quantisation.

A unit vector is approximated by a sum of code words, one from each of several codebooks whose words have all dimensions.
Codebooks are learned one after another on what the ones before leave over; a vector is encoded by a beam search over
them. Its distance to its approximation is stored. A query scores a vector by one table entry for each code word; the cosine
is at most that distance above. A query's best by this score are scored exactly on the original vectors first; then all that could still
be nearer than those by their distance, so none is missed, however much alike vectors are. Queries and codes are tables of
blocks, so neither passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from importlake.llm.common import arrow_rows, discard, in_sample, sample_share, stage


#: Vectors are encoded, and queries scored, in blocks of up to these sizes; a block of scored vectors has at most this many components.
ENCODED, ASKED, SCORED, COMPONENTS = 1024, 256, 4096, 1 << 17
#: What rounding can add to a score by tables, whose entries are of single precision, and to one by a product of matrices.
SLACK, EXACT_SLACK = 1e-5, 1e-9


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v) of the rows whose id and vector aren't null, with finite components and a length above zero. ``row`` numbers the rows, repeated ids being rows of their own."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0)).select(F.monotonically_increasing_id().alias("row"), "id", "v")


def alike(vectors: DataFrame) -> DataFrame:
    """The vectors with as many components as most have, of equally many the larger number."""
    most = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return vectors if most is None else vectors.where(F.size("v") == most["d"])


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x @ words.T * 2 - (words**2).sum(1)).argmax(1)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _nearest(x, words)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, at, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
        words[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return words


@dataclass
class Index:
    books: np.ndarray  # codebook, word, dimension

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distances to the approximations. The beam keeps the ``beam`` nearest partial sums after each codebook."""
        n, size = len(x), self.books.shape[1]
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for words in self.books:
            # The squared distance of the rest to a word, up to what all words share.
            cost = (rest**2).sum(2)[:, :, None] - 2 * rest @ words.T + (words**2).sum(1)
            keep = min(beam, cost.shape[1] * size)
            flat = cost.reshape(n, -1)
            at = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            old, word = np.divmod(at, size)
            rest = np.take_along_axis(rest, old[:, :, None], 1) - words[word]
            codes = np.concatenate([np.take_along_axis(codes, old[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        best = (rest**2).sum(2).argmin(1)
        return codes[np.arange(n), best], np.linalg.norm(rest[np.arange(n), best], axis=1)

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, vectors): table entries summed over the codebooks."""
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m, words in enumerate(self.books):
            total += (queries @ words.T).astype(np.float32)[:, codes[:, m]]
        return total


def train(vectors: DataFrame, books: int = 8, words: int = 256, max_rows: int = 16_384, rounds: int = 8, seed: int = 5) -> Index:
    """Learn the codebooks on at most about ``max_rows`` vectors, chosen by a hash of the id; of repeated ids the least vector."""
    chosen = vectors.where(in_sample(F.col("id"), sample_share(vectors.count(), max_rows)))
    rows = sorted((r.id, r.v) for r in chosen.groupBy("id").agg(F.min("v").alias("v")).collect())
    if not rows:
        return Index(np.zeros((0, words, 0)))
    x = np.array([v for _, v in rows])
    rest, rng, out = x / np.linalg.norm(x, axis=1, keepdims=True), np.random.default_rng(seed), []
    for _ in range(books):
        out.append(_means(rest, min(words, 256), rounds, rng))
        rest = rest - out[-1][_nearest(rest, out[-1])]
    return Index(np.array(out))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code_blocks(vectors: DataFrame, index, beam: int) -> DataFrame:
    """A staged table of blocks of vectors: their rows, ids, codes, distances to the approximations, and the vectors themselves, packed."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = min(SCORED, max(1, COMPONENTS // max(1, index.value.books.shape[2])))
        for b in batches:
            for lo in range(0, len(b), size):
                part = b.iloc[lo : lo + size]
                x = np.stack(part["v"].to_list())
                coded = [index.value.encode(unit(x[at : at + ENCODED]), beam) for at in range(0, len(x), ENCODED)]
                yield pd.DataFrame({"rows": [part["row"].to_numpy(np.int64).tobytes()], "ids": [part["id"].to_numpy(np.int64).tobytes()], "codes": [np.concatenate([c for c, _ in coded]).tobytes()], "gaps": [np.concatenate([g for _, g in coded]).astype(np.float32).tobytes()], "v": [x.tobytes()]})

    return stage(vectors.mapInPandas(encode, "rows binary, ids binary, codes binary, gaps binary, v binary"), "encoded")


def _query_blocks(asked: DataFrame) -> DataFrame:
    """A staged table of blocks of up to ASKED vectors, their rows and ids, packed."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), ASKED):
                part = b.iloc[lo : lo + ASKED]
                yield pd.DataFrame({"q_rows": [part["row"].to_numpy(np.int64).tobytes()], "q_ids": [part["id"].to_numpy(np.int64).tobytes()], "q": [np.stack(part["v"].to_list()).tobytes()]})

    return stage(asked.mapInPandas(pack, "q_rows binary, q_ids binary, q binary"), "asked")


class Nearest:
    """The ``k`` nearest of each query of a block by cosine, ties to the smaller id, then row, over all code blocks that are added."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, shortlist: int):
        self.rows, self.ids, self.vectors, self.k, self.shortlist = rows, ids, vectors, k, max(k, shortlist)
        self.norms, self.unit = np.linalg.norm(vectors, axis=1), unit(vectors)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * len(rows)

    def _score(self, i: int, at: np.ndarray, block: tuple) -> None:
        """Score the vectors ``at`` places of a block exactly and keep the best."""
        rows, ids, v, norms = block
        had_rows, had_ids, had = self.best[i]
        found = (v[at] * self.vectors[i]).sum(1) / (self.norms[i] * norms[at])
        parts = np.concatenate([had_rows, rows[at]]), np.concatenate([had_ids, ids[at]]), np.concatenate([had, found])
        order = np.lexsort((parts[0], parts[1], -parts[2]))[: self.k]
        self.best[i] = tuple(p[order] for p in parts)

    def _least(self, i: int) -> float:
        """What a cosine has to reach to be among the best."""
        return self.best[i][2][-1] if len(self.best[i][2]) == self.k else -np.inf

    def add(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, rough: np.ndarray, gaps: np.ndarray) -> None:
        """Add a block of vectors with their scores by tables, which are off by at most ``gaps``."""
        norms = np.linalg.norm(v, axis=1)
        block = rows, ids, v, norms
        rough[self.rows[:, None] == rows] = -np.inf
        first = min(self.shortlist, len(rows))
        heads = np.argpartition(rough, len(rows) - first, axis=1)[:, len(rows) - first :]
        most = rough + (gaps + SLACK)
        for i, at in enumerate(heads):
            at = at[most[i, at] >= self._least(i)]
            at = at[rough[i, at] > -np.inf]
            if len(at):
                self._score(i, at, block)
                rough[i, at] = -np.inf
        least = np.array([self._least(i) for i in range(len(self.rows))])[:, None]
        open_ = (rough > -np.inf) & (most >= least)
        if 8 * open_.sum() > open_.size:
            # Codes tell these vectors apart too little: their cosines by a product of matrices leave few to be scored one by one.
            open_ &= self.unit @ (v / norms[:, None]).T >= least - EXACT_SLACK
        for i in np.flatnonzero(open_.any(axis=1)):
            self._score(i, np.flatnonzero(open_[i]), block)

    def frame(self) -> pd.DataFrame:
        rows, ids, scores = (np.concatenate(p) for p in zip(*self.best))
        each = [len(x) for x, _, _ in self.best]
        return pd.DataFrame({"query_row": np.repeat(self.rows, each), "query_id": np.repeat(self.ids, each), "row": rows, "vec_id": ids, "score": scores})


def search(
    embeddings: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", books: int = 24, words: int = 256, beam: int = 4, shortlist: int = 40
) -> DataFrame:
    """Return (query_id, rank, vec_id, score): the ``k`` nearest of each query, the rows whose id ``every`` divides.

    Every row but the query's own is a candidate; nearness is the cosine in double precision, ties go to the smaller id.
    Vectors that are null, of length zero, or that hold a null or a non-finite component take no part; neither do null ids.
    Rows of one id are candidates, and queries, each of its own. Vectors with another number of components than most have take no part. Other columns
    are not read. Fewer candidates than ``k`` are all returned. An empty table gives an empty result. Blocks of queries meet blocks of codes. Of each
    block a query's ``shortlist`` best by table score are scored exactly first, then all whose bound reaches the ``k``-th of them; a task sends on ``k`` rows for
    each query, so the result hangs neither on the codes nor on how rows are dealt out.
    """
    spark = embeddings.sparkSession
    staged = stage(usable(embeddings, id_col, vector_col), "vectors")
    vectors = alike(staged)
    index = spark.sparkContext.broadcast(train(vectors, books, words))
    codes, queries = _code_blocks(vectors, index, beam), _query_blocks(vectors.where(F.col("id") % every == 0))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, lists = b"", None
        for b in batches:
            for q_rows, q_ids, q, rows, ids, packed, gaps, v in zip(*[b[c] for c in ("q_rows", "q_ids", "q", "rows", "ids", "codes", "gaps", "v")]):
                if lists is None or q_rows != block:
                    if lists is not None:
                        yield lists.frame()
                    n = len(q_rows) // 8
                    block, lists = q_rows, Nearest(np.frombuffer(q_rows, np.int64), np.frombuffer(q_ids, np.int64), np.frombuffer(q).reshape(n, -1), k, shortlist)
                n = len(ids) // 8
                rough = index.value.scores(lists.unit, np.frombuffer(packed, np.uint8).reshape(n, -1))
                lists.add(np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(v).reshape(n, -1), rough, np.frombuffer(gaps, np.float32))
        if lists is not None:
            yield lists.frame()

    with arrow_rows(spark, 8):  # each row holds two blocks
        found = stage(queries.crossJoin(codes).mapInPandas(near, "query_row long, query_id long, row long, vec_id long, score double"), "found")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    best = stage(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(staged, codes, queries, found)
    return best
