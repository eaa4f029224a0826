"""Operator 1: a quality classifier, an additive model with pairwise interactions.

The score of a text is the logistic of a sum of table entries: one table for each feature and one for each of a few pairs
of features, looked up by the feature's bin. Tables are learned by boosting: features take turns, and each turn adds a
shallow tree on one feature (or one pair), shrunk by a learning rate, to that table. As the trees of a feature are summed
into its table, scoring is a few indexed additions for a whole batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from importlake.llm.common import in_sample, sample_share

FEATURES = (
    "log_bytes", "upper", "digit", "space", "non_ascii", "exclaim", "pipe", "symbol", "sentence_end", "comma",
    "log_words", "word_bytes", "distinct", "top_word", "same_as_before", "line_words", "distinct_lines", "short_lines",
    "odd_ending", "capitals", "longest_run", "bare_ends",
)
SYMBOLS = b"#$%&*@^_~=+<>{}[]\\/"


def features(text: str | None) -> list[float]:
    """Counts over the whole text, as shares where the length would show otherwise. An empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, m = max(1, len(words)), max(1, len(lines))
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:]))
    run = longest = 1
    if same:
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
    odd = sum(x[-1] in b"!#$%&*|~^=+_<>" for x in words)
    counts = [len(x.split()) for x in lines]
    return [
        np.log1p(n), c[65:91].sum() / n, c[48:58].sum() / n, (c[32] + c[9:14].sum()) / n, c[128:].sum() / n, c[33] / n, c[124] / n,
        sum(int(c[b]) for b in SYMBOLS) / n, (c[46] + c[63]) / w, c[44] / w,
        np.log1p(len(words)), sum(map(len, words)) / w, len(seen) / w, max(seen.values(), default=0) / w, same / w, len(words) / m,
        len(set(lines)) / m, sum(x <= 4 for x in counts) / m,
        odd / w, sum(x[:1].isupper() for x in words) / w, np.log1p(longest), sum(x[-1:].isalnum() for x in lines) / m,
    ]


@dataclass
class Model:
    """``cuts``: the inner bin edges of each feature. ``tables``: one for each feature. ``pairs``: (i, j, table) on coarse bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cuts, x[:, i], side="right")]
        for i, j, values in self.pairs:
            total += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, l2: float) -> np.ndarray:
    """The step for each bin from a tree of up to ``leaves`` leaves on one binned feature, grown by best gain."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            at = at[(ch[at] - ch[a] >= least) & (ch[b] - ch[at] >= least)]
            if len(at):
                gain = value(a, at) + value(at, b) - value(a, b)
                top = int(gain.argmax())
                if gain[top] > best[0]:
                    best = (gain[top], k, int(at[top]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """A tree of four leaves on a pair: the cut of each feature that together gain most. Returns gain and step."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = g.shape
    if a < 2 or b < 2:
        return 0.0, np.zeros_like(g)
    i, j = np.arange(1, a)[:, None], np.arange(1, b)[None, :]
    quarter = lambda c: (c[i, j], c[i, b] - c[i, j], c[a, j] - c[i, j], c[a, b] - c[i, b] - c[a, j] + c[i, j])
    gain = sum(x * x / (y + l2) for x, y in zip(quarter(cg), quarter(ch)))
    p, q = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros_like(g)
    for s, (x, y) in zip(((0, 0), (0, 1), (1, 0), (1, 1)), zip(quarter(cg), quarter(ch))):
        step[(slice(0, p + 1), slice(p + 1, a))[s[0]], (slice(0, q + 1), slice(q + 1, b))[s[1]]] = x[p, q] / (y[p, q] + l2)
    return float(gain[p, q]) - cg[a, b] ** 2 / (ch[a, b] + l2), step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 12, rounds: int = 150, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, leaves: int = 4) -> Model:
    """Boost the feature tables in turn, choose the pairs that gain most on what is left, and boost those in turn.

    No rows, or one label only, gives a constant: the share of label 1, or one half.
    """
    n, f = x.shape
    share = (y.sum() + 1) / (n + 2)
    cuts, coarse = [_edges(x[:, i], bins) for i in range(f)], [_edges(x[:, i], coarse_bins) for i in range(f)]
    model = Model(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)]
    total = np.full(n, model.base)
    least, l2 = max(1.0, 0.002 * n) * 0.1, 1.0
    for _ in range(rounds):
        for i in range(f):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(at[i], y - p, len(cuts[i]) + 1)
            h = np.bincount(at[i], p * (1 - p), len(cuts[i]) + 1)
            step = rate * _tree(g, h, leaves, least, l2)
            model.tables[i] += step
            total += step[at[i]]
    small = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(coarse)]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = small[i] * shape[1] + small[j]
        return cell, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_pair_tree(*grids(i, j)[1:], l2)[0], i, j) for i in range(f) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in gains]
    for _ in range(pair_rounds):
        for i, j, values in model.pairs:
            cell, g, h = grids(i, j)
            step = rate * _pair_tree(g, h, l2)[1]
            values += step
            total += step.ravel()[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Model:
    """Fit on the labelled rows for which ``usable`` holds, or on a sample of ``max_rows`` of them, chosen by a hash of the id.

    The ids and labels of the sample are broadcast to the documents, so texts aren't shuffled and only feature rows reach the driver.
    A document with several labels has the largest; null labels and ids are left out. Repeated rows of a labelled document all count.
    No labels give a constant score. Columns besides the id and the text aren't read.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable).groupBy(id_col).agg(F.max(label_col).alias("y"))
    chosen = known.where(in_sample(F.col(id_col), sample_share(known.count(), max_rows))).select(F.col(id_col).alias("label_id"), "y")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"].astype("string"), "y": b["y"].astype("float64"), "x": [features(t) for t in b["text"]]})

    # By id, so that the sums of the fit don't hang on the order in which tasks end.
    got = sorted(rows.select("id", "y", "text").mapInPandas(of, "id string, y double, x array<double>").collect(), key=lambda r: (r.id, r.x))
    return fit(np.array([r.x for r in got]).reshape(len(got), len(FEATURES)), np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """Add the score of each whole text (0 to 1; null and empty texts are scored by their zero features).

    Every row is scored by its text alone, so repeated rows have one score. A column named as ``to`` says is replaced, others stay. An
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def of(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(shared.value.score(x))

    return docs.withColumn(to, of(F.col(text_col)))
