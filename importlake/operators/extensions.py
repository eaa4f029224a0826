"""Functions of the user inside the library: one that embeds texts, one that judges pairs.

Both run over batches in the tasks, on what is not done yet only. A batch on which a function raises is halved until the rows at
fault stand alone: those get a status row with the error, all others their result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators import enrich
from importlake.sources import tables

PRODUCT = ["sku_name", "mc", "category"]


def tried(f: Callable[[list], Sequence], items: list, sound: Callable[[object], str | None]) -> list[tuple[object, str | None]]:
    """(result, error) of each item. ``sound`` says what is wrong with a result, or nothing."""
    if not items:
        return []
    try:
        out = list(f(items))
        if len(out) != len(items):
            raise ValueError(f"{len(out)} results for {len(items)} rows")
    except Exception as e:  # whatever a function of the user raises
        if len(items) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(items) // 2
        return tried(f, items[:half], sound) + tried(f, items[half:], sound)
    return [(None, wrong) if (wrong := sound(r)) else (r, None) for r in out]


def batches_of(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        for k in range(0, len(f), rows):
            yield f.iloc[k : k + rows]


def embed_backlog(backlog: DataFrame, embed_fn: Callable[[list[str]], Sequence], model: str, dimension: int, batch: int = 64) -> DataFrame:
    """The rows of ``backlog`` (sku_name, mc, category) with ``embedding``, ``status`` (completed or failed), ``error`` and ``model``.

    ``embed_fn`` gets up to ``batch`` texts, shaped like a product's, and returns a vector for each; one of another dimension or with a number
    that isn't finite has failed. A row is embedded once, however often it is in the backlog. An empty backlog calls nothing.
    """

    def sound(v) -> str | None:
        if v is None or len(v) != dimension:
            return f"expected {dimension} numbers, got {0 if v is None else len(v)}"
        return None if all(math.isfinite(a) for a in v) else "a number isn't finite"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches_of(frames, batch):
            done = tried(embed_fn, b["text"].tolist(), sound)
            vectors = [None if v is None else [float(a) for a in v] for v, _ in done]
            yield b[PRODUCT].assign(embedding=vectors, status=["failed" if e else "completed" for _, e in done], error=[e for _, e in done], model=model)

    rows = backlog.select(*PRODUCT).distinct().withColumn("text", x.product_text(*map(F.col, PRODUCT)))
    return rows.mapInPandas(run, "sku_name string, mc string, category string, embedding array<double>, status string, error string, model string")


def embed_missing(products: DataFrame, stored: DataFrame, embed_fn: Callable[[list[str]], Sequence], model: str, dimension: int, batch: int = 64) -> DataFrame:
    """``stored`` with the products that it lacks or that failed before embedded anew; what is completed isn't asked again."""
    backlog = enrich.embedding_backlog(products, stored, model, retry_failed=True)
    fresh = embed_backlog(backlog, embed_fn, model, dimension, batch).withColumn("ordinal", F.lit(1))
    return tables.upsert(stored.select(*PRODUCT, "embedding", "status", "error", "model"), fresh, [*PRODUCT, "model"], "ordinal")


def judge_queue(queue: DataFrame, known: DataFrame, judge_fn: Callable[[list[tuple[str, str]]], Sequence[bool | None]], batch: int = 64) -> DataFrame:
    """New rows (target, candidate, accepted, error) for the pairs of ``queue`` that ``known``, a table of such rows, has no answer for.

    Each distinct pair is asked once. None stands for no opinion and is an answer too: the pair stays pending where decisions are applied.
    A pair on which the function raised has an error and no answer, and is asked again the next time.
    """
    answered = known.where("error is null").select("target", "candidate").distinct()
    pairs = queue.select("target", "candidate").distinct().join(answered, ["target", "candidate"], "left_anti")

    def sound(v) -> str | None:
        return None if v is None or isinstance(v, bool) else f"not a decision: {v!r}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches_of(frames, batch):
            done = tried(judge_fn, list(zip(b["target"], b["candidate"])), sound)
            yield b.assign(accepted=pd.Series([v for v, _ in done], dtype=object, index=b.index), error=[e for _, e in done])

    return pairs.mapInPandas(run, "target string, candidate string, accepted boolean, error string")


def decisions(known: DataFrame) -> DataFrame:
    """The answers that say something, as ``apply_decisions`` takes them."""
    return known.where("accepted is not null").select("target", "candidate", "accepted")
