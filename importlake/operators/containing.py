"""Joins on a text that holds another, without comparing every text with every other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram. A needle that is shorter is met by its own length.
GRAM = 3


def _grams(c: str, n: int | Column) -> Column:
    """The distinct parts of ``n`` letters of a text that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))


def containing(needles: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """Distinct (needle, text) where the text holds the needle; empty and null needles are in none.

    Each needle is looked up by the one of its grams that the fewest texts have, so texts meet the needles whose rarest gram
    they hold, and the whole needle is compared then. Only grams are counted and only rare ones are met, so neither the needles'
    substrings nor those of the texts are all shuffled, and neither side has to fit in memory.
    """
    wanted = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    every = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
    of_needles = wanted.where(F.length("needle") >= GRAM).select("needle", F.explode(_grams("needle", GRAM)).alias("gram"))
    of_texts = every.where(F.length("text") >= GRAM).select("text", F.explode(_grams("text", GRAM)).alias("gram"))
    counts = of_texts.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no text has is the rarest of all; its needle is in no text.
    rarest = of_needles.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rare"))
    chosen = rarest.where("rare.n > 0").select("needle", F.col("rare.gram").alias("gram"))
    long = of_texts.join(chosen, "gram").where(F.contains("text", "needle")).select("needle", "text")
    tiny = [_tiny(wanted, every, n) for n in range(1, GRAM)]
    out = long
    for t in tiny:
        out = out.unionByName(t)
    return out.select(F.col("needle").alias(needle), F.col("text").alias(text))


def _tiny(wanted: DataFrame, every: DataFrame, n: int) -> DataFrame:
    """As ``containing`` for the needles of ``n`` letters."""
    parts = every.where(F.length("text") >= n).select("text", F.explode(_grams("text", n)).alias("needle"))
    return parts.join(wanted.where(F.length("needle") == n), "needle").select("needle", "text")
