"""The corpus pipeline: five stages, each an operator of the library, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents; further columns of ``docs``, whatever their names, are left out. An empty
table gives an empty result in every stage. Nulls, empty and very long texts, ties and repeated rows: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from importlake.llm import line_dedup, mixing, registry, sentencepiece_lattice, simhash
from importlake.llm.common import discard, stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier rejects go. The model learns from the labels of the documents given.

    A null or empty text is scored by its zero features; rows alike in text have one score and go or stay together, repeated rows too.
    Without any label all documents stay.
    """
    scored = registry.quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= registry.QUALITY_LEAST).select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: passages that an earlier document has are cut; a document of which nothing is left goes.

    A null or empty text has no passages and stays as it is. Documents are ordered by id, a null id first, then by a hash of the
    text; rows alike in both are one document and keep what it keeps. ``n_chars`` is counted again where something was cut.
    """
    cut = line_dedup.remove(docs)
    left = cut.where((F.col("ld_deleted") == 0) | (F.trim(F.translate("text", "\t\r\n\x0b\x0c", "     ")) != ""))
    return left.withColumn("n_chars", F.when(F.col("ld_deleted") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near-duplicates stays, at five words and a similarity of 0.8.

    It is the one with the smallest id, a null id first, then with the smallest hash of the text; of repeated rows one stays. Texts
    without a word, null ones too, are alike, so one of them stays.
    """
    return simhash.keep_first(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: all documents, written in the order of the mix. A null source is a source of its own; repeated rows follow one another."""
    mixed = mixing.mix(docs, registry.MIX_WEIGHTS, other_weight=registry.MIX_OTHER)
    return mixed.orderBy("mix_at").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the piece ids of each document, with its place in the mix.

    The order of files doesn't outlive their reading, so the place is worked out again: it hangs on ids and texts only.
    A null text has null ids and a null ``n_ids``, an empty one none and 0; a repeated row is coded again.
    """
    coded = sentencepiece_lattice.encode(docs, registry.vocabulary_path())
    mixed = mixing.mix(coded, registry.MIX_WEIGHTS, other_weight=registry.MIX_OTHER)
    return mixed.select("doc_id", "source", "lang", "ids", F.size("ids").alias("n_ids"), "mix_at")


STAGES = [("quality", quality), ("line_dedup", repeated_lines), ("simhash", near_duplicates), ("mix", mix), ("sentencepiece", encode)]

#: No stage but the order of a mix can be put in SQL: a boosted model, patience diff, sampled fingerprints, best paths.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        done = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = done
    return docs
