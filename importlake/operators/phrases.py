"""Phrases of several languages, rewritten to one word by a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What names the same grade of oil in three languages. Whole phrases come before short forms of them.
WHOLE = [
    "extra virgin olive oil", "extravirgin olive oil",
    "olio extra vergine di oliva", "olio extra vergine d oliva", "olio extra vergine doliva", "olio extra vergine dioliva",
    "olio extravergine di oliva", "olio extravergine d oliva", "olio extravergine doliva", "olio extravergine dioliva",
    "aceite de oliva virgen extra", "aceite de oliva extra virgen",
]
SHORT = ["extra virgin", "extravirgin", "extra vergine", "extravergine", "virgen extra", "extra virgen"]
#: No word of a name.
TOKEN = "gradeextravirgin"
SCHEMA = "phrase string, token string, place int"


def phrase_table(spark: SparkSession, rows: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """(phrase, token, place): words of single spaces, what stands for them, and which phrases come first."""
    if rows is None:
        rows = [(p, TOKEN, 1) for p in WHOLE] + [(p, TOKEN, 2) for p in SHORT]
    return spark.createDataFrame(rows, SCHEMA)


def rewrite(names: DataFrame, column: str, phrases: DataFrame) -> DataFrame:
    """Distinct values of a column of folded names, each with ``rewritten``: every phrase of the table, as whole words, is its token.

    Of phrases that overlap in a name the one of the lesser place wins, then the one further left, then the longer. A name meets the phrases by an
    equality join of its runs of words, so the table may be long; a run is no longer than the longest phrase. A null name stays null, and
    a phrase that is in the table twice stands for its least token at its least place.
    """
    once = phrases.where("phrase <> ''").groupBy("phrase").agg(F.min(F.struct("place", "token")).alias("best")).select("phrase", "best.place", "best.token")
    longest = once.agg(F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(0)).alias("longest"))  # one row
    base = names.select(column).distinct()
    cut = base.where(F.col(column) != "").withColumn("words", F.split(column, " ")).crossJoin(F.broadcast(longest))
    runs = F.expr(
        "flatten(transform(sequence(1, size(words)), s -> transform(sequence(0, least(longest, size(words) - s + 1)), "
        "k -> named_struct('start', s, 'size', k, 'phrase', array_join(slice(words, s, k), ' ')))))"
    )
    spans = cut.select(column, "words", F.explode(runs).alias("run")).select(column, "words", "run.start", "run.size", "run.phrase").where("size > 0")
    met = spans.join(once, "phrase").groupBy(column).agg(F.first("words").alias("words"), F.array_sort(F.collect_list(F.struct("place", "start", (-F.col("size")).alias("less"), "token"))).alias("met"))
    taken = F.expr(
        "aggregate(met, cast(array() as array<struct<start: int, size: int, token: string>>), (a, m) -> "
        "if(exists(a, x -> x.start < m.start - m.less and m.start < x.start + x.size), a, concat(a, array(struct(m.start as start, -m.less as size, m.token as token)))))"
    )
    words = F.expr(
        "filter(transform(words, (w, i) -> case when exists(taken, x -> x.start = i + 1) then filter(taken, x -> x.start = i + 1)[0].token "
        "when exists(taken, x -> x.start <= i and i + 1 < x.start + x.size) then null else w end), w -> w is not null)"
    )
    done = met.withColumn("taken", taken).select(column, F.array_join(words, " ").alias("rewritten"))
    return base.join(done, column, "left").withColumn("rewritten", F.coalesce("rewritten", column))
