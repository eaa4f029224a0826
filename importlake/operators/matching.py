"""Matching of retail products with import records, by tiers, with a review queue and revised verdicts."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from importlake.functions import text as x
from importlake.operators.containing import containing
from importlake.operators.phrases import phrase_table, rewrite
from importlake.sources.staging import staged

# Words that say nothing about what a product is, and words without weight in a comparison.
FILLERS = ["classic"]
STOP_WORDS = ["the", "a", "an", "of", "with", "for", "and", "in", "pack", "count", "fl", "oz", "ml", "l"]


def translate_names(df: DataFrame, dictionary: DataFrame, column: str, to: str = "english") -> DataFrame:
    """Names in another script by a dictionary (``column``, ``to``); one that isn't in it stays null, which is the backlog."""
    once = dictionary.groupBy(column).agg(F.min(to).alias("__to"))
    return df.join(once, column, "left").withColumn(to, F.when(x.is_non_latin(F.col(column)), F.col("__to")).otherwise(F.col(column))).drop("__to")


def normalized(names: DataFrame, column: str, to: str, phrases: DataFrame | None = None) -> DataFrame:
    """``names`` with ``to``: the folded name, phrases of several languages as one word, without fillers. Each distinct name is rewritten once."""
    folded = staged(names.withColumn("__folded", x.fold_text(F.col(column))))
    table = phrase_table(names.sparkSession) if phrases is None else phrases
    once = rewrite(folded.where(F.col("__folded").isNotNull()), "__folded", table)
    return folded.join(once, "__folded", "left").withColumn(to, x.drop_words(F.col("rewritten"), FILLERS)).drop("__folded", "rewritten")


def brand_in_text(brand: Column, text: Column) -> Column:
    """Whether a brand occurs in a text, with or without spaces."""
    return F.coalesce((brand != "") & (F.contains(text, brand) | F.contains(squeezed(text), squeezed(brand))), F.lit(False))


def match_tier(a: Column, b: Column, a_tokens: Column | None = None, b_tokens: Column | None = None) -> Column:
    """How two normalized names match: continuous (one holds the other), compact (without spaces), token_subset, or null.

    Their content tokens may be given where they have been worked out before the pairs were made.
    """
    either = lambda p, q: F.when(F.length(p) <= F.length(q), F.contains(q, p)).otherwise(F.contains(p, q))
    p = x.content_tokens(a) if a_tokens is None else a_tokens
    q = x.content_tokens(b) if b_tokens is None else b_tokens
    small, missing = F.least(F.size(p), F.size(q)), F.when(F.size(p) <= F.size(q), F.size(F.array_except(p, q))).otherwise(F.size(F.array_except(q, p)))
    return F.when((a == "") | (b == ""), None).when(either(a, b), "continuous").when(either(squeezed(a), squeezed(b)), "compact").when((small >= 2) & (missing == 0), "token_subset")


def is_ambiguous(tier: Column, via: Column) -> Column:
    """A match to be reviewed: by a loose tier or by the factory's brand; one set by hand never is."""
    return F.when(via == "manual", False).when(via == "factory", True).otherwise(tier.isin("compact", "token_subset"))


def squeezed(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def holding(brands: DataFrame, brand: str, texts: DataFrame, text: str) -> DataFrame:
    """Distinct (brand, text) for which ``brand_in_text`` holds: a text holds a brand if it does so without spaces."""
    b = brands.select(brand).distinct().withColumn("b_key", squeezed(F.col(brand)))
    t = texts.select(text).distinct().withColumn("t_key", squeezed(F.col(text)))
    return containing(b, "b_key", t, "t_key").join(b, "b_key").join(t, "t_key").select(brand, text)


def prepared_targets(targets: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """Distinct (target, brand) with their forms for matching, written once, as both ways of matching read them."""
    named = normalized(targets.select("target", "brand").distinct(), "target", "t_norm", phrases).withColumn("b_norm", x.fold_text(F.col("brand")))
    bare = named.withColumn("bare", without_phrase(F.col("t_norm"), F.col("b_norm")))
    return staged(bare.withColumns({"t_tokens": x.content_tokens(F.col("t_norm")), "bare_tokens": x.content_tokens(F.col("bare"))}))


def prepared_candidates(candidates: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """Distinct (candidate, factory) with their forms for matching; ``factory`` may be missing."""
    both = candidates if "factory" in candidates.columns else candidates.withColumn("factory", F.lit(None).cast("string"))
    named = normalized(both.select("candidate", "factory").distinct(), "candidate", "c_norm", phrases)
    return staged(named.withColumns({"c_tokens": x.content_tokens(F.col("c_norm")), "c_fold": x.fold_text(F.col("candidate")), "f_norm": x.fold_text(F.col("factory"))}))


def pairs(targets: DataFrame, candidates: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """Distinct (target, brand, candidate) whose candidate's name holds the brand, with their normalized forms."""
    t, c = prepared_targets(targets, phrases), prepared_candidates(candidates, phrases).drop("factory", "f_norm").distinct()
    return t.join(holding(t, "b_norm", c, "c_norm"), "b_norm").join(c, "c_norm")


def may_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (l, r, tier) of names that match by any tier, from (l, l_tokens) and (r, r_tokens).

    Names meet by an index instead of all with all: one without spaces holds the other, or the rarest word of the one is in the other.
    """
    a = left.where("l <> ''").groupBy("l").agg(F.first("l_tokens").alias("l_tokens")).withColumn("l_key", squeezed(F.col("l")))
    b = right.where("r <> ''").groupBy("r").agg(F.first("r_tokens").alias("r_tokens")).withColumn("r_key", squeezed(F.col("r")))
    keys = containing(a, "l_key", b, "r_key").unionByName(containing(b, "r_key", a, "l_key"))
    held = keys.join(a.select("l", "l_key"), "l_key").join(b.select("r", "r_key"), "r_key").select("l", "r")
    met = held.unionByName(_share_rarest(a, "l", b, "r")).unionByName(_share_rarest(b, "r", a, "l")).distinct()
    rows = met.join(a.drop("l_key"), "l").join(b.drop("r_key"), "r")
    return rows.withColumn("tier", match_tier(F.col("r"), F.col("l"), F.col("r_tokens"), F.col("l_tokens"))).where("tier is not null").select("l", "r", "tier")


def _share_rarest(small: DataFrame, s: str, large: DataFrame, g: str) -> DataFrame:
    """(s, g): names of two words or more, all of which are in the other; they meet by the word that the fewest of the others have."""
    words = large.select(g, F.col(f"{g}_tokens").alias("all"), F.explode(f"{g}_tokens").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    own = small.where(F.size(f"{s}_tokens") >= 2).select(s, F.col(f"{s}_tokens").alias("own"), F.explode(f"{s}_tokens").alias("word"))
    rarest = own.join(counts, "word", "left").groupBy(s).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rare"), F.first("own").alias("own"))
    met = rarest.where("rare.n > 0").select(s, "own", F.col("rare.word").alias("word")).join(words, "word")
    return met.where(F.size(F.array_except("own", "all")) == 0).select(s, g)


def contains_match(targets: DataFrame, candidates: DataFrame, overrides: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """(target, brand, candidate, tier, via): names that match by any tier; pairs confirmed by hand come first. ``phrases`` is a table as of ``phrase_table``."""
    return _by_name(prepared_targets(targets, phrases), prepared_candidates(candidates, phrases), overrides)


def _by_name(targets: DataFrame, candidates: DataFrame, overrides: DataFrame | None) -> DataFrame:
    held = holding(targets, "b_norm", candidates, "c_norm")
    branded = candidates.join(held.select("c_norm").distinct(), "c_norm", "left_semi")
    tiers = may_match(targets.select(F.col("t_norm").alias("l"), F.col("t_tokens").alias("l_tokens")), branded.select(F.col("c_norm").alias("r"), F.col("c_tokens").alias("r_tokens")))
    names = candidates.select("candidate", "c_norm").distinct()
    known = targets.join(tiers.select(F.col("l").alias("t_norm"), F.col("r").alias("c_norm"), "tier"), "t_norm")
    found = known.join(held, ["b_norm", "c_norm"]).join(names, "c_norm")
    out = found.select("target", "brand", "candidate", "tier", F.lit("name").alias("via"))
    if overrides is not None:
        sure = overrides.join(targets.select("target", "brand").distinct(), "target").select("target", "brand", "candidate", F.lit("manual").alias("tier"), F.lit("manual").alias("via"))
        out = sure.unionByName(out.join(sure, ["target", "brand", "candidate"], "left_anti"))
    return out


def without_phrase(text: Column, phrase: Column) -> Column:
    """A text of single spaces without the first place where a phrase stands in it as whole words."""
    padded, inner = F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))
    at = F.instr(padded, inner)
    cut = F.concat(F.substring(padded, F.lit(1), at), F.substring(padded, at + F.length(inner), F.length(padded)))
    return F.when((phrase == "") | (at == 0), text).otherwise(F.trim(cut))


def factory_fallback(targets: DataFrame, candidates: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """Candidates whose name doesn't hold the brand, told by the brand in their factory's name, where the names match without the brand.

    ``candidates`` have ``candidate`` and ``factory``. A name that holds the brand but didn't match is another product.
    """
    return _by_factory_brand(prepared_targets(targets, phrases), prepared_candidates(candidates, phrases))


def _by_factory_brand(t: DataFrame, candidates: DataFrame) -> DataFrame:
    c = candidates.where("factory is not null")
    tiers = may_match(t.select(F.col("bare").alias("l"), F.col("bare_tokens").alias("l_tokens")), c.select(F.col("c_norm").alias("r"), F.col("c_tokens").alias("r_tokens")))
    made = c.join(holding(t, "b_norm", c, "f_norm"), "f_norm").where(~brand_in_text(F.col("b_norm"), F.col("c_fold")))
    known = t.join(tiers.select(F.col("l").alias("bare"), F.col("r").alias("c_norm"), "tier"), "bare")
    out = known.join(made.select("b_norm", "c_norm", "candidate", "factory"), ["b_norm", "c_norm"])
    return out.select("target", "brand", "candidate", "factory", "tier", F.lit("factory").alias("via")).distinct()


def cross_check(targets: DataFrame, candidates: DataFrame, overrides: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """All matches with ``ambiguous``: those to be reviewed and those that are settled. What was set by hand isn't matched again."""
    t, c = prepared_targets(targets, phrases), prepared_candidates(candidates, phrases)
    primary = _by_name(t, c, overrides)
    fallback = _by_factory_brand(t, c).drop("factory").distinct()
    if overrides is not None:
        fallback = fallback.join(primary.where("via = 'manual'").select("target", "brand", "candidate"), ["target", "brand", "candidate"], "left_anti")
    return primary.unionByName(fallback).withColumn("ambiguous", is_ambiguous(F.col("tier"), F.col("via")))


def review_queue(checked: DataFrame) -> DataFrame:
    """Ambiguous pairs, each once, with the number of times they occur."""
    return checked.where("ambiguous").groupBy("target", "candidate").agg(F.count("*").alias("occurrences"), F.min("tier").alias("tier"), F.min("via").alias("via"))


def by_factory(matches: DataFrame) -> DataFrame:
    """The importers, SKUs and core names of each target and factory; rows without factory, importer or SKU are left out."""
    rows = matches.where("factory is not null and importer is not null and sku_name is not null")
    return rows.groupBy("target", "factory").agg(
        F.array_sort(F.collect_set("importer")).alias("importers"), F.array_sort(F.collect_set("sku_name")).alias("skus"), F.array_sort(F.collect_set(x.core_name(F.col("sku_name")))).alias("cores")
    )


def judge(groups: DataFrame) -> DataFrame:
    """A factory with one importer at most is exclusive, else parallel; a target is O if any of its factories is parallel, else X."""
    return groups.withColumn("verdict", F.when(F.size("importers") <= 1, "exclusive").otherwise("parallel")).groupBy("target").agg(
        F.count("*").alias("factories"), F.count_if(F.col("verdict") == "parallel").alias("parallel_factories"), F.when(F.bool_or(F.col("verdict") == "parallel"), "O").otherwise("X").alias("status")
    )


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Drop the pairs that a reviewer rejected; an ambiguous pair without a decision stays, marked pending. Of repeated decisions a rejection holds."""
    once = decisions.groupBy("target", "candidate").agg(F.min("accepted").alias("accepted"))
    joined = rows.join(once, ["target", "candidate"], "left")
    return joined.where(F.coalesce("accepted", F.lit(True))).withColumn("pending", F.col("ambiguous") & F.col("accepted").isNull()).drop("accepted")


def revise_status(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """The status of each target before and after decisions, whether it changed, and whether any pair is pending."""
    kept = apply_decisions(matches, decisions)
    before = judge(by_factory(matches)).select("target", F.col("status").alias("old_status"))
    after = judge(by_factory(kept)).select("target", F.col("status").alias("new_status"))
    pending = kept.groupBy("target").agg(F.bool_or("pending").alias("pending"))
    out = before.join(after, "target", "left").join(pending, "target", "left")
    return out.withColumns({"changed": ~F.col("old_status").eqNullSafe(F.col("new_status")), "pending": F.coalesce("pending", F.lit(False))})


def revise_status_of(pairs: DataFrame, records: DataFrame, decisions: DataFrame) -> DataFrame:
    """As ``revise_status`` of the ``pairs`` (target, candidate, ambiguous), each with all ``records`` (candidate, sku_name, factory, importer) of its candidate.

    The importers of a candidate are looked at once, not once for each of its targets: a candidate of which one factory has two settles its targets.
    Only targets that none settles meet the factories of their candidates.
    """
    told = F.when(F.col("sku_name").isNotNull() & F.col("factory").isNotNull(), F.col("importer"))
    made = records.groupBy("candidate", "factory").agg(F.min(told).alias("first"), F.max(told).alias("last"))
    known = made.groupBy("candidate").agg(F.coalesce(F.bool_or(F.col("first") < F.col("last")), F.lit(False)).alias("parallel"), (F.count("first") > 0).alias("told"))
    once = decisions.groupBy("target", "candidate").agg(F.min("accepted").alias("accepted"))
    stays = F.coalesce("accepted", F.lit(True))
    met = pairs.join(known, "candidate").join(once, ["target", "candidate"], "left")
    # A null target meets nothing when the verdicts are joined, so it has none after the decisions.
    met = staged(met.select("target", "candidate", "parallel", "told", (stays & F.col("target").isNotNull()).alias("stays"), (F.col("ambiguous") & F.col("accepted").isNull()).alias("pending")))
    seen = met.groupBy("target").agg(
        F.bool_or("parallel").alias("old_o"), F.bool_or("told").alias("old"), F.bool_or(F.expr("parallel and stays")).alias("new_o"), F.bool_or(F.expr("told and stays")).alias("new"),
        F.bool_or(F.expr("pending and stays")).alias("pending"),
    ).where("old")
    open_ = seen.where("not old_o or new and not new_o").select(F.col("target").alias("__target"))
    rows = met.where("told").join(open_, F.col("target").eqNullSafe(F.col("__target")), "left_semi").join(made.where("first is not null"), "candidate")
    ends = rows.groupBy("target", "factory").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.min(F.expr("if(stays, first, null)")).alias("c"), F.max(F.expr("if(stays, last, null)")).alias("d"))
    across = ends.groupBy(F.col("target").alias("__target")).agg(F.bool_or(F.expr("a < b")).alias("old_across"), F.bool_or(F.expr("c < d")).alias("new_across"))
    out = seen.join(across, F.col("target").eqNullSafe(F.col("__target")), "left")
    status = lambda t: F.when(F.col(f"{t}_o") | F.coalesce(f"{t}_across", F.lit(False)), "O").when(F.col(t), "X")
    out = out.select("target", status("old").alias("old_status"), status("new").alias("new_status"), F.coalesce("pending", F.lit(False)).alias("pending"))
    return out.withColumn("changed", ~F.col("old_status").eqNullSafe(F.col("new_status")))


def set_mismatch(a: DataFrame, b: DataFrame, key: str, values: str) -> DataFrame:
    """Keys whose sets differ between two runs, with what each lacks. A key that a run lacks has the empty set."""
    none = F.expr("cast(array() as array<string>)")
    joined = a.select(key, F.col(values).alias("x")).join(b.select(key, F.col(values).alias("y")), key, "full")
    x_, y_ = F.coalesce("x", none), F.coalesce("y", none)
    out = joined.select(key, F.array_sort(F.array_except(x_, y_)).alias("only_first"), F.array_sort(F.array_except(y_, x_)).alias("only_second"))
    return out.where((F.size("only_first") > 0) | (F.size("only_second") > 0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(a, b)])


def similarity(a: Column, b: Column) -> Column:
    """The largest of the sequence ratio and the shares of each text's words that the other has."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(STOP_WORDS) & ~F.replace(w, F.lit("."), F.lit("")).rlike("^[0-9]+$")))
    p, q = words(a), words(b)
    both = F.size(F.array_intersect(p, q))
    return F.greatest(sequence_ratio(a, b), F.coalesce(F.try_divide(both, F.size(p)), F.lit(0.0)), F.coalesce(F.try_divide(both, F.size(q)), F.lit(0.0)))


def lookup_candidates(terms: DataFrame, ih: DataFrame, limit: int, columns: tuple[str, ...] = ("sku_name", "factory", "manufacturer")) -> DataFrame:
    """For each term the first ``limit`` distinct combinations of ``columns`` in the records, ordered by them, of which any column holds the term in any case.

    Combinations are distinct before the join, and each distinct text is searched once, whatever columns it stands in.
    """
    rows = ih.select(*columns).distinct()
    texts = rows.select(F.explode(F.array(*[F.lower(c) for c in columns])).alias("low")).distinct()
    asked = terms.select("term").distinct().withColumn("low_term", F.lower("term"))
    held = containing(asked, "low_term", texts, "low").join(asked, "low_term").groupBy("low").agg(F.collect_set("term").alias("terms"))
    met = rows
    for c in columns:
        met = met.withColumn("low", F.lower(c)).join(held.withColumnRenamed("terms", f"in_{c}"), "low", "left").drop("low")
    found = F.array_distinct(F.flatten(F.array(*[F.coalesce(f"in_{c}", F.array().cast("array<string>")) for c in columns])))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(*[F.asc_nulls_last(c) for c in columns]))
    return met.select(F.explode(found).alias("term"), *columns).withColumn("n", rank).where(F.col("n") <= limit)


def check_products(targets: DataFrame, ih: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """The verdict of each target, from the names and factories of the records."""
    t, c = prepared_targets(targets, phrases), prepared_candidates(ih.select(F.col("sku_name").alias("candidate"), "factory"), phrases)
    records = ih.select(F.col("sku_name").alias("candidate"), "sku_name", "factory", "importer").distinct()
    rows = _by_name(t, c, None).select("target", "candidate").distinct().join(records, "candidate")
    more = _by_factory_brand(t, c).select("target", "candidate", "factory").distinct().join(records, ["candidate", "factory"])
    return judge(by_factory(rows.unionByName(more)))
