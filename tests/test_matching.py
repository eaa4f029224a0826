"""Matching against plain versions: phrases by a table, names that meet by an index."""

import itertools
import random
import re

from pyspark.sql import functions as F

from importlake.functions import text as x
from importlake.operators import matching, phrases


def in_turn(name, table):
    """The phrases applied one after the other, as whole words."""
    for phrase, token, _ in sorted(table, key=lambda r: (r[2], -len(r[0].split()))):
        name = re.sub(rf"(?<![^ ]){re.escape(phrase)}(?![^ ])", token, name)
    return name


def test_rewrite_by_brute_force(spark):
    rng = random.Random(5)
    table = [("a b c", "T1", 1), ("b c d", "T1", 2), ("d", "T2", 3), ("a b", "T3", 4), ("e e", "T4", 4)]
    names = ["", "a b c", "x"] + [" ".join(rng.choice("abcdex") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {r.name: r.rewritten for r in phrases.rewrite(df, "name", phrases.phrase_table(spark, table)).collect()}
    assert got == {n: in_turn(n, table) for n in names} | {None: None}
    empty = phrases.phrase_table(spark, [])
    assert {r.rewritten for r in phrases.rewrite(df, "name", empty).collect()} == {*names, None}


def test_grades_of_three_languages_are_one_word(spark):
    same = ["Extra Virgin Olive Oil", "EXTRAVIRGIN olive oil", "Olio Extra Vergine d'Oliva", "Olio extravergine di oliva", "OLIO EXTRAVERGINE DOLIVA", "Aceite de Oliva Virgen Extra", "virgen extra", "Extra-Vergine"]
    df = spark.createDataFrame([(f"Casa {n} classic 1L",) for n in same] + [("Casa extra light olive oil 1L",)], "name string")
    got = {r.name: r.norm for r in matching.normalized(df, "name", "norm").collect()}
    assert {v for k, v in got.items() if "light" not in k} == {f"casa {phrases.TOKEN} 1l"} and got["Casa extra light olive oil 1L"] == "casa extra light olive oil 1l"


def test_one_product_named_in_two_languages_matches(spark):
    targets = spark.createDataFrame([("De Cecco Olio Extra Vergine Di Oliva 1 L", "De Cecco"), ("De Cecco Extra Light Olive Oil", "De Cecco")], "target string, brand string")
    records = spark.createDataFrame([("DE CECCO EXTRA VIRGIN OLIVE OIL", "x"), ("Aceite de oliva virgen extra", "De Cecco SpA"), ("De Cecco penne", "x"), (None, "De Cecco SpA")], "candidate string, factory string")
    got = {(r.target[:14], r.candidate, r.via) for r in matching.cross_check(targets, records).collect()}
    assert got == {("De Cecco Olio ", "DE CECCO EXTRA VIRGIN OLIVE OIL", "name"), ("De Cecco Olio ", "Aceite de oliva virgen extra", "factory")}


def test_names_meet_by_index_as_all_with_all(spark):
    rng = random.Random(7)
    words = ["red", "re", "d", "bolt", "oz", "gear box", "x", "12", "brass"]
    names = lambda k: ["", "a"] + sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(k)})
    left = spark.createDataFrame([(n,) for n in names(60)], "l string").withColumn("l_tokens", x.content_tokens(F.col("l")))
    right = spark.createDataFrame([(n,) for n in names(60)], "r string").withColumn("r_tokens", x.content_tokens(F.col("r")))
    got = {(r.l, r.r, r.tier) for r in matching.may_match(left, right).collect()}
    every = left.crossJoin(right).withColumn("tier", matching.match_tier(F.col("r"), F.col("l"), F.col("r_tokens"), F.col("l_tokens")))
    assert got == {(r.l, r.r, r.tier) for r in every.collect() if r.tier is not None and r.l and r.r} and len(got) > 100


def test_lookup_finds_a_term_in_any_column(spark):
    rows = [("Oil", "Costa Works", "m"), ("Oil", "f", "COSTA d'Oro"), ("costa", "f", "m"), ("Oil", None, None), (None, "costa", None), ("Oil", "Costa Works", "m")]
    ih = spark.createDataFrame(rows, "sku_name string, factory string, manufacturer string")
    got = matching.lookup_candidates(spark.createDataFrame([("costa",), ("none",), ("co",)], "term string"), ih, 3).collect()
    order = sorted({r for r in rows if any("costa" in (c or "").lower() for c in r)}, key=lambda r: [(c is None, c or "") for c in r])
    for term in ("costa", "co"):
        assert [(r.sku_name, r.factory, r.manufacturer) for r in sorted(got, key=lambda r: r.n) if r.term == term] == order[:3]
    assert not [r for r in got if r.term == "none"]


def test_containing_has_needles_of_any_length(spark):
    from importlake.operators.containing import containing

    rng = random.Random(9)
    some = lambda n, k: sorted({"".join(rng.choice("ab ü") for _ in range(rng.randrange(0, k))) for _ in range(n)})
    needles, texts = some(80, 6), some(80, 14)
    got = containing(spark.createDataFrame([(n,) for n in needles], "n string"), "n", spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert sorted((r.n, r.t) for r in got) == sorted((n, t) for n, t in itertools.product(needles, texts) if n and n in t)
