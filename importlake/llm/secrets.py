"""Operator 2: secret scans that link the parts of a credential.

Some parts are telling on their own (the base kinds ``assign``, ``access`` and ``hex``). Others are weak: a user or key
identifier, a bare token and an endpoint occur in clean text as well. A weak part is reported only when the parts that
complete it stand close by: an interval join pairs each weak part with the grid of intervals in which identifiers, secrets
and endpoints of the same document lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from importlake.llm.common import stage

# The kinds, in the order in which spans at one place are listed, and their patterns. A pattern that
# ends in an open run is followed by the least length of the whole match or, for assign, of the value.
KINDS = ("assign", "access", "hex", "ident", "token", "endpoint")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i)(?<![A-Za-z0-9])(?<!secret[_-])(?:user(?:name)?|login|client_?id|access_?key(?:_?id)?|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?i)(?:(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]+://[A-Za-z0-9._~:@-]+(?:/[A-Za-z0-9._~%/-]*)?|(?<![A-Za-z0-9])(?:host|server|endpoint)\x20*[:=]\x20*[A-Za-z0-9._:-]{3,})"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "token": TOKEN, "endpoint": ENDPOINT}
#: What must lie within the scope of a weak part.
NEEDS = {"ident": ("secret",), "token": ("identifier",), "endpoint": ("identifier", "secret")}
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "token": "secret", "endpoint": "endpoint"}


#: Matches that one fold adds up; longer lists are folded in pieces of this many, as each step of a fold copies what it has.
FOLD = 256


def _running(steps: Column) -> Column:
    """(total, out): the places (s, e) of matches, given as gaps and lengths, and where the last one ends."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s: int, e: int>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["g"]
        return F.struct((s + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e")))).alias("out"))

    return F.aggregate(steps, start, step)


def _shifted(x: Column, by: Column) -> Column:
    return F.transform(x, lambda y: F.struct((y["s"] + by).alias("s"), (y["e"] + by).alias("e")))


def spans(text: Column, kind: str) -> Column:
    """All matches of a kind as an array of (s, e), in code points, end exclusive, leftmost and non-overlapping.

    The text is split at the matches; what lies between them and the matches themselves give the places as running sums.
    """
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda x: F.length(x))
    ok = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda x: F.length(x) >= ASSIGN_VALUE) if kind == "assign" else None
    steps = F.zip_with(gaps, F.transform(found, lambda x: F.length(x)), lambda g, n: F.struct(g.alias("g"), F.coalesce(n, F.lit(0)).alias("n")))
    # What follows the last match is a gap too, and would end as an empty match.
    pieces = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(FOLD)), lambda i: _running(F.slice(steps, i, F.lit(FOLD))))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<s: int, e: int>>>)").alias("out"))
    put = lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(_shifted(x["out"], a["at"]))).alias("out"))
    every = F.flatten(F.aggregate(pieces, start, put)["out"])
    all_spans = F.slice(every, F.lit(1), F.size(every) - 1)
    if ok is not None:
        all_spans = F.transform(
            F.filter(F.arrays_zip(all_spans.alias("x"), ok.alias("ok")), lambda x: x["ok"]), lambda x: F.struct(x["x"]["s"].alias("s"), x["x"]["e"].alias("e"))
        )
    none = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    return F.when(F.regexp_like(text, pattern), all_spans).otherwise(none)


def _of_kind(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def _at_order(order: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"))


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A staged row for each row of ``docs``: its key ``row``, doc_id and the spans of each kind. Reads the texts once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), *[spans(text, k).alias(k) for k in KINDS]), "parts")


def _bins(scope: int, reach: int) -> Column:
    """The intervals that a part touches, and ``reach`` more on either side."""
    return F.explode(F.sequence(F.expr(f"s div {scope} - {reach}"), F.expr(f"(e - 1) div {scope} + {reach}")))


def all_parts(found: DataFrame, scope: int) -> DataFrame:
    """A staged (row, kind, s, e) of all parts in rows with weak ones. A weak part that a base span covers isn't a part of its own."""
    apart = found.where(F.size("ident") + F.size("token") + F.size("endpoint") > 0)
    long = stage(apart.select("row", F.explode(F.concat(*[F.transform(k, _of_kind(k)) for k in KINDS])).alias("p")).select("row", "p.*"), "long")
    weak = F.col("kind").isin(*NEEDS)
    base = long.where(~weak).withColumn("bin", _bins(scope, 0)).selectExpr("row", "bin", "s as base_s", "e as base_e")
    covered = long.where(weak).withColumn("bin", _bins(scope, 0)).join(base, ["row", "bin"]).where("base_s < e and s < base_e").select("row", "kind", "s", "e")
    return stage(long.join(covered, ["row", "kind", "s", "e"], "left_anti"), "own")


def link(long: DataFrame, scope: int) -> DataFrame:
    """The weak parts (row, kind, s, e) of ``long`` that have each complementary role within ``scope`` code points.

    The documents are cut into intervals of ``scope`` code points. For each interval and role the join side keeps the
    first start and the last end only, which decides exactly whether a part of that role lies near enough; so a weak
    part meets at most three rows for each role, however many parts there are.
    """
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    weak = long.where(F.col("kind").isin(*NEEDS)).withColumn("bin", _bins(scope, 1))
    # A part lies in each interval that it touches.
    grid = (
        long.withColumn("bin", _bins(scope, 0))
        .withColumn("s", F.greatest("s", F.col("bin") * scope))
        .withColumn("e", F.least("e", (F.col("bin") + 1) * scope))
        .groupBy("row", "bin", role.alias("role"))
        .agg(F.min("s").alias("first"), F.max("e").alias("last"))
    )
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    # A gap of at most scope code points between the part and the interval's nearest content, on either side.
    near = weak.join(grid, ["row", "bin"]).where(
        F.array_contains(needs[F.col("kind")], F.col("role")) & (F.col("first") - F.col("e") <= scope) & (F.col("s") - F.col("last") <= scope)
    )
    return near.groupBy("row", "kind", "s", "e").agg(F.count_distinct("role").alias("roles")).where(F.col("roles") == F.size(needs[F.col("kind")])).drop("roles")


def listed(entries: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas. Entries: (s, order, e)."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(entries), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """Return for each row: doc_id, n_assign, n_access, n_hex, base (text), spans (text).

    ``scope`` is the largest gap, in code points, between the parts of one credential. A null text is an empty one
    and has no spans; a repeated row is scanned on its own; a null id stays null. An empty table gives an empty result.
    """
    found = parts(docs, id_col, text_col)
    linked = link(all_parts(found, scope), scope).withColumn("k", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1)
    added = stage(linked.groupBy("row").agg(F.collect_list(F.struct("s", "k", "e")).alias("added")), "linked")
    base = F.concat(*[F.transform(k, _at_order(i)) for i, k in enumerate(KINDS[:3])])
    none = F.expr("cast(array() as array<struct<s: int, k: int, e: int>>)")
    return found.withColumn("b", base).join(added, "row", "left").select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        listed(F.col("b")).alias("base"),
        listed(F.concat("b", F.coalesce("added", none))).alias("spans"),
    )
