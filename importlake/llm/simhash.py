"""Operator 6: near-duplicates by SimHash, found through segment popcounts.

A fingerprint's 32 two-bit segments give a vector of 32 popcounts. One differing bit moves one popcount by one, so the
Manhattan distance of two vectors is a lower bound of the Hamming distance of the fingerprints. Vectors at distance two or
less share a grid cell that is at most one step from each, so every fingerprint enters its own cell and those one step
away (49 of them on average), and two fingerprints that can be linked meet in one cell. Cells are then checked exactly:
a cell with two fingerprints by the bits that differ, a fuller one by the same midpoint argument on single bits, which
needs no pairs however many fingerprints a cell holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from importlake.llm.common import arrow_rows, discard, portions, sieve, stage
from importlake.llm.components import connected_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included. Fewer words than a shingle: the whole sequence; no words: none."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # on the ASCII white space
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[: len(parts) - words].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set, as a signed number; zero if there are none."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        octets = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """The SimHash of a text over its word shingles; null and empty texts give zero."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(x, words)) for x in texts], dtype="int64")

    return of(text)


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def popcount_cells(fingerprints: DataFrame) -> DataFrame:
    """(fp, cell): the cell of each fingerprint's popcount vector and all cells one step away, each packed into a long.

    The steps are rows before they are cells, so that the code Spark generates has one step and not all 65, whose compilation took over 100 MB of the driver.
    """
    low, high = f"(fp & {0x5555555555555555}L)", f"(shiftrightunsigned(fp, 1) & {0x5555555555555555}L)"
    steps = fingerprints.selectExpr("fp", f"shiftleft({low} & {high}, 1) | ({low} ^ {high}) as packed").selectExpr("fp", "packed", "explode(sequence(0, 64)) as i")
    count = "(shiftrightunsigned(packed, i & 62) & 3L)"
    cell = f"case when i = 64 then packed when i % 2 = 0 and {count} <= 1 then packed ^ shiftleft(1L, i) when i % 2 = 1 and {count} >= 1 then packed ^ shiftleft(3L, i - 1) end"
    return steps.selectExpr("fp", f"{cell} as cell").where("cell is not null")  # 0 and 1 change places, or 1 and 2


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at two or fewer differing bits.

    ``fingerprints`` has one row for each distinct ``fp``. Rows made: 49 for each fingerprint, and 65 for each that
    shares a cell with two or more others; never a product of a group with itself.
    """
    cells = popcount_cells(fingerprints)
    shared = stage(
        cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "cells"
    )
    two = shared.where("n = 2 and bit_count(a ^ b) <= 2").select("a", "b")
    full = shared.where("n > 2").select("cell")
    crowd = stage(cells.join(full, "cell", "left_semi").select("fp").distinct(), "crowd")
    flips = crowd.selectExpr("fp", "explode(sequence(0, 64)) as i")
    keys = flips.selectExpr("fp", "case when i = 64 then fp else fp ^ shiftleft(1L, i) end as key")
    met = stage(keys.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "keys")
    stars = keys.join(met, "key").where("fp <> a").select("a", F.col("fp").alias("b"))
    edges = stage(two.unionByName(stars).distinct(), "links")
    discard(shared, crowd, met)
    return edges


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Return (doc_id, fp, component_id) for each row: the smallest id reachable over links of two or fewer bits.

    Equal fingerprints are one node, so copies are never expanded into pairs. A null text is an empty one; all
    texts without a word have fingerprint zero and are linked like any other. A null id takes part, but isn't the
    smallest unless its whole component has no other. Repeated rows give a row each. An empty table gives an empty result.
    """
    prints = stage(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")), "prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    edges = links(nodes.select("fp"))
    linked = connected_components(edges)
    discard(edges)
    named = stage(linked.join(nodes, linked.node == nodes.fp).select("fp", "component", "first"), "named")
    smallest = stage(named.groupBy("component").agg(F.min("first").alias("least")), "least")
    of_linked = named.join(smallest, "component").select("fp", "least")
    classes = stage(
        nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "classes"
    )
    discard(nodes, named, smallest)
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


# Near-duplicates at a given similarity of their shingle sets.
#
# Two bits of 64 only link texts that differ by a word or so, and at a similarity of 0.8 two fingerprints differ by ten bits. So links
# of fingerprints, once verified on the shingle sets, only give the first components, which spare the comparisons within
# them. What is left is found by an exact prefix filter: with all shingles in one order, rare ones first, two like sets
# agree on one within their first fifth (at 0.8). Pairs of two components that meet there are compared exactly.

#: Buckets of the counts that tell rare shingles from common ones, and slices in which they are summed.
BUCKETS, SLICES = 1 << 18, 64
#: A group of up to this many is compared in all pairs, a larger one with centres: one in the first round, about 8, 64, 512 and so on after that.
FEW, GROWTH = 4, 8
#: Sizes of sets are taken together in classes of this ratio.
CLASS = 1.05


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def bucket_counts(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """How many texts hold a shingle of each bucket of hashes, over all texts: a table of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for part in portions(b[text_col]):
                sets = np.concatenate([shingle_set(t, words) for t in part])
                total += np.bincount((sets >> np.uint64(46)).view(np.int64), minlength=BUCKETS)
        yield pd.DataFrame({"slice": range(SLICES), "counts": [x.tobytes() for x in total.reshape(SLICES, -1)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["slice"], b["counts"]):
                totals[k] = totals.get(k, 0) + np.frombuffer(x, np.int64)
        yield pd.DataFrame({"slice": list(totals), "counts": [x.tobytes() for x in totals.values()]})

    kind = "slice int, counts binary"
    with arrow_rows(docs.sparkSession, 1000):
        rows = docs.select(text_col).mapInPandas(count, kind).repartition("slice").mapInPandas(add, kind).collect()
    out = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def prefix(hashes: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The shingles, rarest bucket first, among which any set with a similarity of ``least`` to this one has a shingle of its own prefix."""
    order = np.argsort(counts[(hashes >> np.uint64(46)).view(np.int64)], kind="stable")  # the hashes are sorted, so ties are by hash
    return hashes[order[: len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1]] if len(hashes) else hashes


def _looked(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """A staged (id, mark, node, fp, size, prefix) for each row: a hash of its shingle set, its fingerprint, the size of the set and its prefix."""
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, text_col, words))

    @F.pandas_udf("node string, fp long, size int, prefix array<long>")
    def look(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            every = shingle_hashes(t, words)
            own = np.unique(every)
            rows.append((xxhash.xxh3_128_hexdigest(own.tobytes()), majority(every), len(own), prefix(own, counts.value, least).view(np.int64)))
        return pd.DataFrame(rows, columns=["node", "fp", "size", "prefix"])

    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), look(text_col).alias("x"))
    with arrow_rows(docs.sparkSession, 1000):  # each row holds a whole text
        return stage(keyed.select("id", "mark", "x.*"), "looked")


def _postings(heads: DataFrame, least: float) -> DataFrame:
    """A staged (h, one, low, n, size, k): groups ``h`` of the nodes that share a shingle, at place k (from 1) of their prefixes, and may be alike by their sizes.

    There is a group for each shingle and pair of size classes. How far down a shingle may stand depends on how large the other set is at
    least, so a group only takes those that stand high enough for a partner of its other class. ``one``: both classes are the same; else ``low`` tells them apart.
    """
    each = heads.select("n", "size", F.posexplode("prefix").alias("k", "shingle"))
    shared = stage(each.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1").select("shingle"), "shared")
    met = each.join(shared, "shingle").selectExpr("shingle", "n", "size", "k + 1 as k", f"cast(floor(ln(size) / ln({CLASS})) as int) as own")
    other = f"explode(sequence(cast(floor(ln({least} * size) / ln({CLASS}) - 1e-9) as int), cast(floor(ln(size / {least}) / ln({CLASS}) + 1e-9) as int)))"
    paired = met.withColumn("other", F.expr(other)).where(f"k <= size + 1 - {least} / (1 + {least}) * (size + greatest(pow({CLASS}, other) * (1 - 1e-9), {least} * size)) + 1e-6")
    keyed = stage(paired.selectExpr("xxhash64(shingle, least(own, other), greatest(own, other)) as h", "own = other as one", "own <= other as low", "n", "size", "k"), "paired")
    out = stage(keyed.join(_two_sided(keyed), "h", "left_semi"), "postings")
    discard(shared, keyed)
    return out


def _two_sided(members: DataFrame, and_also: str = "true") -> DataFrame:
    """The groups that have a pair to compare."""
    sides = members.groupBy("h").agg(F.bool_or("one").alias("one"), F.bool_or("low").alias("some"), F.bool_and("low").alias("every"), F.count("*").alias("of"), *[f(c).alias(to) for f, c, to in ((F.min, "component", "p"), (F.max, "component", "q")) if c in members.columns])
    return stage(sides.where(f"of > 1 and (one or some <> every) and {and_also}").select("h"), "sides")


def _fingerprint_pairs(heads: DataFrame) -> DataFrame:
    """A staged (a, b) of nodes whose fingerprints are linked, or equal; equal ones are linked to one of them."""
    first = stage(heads.groupBy("fp").agg(F.min("n").alias("n")), "prints")
    edges = links(first.select("fp"))
    equal = heads.join(first.withColumnRenamed("n", "m"), "fp").where("n <> m").selectExpr("m as a", "n as b")
    x, y = first.selectExpr("fp as a", "n as x"), first.selectExpr("fp as b", "n as y")
    out = stage(equal.unionByName(edges.join(x, "a").join(y, "b").selectExpr("least(x, y) as a", "greatest(x, y) as b")), "alike")
    discard(first, edges)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """A staged (a, b, alike) for distinct pairs of nodes, by the exact Jaccard similarity of their shingle sets."""

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            if p is None:
                out.append(False)
                continue
            same = len(np.intersect1d(p, q, assume_unique=True))
            out.append(same >= least * (len(p) + len(q) - same) - 1e-9)
        return pd.Series(out, dtype=bool)

    x = sets.select(F.col("n").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("n").alias("b"), F.col("hashes").alias("y"))
    near = pairs.join(x, "a").join(y, "b")
    # No more than a fifth of the larger set may be missing from the smaller, at 0.8; so sizes alone rule out many.
    fit = F.least(F.size("x"), F.size("y")) >= F.lit(least) * F.greatest(F.size("x"), F.size("y")) - 1e-6
    checked = near.select("a", "b", alike(F.when(fit, F.col("x")), F.when(fit, F.col("y"))).alias("alike"))
    with arrow_rows(pairs.sparkSession, 500):  # each row holds two sets
        return stage(checked, "verified")


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """The members, with their component by the links known so far, of the groups that don't lie in one component as a whole."""
    named = stage(members.join(joined.withColumnRenamed("node", "n"), "n", "left").withColumn("component", F.coalesce("component", "n")), "named")
    split = _two_sided(named, "p <> q")
    out = stage(named.join(split, "h", "left_semi"), "open")
    discard(named, split)
    return out


def _crowd(members: DataFrame, done: DataFrame, turn: int) -> DataFrame:
    """The members of open groups with the group's size and, in a large group, whether the member is a centre of this round.

    The member with the most links is one: it may be what the others are noisy copies of. The rest are drawn by a hash of the node alone, so that
    groups draw the same ones: outside the group's largest component, since only pairs of two components are open, or in a group of two classes from the smaller class.
    """
    degrees = done.where("alike").select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("degree"))
    top = F.max(F.struct(F.coalesce("degree", F.lit(0)), (-F.col("n")).alias("m"))).alias("top")
    parts = members.join(degrees, "n", "left").groupBy("h", "component").agg(F.count("*").alias("of"), F.count_if("low").alias("lows"), top)
    sizes = parts.groupBy("h").agg(F.sum("of").alias("of"), F.max(F.struct("of", "component")).alias("main"), F.sum("lows").alias("lows"), F.max("top").alias("top"))
    plan = stage(sizes.selectExpr("h", "of", "of - main.of as far", "main.component as main", "-top.m as top", "lows", "2 * lows <= of as fewer"), "sizes")
    of_class = F.when(F.col("one"), F.col("component") != F.col("main")).otherwise(F.col("low") == F.col("fewer"))
    among = F.when(F.col("one"), F.col("far")).otherwise(F.least("lows", F.col("of") - F.col("lows")))
    drawn = of_class & (F.pmod(F.xxhash64("n", F.lit(turn)), F.lit(1 << 30)) * among < F.lit((GROWTH ** min(turn, 10) - 1) << 30))
    out = stage(members.join(plan, "h").withColumn("centre", (F.col("of") > FEW) & (drawn | (F.col("n") == F.col("top")))).drop("far", "main", "top", "lows", "fewer"), "crowd")
    discard(plan)
    return out


def _met(crowd: DataFrame, least: float) -> DataFrame:
    """(a, b) of two components: in small groups all, in large ones each member with each centre.

    Two sets can be alike if their sizes are, and if what follows the shared shingle in both is long enough; so it is at the first one they share.
    """
    other = crowd.select("h", *[F.col(c).alias(f"to_{c}") for c in ("n", "centre", "size", "k", "component", "low")])
    fits = (
        f"component <> to_component and (one or low <> to_low) and ((of <= {FEW} and n < to_n) or to_centre) and least(size, to_size) >= {least} * greatest(size, to_size) - 1e-6 "
        f"and 1 + least(size - k, to_size - to_k) >= {least} / (1 + {least}) * (size + to_size) - 1e-6"
    )
    return crowd.join(other, "h").where(fits).selectExpr("least(n, to_n) as a", "greatest(n, to_n) as b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """Return a staged (id, mark, times, group_id, group_mark) for each distinct pair of id and text: how many rows it has, and the first document of its group.

    Groups are the components of links between texts whose sets of word shingles have a Jaccard similarity of ``least`` or
    more; no link is lost. Words and short texts are taken as for fingerprints; texts without a word are alike. The first
    document is that with the smallest id, a null id before all others, and of one id that with the smallest hash of its text (``mark``).
    Texts whose fingerprints are linked are compared first. Then the nodes whose prefixes share a shingle, and that may be alike by their sizes, form a group: up to
    FEW are compared in all pairs, larger groups with centres, only ever across components. A group is settled when its
    members that weren't a centre lie in one component, as no pair of them can change the groups then; the others go on with more centres,
    up to all members. Repeated rows are one document. An empty table gives an empty result.
    """

    @F.pandas_udf("array<long>")
    def sets_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).view(np.int64) for t in texts])

    looked = _looked(docs, id_col, text_col, words, least)
    whole = stage(
        looked.groupBy("node").agg(F.min(F.struct("id", "mark")).alias("first"), *[F.first(c).alias(c) for c in ("fp", "size", "prefix")]).withColumn("n", F.monotonically_increasing_id()), "whole"
    )
    counted = stage(looked.groupBy("id", "mark", "node").agg(F.count("*").alias("times")), "counted")
    discard(looked)
    heads, postings = whole.select("node", "n", "first", "fp"), _postings(whole, least)
    pairs = _fingerprint_pairs(heads)
    asked = postings.select("n").unionByName(pairs.selectExpr("a as n")).unionByName(pairs.selectExpr("b as n")).distinct()
    wanted = stage(asked.join(heads, "n").select("n", F.col("first.id").alias("w_id"), F.col("first.mark").alias("w_mark")), "wanted")
    passes = sieve(wanted.select(F.xxhash64("w_id", "w_mark")))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).where(passes(F.xxhash64("id", "mark")))
    found = texts.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).dropDuplicates(["n"])
    with arrow_rows(docs.sparkSession, 1000):
        sets = stage(found.select("n", sets_of("text").alias("hashes")), "sets")
    done = _verified(pairs, sets, least)
    joined = connected_components(done.where("alike").select("a", "b"))
    members, turn = _open(postings, joined), 0
    discard(pairs, wanted, postings)
    while not members.isEmpty():
        crowd = _crowd(members, done, turn)
        fresh = stage(_met(crowd, least).join(done, ["a", "b"], "left_anti"), "fresh")
        more = _verified(fresh, sets, least)
        both = stage(done.unionByName(more), "done")
        if not more.where("alike").isEmpty():
            joined = connected_components(both.where("alike").select("a", "b"))
        # Only members of large groups that haven't been a centre can have open pairs, with one another.
        left = _open(crowd.where(f"of > {FEW} and not centre").select("h", "one", "low", "n", "size", "k"), joined)
        discard(members, crowd, fresh, more, done)
        members, done, turn = left, both, turn + 1
    classes = stage(heads.join(joined.withColumnRenamed("node", "n"), "n", "left").select("node", "first", F.coalesce("component", "n").alias("component")), "near")
    firsts = stage(classes.groupBy("component").agg(F.min("first").alias("head")), "firsts")
    named = classes.join(firsts, "component").select("node", "head")
    out = stage(counted.join(named, "node").select("id", "mark", "times", F.col("head.id").alias("group_id"), F.col("head.mark").alias("group_mark")), "groups")
    discard(counted, whole, sets, members, done, classes, firsts)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the first. Of rows alike in id and text one stays, whichever.

    Nulls, empty texts and ties are taken as in ``near_duplicates``. Only texts that may have to go are shuffled. Columns of the input
    whose names begin with ``nd_`` are dropped. An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("nd_")])
    groups = near_duplicates(docs, id_col, text_col, words, least)
    first = (F.col("id").eqNullSafe(F.col("group_id"))) & (F.col("mark") == F.col("group_mark"))
    passes = sieve(groups.where(~first | (F.col("times") > 1)).select(F.xxhash64("id", "mark")))
    may = passes(F.xxhash64(id_col, F.xxhash64(text_col)))
    heads = groups.where(first).select(F.col("id").alias("nd_id"), F.col("mark").alias("nd_mark"))
    keyed = docs.where(may).withColumn("nd_key", F.xxhash64(text_col))
    kept = keyed.join(heads, keyed[id_col].eqNullSafe(heads["nd_id"]) & (keyed["nd_key"] == heads["nd_mark"]))
    return docs.where(~may).unionByName(kept.dropDuplicates(["nd_id", "nd_mark"]).select(*docs.columns))
