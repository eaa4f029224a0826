"""Operator 7: delete passages that an earlier document has, by aligning pairs of documents line by line.

Documents that overlap are found through the hashes of their lines: each repeated line links every later document that
holds it to the first one that does, so a line that a third of all documents share costs a row for each and no pairs
among them. Each linked pair is aligned by patience diff, and the blocks of lines that the two have in common go from the
later document. A passage whose every line has another, earlier first holder is found by its runs: the shortest runs of lines
that have enough words, from each line on and up to each line, cover any long enough block, and a run that an earlier
document has goes, whichever document that is.
"""

from __future__ import annotations

import functools
import operator
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from importlake.llm.common import discard, sieve, stage

OTHER_SPACES = "\t\r\x0b\x0c"
BLANK = 0  # stands for the hash of a line of white space
OWN = 1  # and this for lines that no other document has
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: A letter of a script that is written without spaces counts as a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first place, whose second places rise too."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        tails[p : p + 1] = [j]
        at[p : p + 1] = [k]
        back[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (in a, in b). Lines that occur once in either text are anchors.

    From each anchor the alignment spreads over equal neighbours, and between anchors the search begins anew; where no line occurs once, the
    n-th occurrences of a line in the two texts are anchors.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        p, q, r, s = todo.pop()
        while p < q and r < s and a[p] == b[r]:
            out.append((p, r))
            p, r = p + 1, r + 1
        while p < q and r < s and a[q - 1] == b[s - 1]:
            q, s = q - 1, s - 1
            out.append((q, s))
        if p == q or r == s:
            continue
        in_a, in_b = Counter(a[p:q]), Counter(b[r:s])
        once = {x: k for k, x in enumerate(b[r:s], r) if in_b[x] == 1 and in_a[x] == 1}
        anchors = rising([(k, once[x]) for k, x in enumerate(a[p:q], p) if x in once])
        if not anchors:
            seen: Counter = Counter()
            nth = {}
            for k, x in enumerate(b[r:s], r):
                nth[x, seen[x]] = k
                seen[x] += 1
            seen = Counter()
            some = []
            for k, x in enumerate(a[p:q], p):
                if (x, seen[x]) in nth:
                    some.append((k, nth[x, seen[x]]))
                seen[x] += 1
            out += rising(some)
            continue
        i, j = p, r
        for k, m in [*anchors, (q, s)]:
            todo.append((i, k, j, m))
            if k < q:
                out.append((k, m))
            i, j = k + 1, m + 1
    return sorted(out)


def common_blocks(first: list, later: list, weight: list[int], least: int) -> list[int]:
    """The places in ``later`` of aligned blocks with ``least`` words at least.

    Both are lists of line hashes, BLANK for a blank line; a block may run over blank lines. Blocks that stand in another order in
    the two texts are found by aligning again what is left, until nothing more is found.
    """
    deleted: list[int] = []
    left = [k for k, x in enumerate(later) if x != BLANK]
    ours = [x for x in first if x != BLANK]
    while left:
        matched = dict((j, i) for i, j in patience(ours, [later[k] for k in left]))
        blocks: list[list[int]] = []
        for j in sorted(matched):
            if blocks and blocks[-1][-1] == j - 1 and matched[j - 1] == matched[j] - 1:
                blocks[-1].append(j)
            else:
                blocks.append([j])
        gone = {j for x in blocks if sum(weight[left[j]] for j in x) >= least for j in x}
        if not gone:
            break
        deleted += [left[j] for j in gone]
        left = [k for j, k in enumerate(left) if j not in gone]
    return sorted(deleted)


def compact(hashes: np.ndarray, weight: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines whose hashes are in ``shared``, with their weights and places; OWN stands for a row of other lines between them. Blank lines go."""
    at = np.flatnonzero(hashes != BLANK)
    mine = np.isin(hashes[at], shared)
    keep = mine | np.concatenate([[False], mine[:-1]])[: len(at)]
    return np.where(mine, hashes[at], OWN)[keep], np.where(mine, weight[at], 0)[keep], at[keep]


def shortest_runs(hashes: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hash and the places of each shortest run of lines with ``least`` words, from a line on or up to a line; blank lines aside, and none over OWN."""
    at = np.flatnonzero(hashes != BLANK)
    h, w = hashes[at].astype(np.int64).view(np.uint64), weight[at].astype(np.int64)
    upto = np.cumsum(w)
    before, every = upto - w, np.arange(len(at))
    ends = np.searchsorted(upto, before + least)
    starts = np.searchsorted(before, upto - least, side="right") - 1
    onward, backward = ends < len(at), starts >= 0
    runs = np.concatenate([np.stack([every[onward], ends[onward]], 1), np.stack([starts[backward], every[backward]], 1)])
    own = np.concatenate([[0], np.cumsum(hashes[at] == OWN)])
    runs = np.unique(runs[own[runs[:, 0]] == own[runs[:, 1] + 1]], axis=0)
    keys = np.zeros(len(runs), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int((runs[:, 1] - runs[:, 0]).max(initial=-1)) + 1):
            on = runs[:, 0] + k <= runs[:, 1]
            mixed = (keys[on] + h[runs[on, 0] + k] + np.uint64(1)) * PRIME
            keys[on] = mixed ^ (mixed >> np.uint64(29))
    return keys.view(np.int64), [at[i : j + 1] for i, j in runs.tolist()]


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, hashes, weight): the hash of each trimmed line, BLANK for a blank one, and its number of words."""
    spaced = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    unspaced = lambda x: (F.octet_length(x) > F.length(x)) & x.rlike(UNSPACED)
    whole = F.coalesce(F.col(text_col), F.lit(""))
    odd = functools.reduce(operator.or_, [F.contains(whole, F.lit(c)) for c in OTHER_SPACES])
    lines = F.split(F.when(odd, F.translate(whole, OTHER_SPACES, "    ")).otherwise(whole), "\n", -1)
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.transform(lines, lambda x: F.trim(x)).alias("lines"))
    return cut.select(
        "id",
        "mark",
        F.transform("lines", lambda x: F.when(x != "", F.xxhash64(x)).otherwise(F.lit(BLANK))).alias("hashes"),
        F.transform("lines", lambda x: F.when(unspaced(x), F.size(F.split(F.trim(F.regexp_replace(x, UNSPACED, " w ")), " +"))).otherwise(spaced(x))).alias("weight"),
    )


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 10) -> DataFrame:
    """(id, mark, places): the lines to delete from each document that has any; a document is known by its id and a hash of its text."""
    table = stage(lines_of(docs, id_col, text_col).dropDuplicates(["id", "mark"]), "lines")
    each = table.select(F.struct("id", "mark").alias("doc"), F.explode(F.array_distinct("hashes")).alias("h")).where(F.col("h") != BLANK)
    firsts = stage(
        each.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("not (first <=> last)").select("h", "first"), "firsts"
    )
    held = stage(each.join(firsts, "h").select("doc", "first", "h"), "held")
    pairs = stage(held.where("not (doc <=> first)").select("doc", "first").distinct(), "pairs")
    shared = held.groupBy(F.col("doc").alias("of")).agg(F.collect_list("h").alias("shared"))
    whole = table.select(F.struct("id", "mark").alias("doc"), "hashes", "weight")
    asked = whole.join(shared, whole["doc"].eqNullSafe(shared["of"])).select("doc.id", "doc.mark", "hashes", "weight", "shared")
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [compact(h, w, s) for h, w, s in zip(b["hashes"], b["weight"], b["shared"])]
            yield pd.DataFrame({"id": b["id"], "mark": b["mark"]} | {c: pd.Series([x[k] for x in got], dtype=object, index=b.index) for k, c in enumerate(["hashes", "weight", "places"])})

    short = stage(asked.mapInPandas(cut, f"id {kind}, mark long, hashes array<long>, weight array<int>, places array<int>"), "short")
    keyed = short.select(F.struct("id", "mark").alias("doc"), "hashes", "weight", "places")
    mine = pairs.join(keyed, pairs["doc"].eqNullSafe(keyed["doc"])).select(pairs["doc"], "first", F.col("hashes").alias("later"), "weight", "places")
    theirs = keyed.select(F.col("doc").alias("other"), F.col("hashes").alias("earlier"))
    both = mine.join(theirs, mine["first"].eqNullSafe(theirs["other"])).select("doc.id", "doc.mark", "earlier", "later", "weight", "places")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for e, m, w, p in zip(b["earlier"], b["later"], b["weight"], b["places"]):
                # Lines of their own are no lines in common.
                first, later = [None if x == OWN else x for x in e.tolist()], m.tolist()
                found.append(p[common_blocks(first, later, w.tolist(), least_words)])
            yield pd.DataFrame({"id": b["id"], "mark": b["mark"], "places": pd.Series(found, dtype=object, index=b.index)})

    aligned = stage(both.mapInPandas(align, f"id {kind}, mark long, places array<int>").where(F.size("places") > 0), "aligned")

    def run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b[at : at + 500]
                got = [shortest_runs(h, w, least_words) for h, w in zip(part["hashes"], part["weight"])]
                own = np.repeat(np.arange(len(part)), [len(x) for x, _ in got])
                yield pd.DataFrame({
                    "id": part["id"].iloc[own].array, "mark": part["mark"].iloc[own].array,
                    "h": np.concatenate([x for x, _ in got]), "places": pd.Series([q[p] for q, (_, x) in zip(part["places"], got) for p in x], dtype=object),
                })

    # A run that another document has is made of lines that other documents have.
    runs = stage(short.mapInPandas(run_rows, f"id {kind}, mark long, h long, places array<int>").selectExpr("struct(id, mark) as doc", "h", "places"), "runs")
    holders = stage(runs.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("not (first <=> last)").select("h", "first"), "holders")
    repeated = runs.join(holders, "h").where("not (doc <=> first)").select("doc.id", "doc.mark", "places")
    found = aligned.unionByName(repeated)
    out = stage(found.groupBy("id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places")), "deletions")
    discard(table, firsts, held, pairs, short, aligned, runs, holders)
    return out


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 10) -> DataFrame:
    """Return ``docs`` with the repeated passages cut from ``text`` and two more columns, ld_lines and ld_deleted (arrays' sizes).

    Of two documents the one with the larger id is the later, a null id being the smallest; at one id the hashes of the
    texts decide, and rows alike in both are one document, which keeps its text in each. Lines are compared without white
    space at either end, and a block counts from ``least_words`` words on. What an earlier document has is never cut from
    all of its holders, as the first one keeps it. A null text stays null and an empty one empty; an empty
    table gives an empty result. Columns of the input whose names begin with ``ld_`` are dropped.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("ld_")])
    found = deletions(docs, id_col, text_col, least_words)
    may = sieve(found.select(F.xxhash64("id", "mark")))(F.xxhash64(id_col, F.xxhash64(text_col)))
    found = found.select(F.col("id").alias("ld_id"), F.col("mark").alias("ld_mark"), F.col("places").alias("ld_places"))
    marked = docs.where(may).withColumn("ld_key", F.xxhash64(text_col))
    joined = marked.join(found, marked[id_col].eqNullSafe(found["ld_id"]) & (marked["ld_key"] == found["ld_mark"]), "left").drop("ld_id", "ld_mark", "ld_key")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("ld_places"))
    text = F.when(F.col("ld_places").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    counted = joined.withColumns({"ld_lines": F.coalesce(F.size(lines), F.lit(0)), "ld_deleted": F.coalesce(F.size("ld_places"), F.lit(0)), text_col: text}).drop("ld_places")
    return docs.where(~may).withColumns({"ld_lines": F.coalesce(F.size(lines), F.lit(0)), "ld_deleted": F.lit(0)}).unionByName(counted)
