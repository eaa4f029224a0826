"""How much the driver plans and compiles for near-duplicates."""

from importlake.llm import components, simhash


def popcounts(fp):
    return [(fp >> 2 * i & 1) + (fp >> 2 * i + 1 & 1) for i in range(32)]


def test_cells_are_compiled_as_one_step(spark, monkeypatch):
    """The plan had all 65 cells, which took over 100 MB of the driver to compile."""
    fps = [0, -1, 1, -(1 << 63), 0x0123456789ABCDEF, 0x5555555555555555, 3 << 30]
    want = set()
    for fp in fps:
        own = popcounts(fp & (1 << 64) - 1)
        near = [own, *[own[:i] + [own[i] + d] + own[i + 1 :] for i in range(32) for d in (1, -1) if 0 <= own[i] + d <= 2]]
        want |= {(fp, sum(c << 2 * i for i, c in enumerate(cell))) for cell in near}
    sizes, kept = [], simhash.stage

    def stage(df, name, *more):
        if name == "cells":
            sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return kept(df, name, *more)

    monkeypatch.setattr(simhash, "stage", stage)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    linked = {(r.a, r.b) for r in simhash.links(frame).collect()}
    assert linked and all((a ^ b).bit_count() <= 2 for a, b in ((x & (1 << 64) - 1, y & (1 << 64) - 1) for x, y in linked))
    assert sizes and sizes[0] < 4000
    assert sorted((r.fp, r.cell & (1 << 64) - 1) for r in simhash.popcount_cells(frame).collect()) == sorted(want)


def test_components_end_with_the_check(spark, monkeypatch):
    """A round was carried on to its end although nothing could change any more."""
    names, kept = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name, *more: names.append(name) or kept(df, name, *more))
    star = spark.createDataFrame([(1, x) for x in range(2, 9)], "a long, b long")
    assert {(r.node, r.component) for r in components.connected_components(star).collect()} == {(x, 1) for x in range(1, 9)}
    assert names == ["edges", "labels", "near"]
