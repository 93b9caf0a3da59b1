"""Lifting against walks from node to node."""

import random

import pytest

from lodestone.operators import ancestry, hierarchy


def walk(parent, node):
    """(nodes above, smallest of the circle or None)."""
    seen, at = [], node
    while at in parent:
        at = parent[at]
        if at in seen:
            return None, min(seen[seen.index(at) :])
        seen.append(at)
    return seen, None


def forest(spark, parent):
    return spark.createDataFrame(list(parent.items()), "child long, parent long")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    n = [0, 60, 120][seed]
    # Chains, bushes, and with the third seed circles.
    parent = {i: rng.choice([i - 1, rng.randrange(max(1, i)), i - 1]) for i in range(1, n)} | {1000 + i: 2000 + rng.randrange(5) for i in range(20)}
    if seed:
        parent |= {i: rng.randrange(n) for i in rng.sample(range(1, n), 6)} | {500: 500, 600: 601, 601: 600, 602: 600}
    lifting = ancestry.lift(forest(spark, parent))
    told = {i: walk(parent, i) for i in parent}
    assert {(r.node, r.top, r.depth) for r in lifting.tops.collect()} == {(i, up[-1], len(up)) for i, (up, _) in told.items() if up}
    assert {(r.node, r.low) for r in lifting.endless.collect()} == {(i, low) for i, (up, low) in told.items() if up is None}
    inside = {i for i in parent if told[i][0] is None and i in circle(parent, i)}
    assert {(r.node, r.circle) for r in lifting.circles().collect()} == {(i, told[i][1]) for i in inside}
    got = sorted(tuple(r) for r in ancestry.chains(lifting).collect())
    assert got == sorted((i, d, a) for i, (up, _) in told.items() if up for d, a in enumerate(up, 1))
    some = ancestry.chains(lifting, spark.createDataFrame([(3,), (1001,), (99999,)], "node long"))
    assert sorted(tuple(r) for r in some.collect()) == [r for r in got if r[0] in (3, 1001)]
    nodes = [*parent, 0, 2000, 2001, 77777]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(400)] + [(5, 5), (5, 5), (600, 600), (500, 3), (0, 0)]

    def common(a, b):
        if a == b:
            return a
        x, y = ([i, *up] if up is not None else None for i, up in ((i, told[i][0] if i in told else []) for i in (a, b)))
        return next((i for i in x if i in y), None) if x is not None and y is not None else None

    found = ancestry.common_ancestors(spark.createDataFrame(pairs, "a long, b long"), lifting)
    assert sorted(map(repr, found.collect())) == sorted(f"Row(a={a}, b={b}, common={common(a, b)})" for a, b in set(pairs))


def circle(parent, node):
    seen, at = [], node
    while at not in seen:
        seen.append(at)
        at = parent[at]
    return seen[seen.index(at) :]


def test_a_chain_of_100000_takes_as_many_rounds_as_its_logarithm(spark):
    n = 100_000
    chain = spark.range(1, n + 1).selectExpr("id as child", "id - 1 as parent")
    lifting = ancestry.lift(chain)
    assert len(lifting.levels) == 17 and lifting.endless.isEmpty()
    assert lifting.tops.selectExpr("count(*)", "sum(depth)", "max(top)").first()[:] == (n, n * (n + 1) // 2, 0)
    assert lifting.levels[16].count() == n - (1 << 16) + 1
    pairs = spark.createDataFrame([(99_999, 12_345), (7, 99_000), (0, 5)], "a long, b long")
    assert {(r.a, r.common) for r in ancestry.common_ancestors(pairs, lifting).collect()} == {(99_999, 12_345), (7, 7), (0, 0)}


def test_empty_and_repeated_edges(spark):
    empty = ancestry.lift(forest(spark, {}))
    assert empty.tops.isEmpty() and empty.endless.isEmpty() and ancestry.chains(empty).isEmpty()
    pairs = spark.createDataFrame([(1, 2), (3, 3)], "a long, b long")
    assert {(r.a, r.common) for r in ancestry.common_ancestors(pairs, empty).collect()} == {(1, None), (3, 3)}
    twice = spark.createDataFrame([(1, 5), (1, 4), (1, 4), (2, None), (None, 3)], "child long, parent long")
    assert [tuple(r) for r in ancestry.lift(twice).tops.collect()] == [(1, 4, 1)]


def test_chains_of_classes_and_their_errors(spark):
    rows = [("a/C", "a/B"), ("a/B", "a/A"), ("a/A", hierarchy.OBJECT), ("b/X", "b/Gone"), ("c/P", "c/Q"), ("c/Q", "c/P"), ("c/R", "c/P")]
    edges = spark.createDataFrame([(*r, 0, "super") for r in rows] + [("a/C", "b/I", 1, "interface")], "child string, parent string, edge_ordinal int, kind string")
    known = spark.createDataFrame([(c,) for c, _ in rows] + [(hierarchy.OBJECT,)], "name string")
    got = {tuple(r) for r in hierarchy.superclass_chain(edges, known).collect()}
    assert got == {
        ("a/C", 1, "a/B", None), ("a/C", 2, "a/A", None), ("a/C", 3, hierarchy.OBJECT, None), ("a/B", 1, "a/A", None), ("a/B", 2, hierarchy.OBJECT, None), ("a/A", 1, hierarchy.OBJECT, None),
        ("b/X", 0, "b/Gone", "unresolved"), ("c/P", 0, "c/P", "cycle"), ("c/Q", 0, "c/P", "cycle"), ("c/R", 0, "c/P", "cycle"),
    }
    only = spark.createDataFrame([("a/B",), ("c/R",)], "child string")
    assert {r.child for r in hierarchy.superclass_chain(edges, known, only).collect()} == {"a/B", "c/R"}
    assert ("b/X", hierarchy.OBJECT, 2) in {tuple(r) for r in hierarchy.superclasses(edges).collect()}
    lifting = hierarchy.super_lifting(edges)
    pairs = spark.createDataFrame([("a/C", "a/B"), ("[I", "a/B"), ("a/C", "b/X"), ("[I", "[I")], "a string, b string")
    assert [r.common for r in hierarchy.common_superclass(pairs, lifting).orderBy("a", "b").collect()] == ["[I", hierarchy.OBJECT, "a/B", hierarchy.OBJECT]
