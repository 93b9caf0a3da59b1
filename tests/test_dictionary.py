"""Dictionaries with versions against one that is kept by hand, request after request."""

import random
from itertools import accumulate

import pytest

from lodestone.operators import dictionary, ranged
from lodestone.operators.dictionary import Limits


def by_hand(requests, rollbacks, width, size, limits):
    """Codes by (epoch, place, value) of what is added, and (entries, next code) at the end of each epoch."""
    held, at, added, states, epochs = {}, limits.first, {}, {}, sorted({e for e, _, _ in requests})
    for epoch in epochs:
        if epoch in rollbacks:
            gone = [v for v, (_, e, _) in held.items() if e > rollbacks[epoch]]
            at = min([at, *(held[v][0] for v in gone if held[v][0] is not None)])
            held = {v: x for v, x in held.items() if v not in gone}
        for _, place, value in sorted(r for r in requests if r[0] == epoch):
            if value in held:
                continue
            if size(value) > limits.size:
                code, error = None, "size"
            elif at + width(value) - 1 > limits.last:
                code, error = None, "full"
            else:
                code, error = at, None
                at += width(value)
            held[value] = (code, epoch, error)
            added[epoch, place, value] = (code, error)
        states[epoch] = ({v: x[0] for v, x in held.items()}, at)
    return added, states


@pytest.mark.parametrize(("seed", "limits"), [(1, Limits()), (2, Limits(1, 17, 9)), (3, Limits(0, 12, 9)), (4, Limits(5, 30, 8))])
def test_entries_lookups_and_checkpoints(spark, seed, limits):
    rng = random.Random(seed)
    width, size = (lambda v: 2 if v % 3 == 0 else 1), (lambda v: v % 11)
    rows, moves, want, states = [], [], [], {}
    for d in range(6):
        requests = [(rng.randrange(12), i, rng.randrange(25)) for i in range(rng.randint(5, 90))]
        epochs = sorted({e for e, _, _ in requests})
        rollbacks = {e: rng.randrange(e) for e in epochs if e > 1 and rng.random() < 0.35}
        rows += [(d, *r) for r in requests]
        moves += [(d, e, t) for e, t in rollbacks.items()]
        added, states[d] = by_hand(requests, rollbacks, width, size, limits)
        want += [(d, v, e, p, width(v), *told) for (e, p, v), told in added.items()]
    from pyspark.sql import functions as F

    requests = spark.createDataFrame(rows, "d int, epoch int, place int, v int")
    rollbacks = spark.createDataFrame(moves, "d int, epoch int, target int")
    held = dictionary.entries(requests, ["d"], "v", "place", rollbacks, F.when(F.col("v") % 3 == 0, 2).otherwise(1), F.col("v") % 11, limits)
    got = [(r.d, r.v, r.epoch, r["at"], r.width, r.code, r.error) for r in held.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    keys = [(d, v, e) for d in states for e in states[d] for v in range(25)]
    found = dictionary.find(spark.createDataFrame(keys, "d int, v int, as_of int"), held, ["d"], "v")
    assert {(r.d, r.v, r.as_of): r.code for r in found.collect()} == {(d, v, e): states[d][e][0].get(v) for d, v, e in keys}
    marks = dictionary.checkpoints(requests.select("d", "epoch"), held, ["d"], limits)
    assert {(r.d, r.epoch): r.next_code for r in marks.collect()} == {(d, e): at for d in states for e, (_, at) in states[d].items()}


def test_no_requests_and_no_rollbacks(spark):
    none = spark.createDataFrame([], "d int, epoch int, place int, v string")
    assert dictionary.entries(none, ["d"], "v", "place").count() == 0
    rows = spark.createDataFrame([(1, 0, 2, "b"), (1, 0, 1, "a"), (1, 3, 0, "b"), (1, 3, 1, None)], "d int, epoch int, place int, v string")
    assert {(r.v, r.epoch, r.code) for r in dictionary.entries(rows, ["d"], "v", "place").collect()} == {("a", 0, 1), ("b", 0, 2)}


def test_running_sums_go_over_ranges(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(g, i, rng.randrange(5)) for g, n in (("x", 3000), ("y", 10), (None, 40)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.i): r.before for r in ranged.running_sums(df, ["g"], ["i"], {"before": F.col("n")}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for group in ("x", "y", None):
        mine = sorted(r[1:] for r in rows if r[0] == group)
        assert [got[group, i] for i, _ in mine] == [0, *accumulate(n for _, n in mine)][:-1]
