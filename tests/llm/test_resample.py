"""Importance resampling against plain loops, and its suffix arrays against sorted suffixes."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import queries, resample
from lodestone.llm.resample import Settings

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_features(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + k]) for k in range(1, words + 1) for i in range(len(w) - k + 1)]


def plain_resample(rows, target, s):
    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    every = [(i, *plain_features(t, s.words)) for i, t in rows]
    own = Counter(bucket(f) for _, _, fs in every for f in fs)
    aim = Counter(bucket(f) for t in target for f in plain_features(t, s.words)[1])
    n_own, n_aim = sum(own.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (n_own + s.buckets) / ((own[b] + 1) * (n_aim + s.buckets))))
    out = []
    for i, w, fs in every:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= s.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: s.percent * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, (r[:5] for r in out)), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé0ß日") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    return [rng.choice([" ", ", ", "\n"]).join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


def run(spark, rows, target, settings):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, score string, rank int, buckets string").repartition(5)
    aims = spark.createDataFrame([(t, 7) for t in target], "text string, id int")
    return sorted((tuple(r) for r in resample.resample(docs, aims, settings).collect()), key=repr)


@pytest.mark.parametrize("settings", [Settings(least_words=20), Settings(words=3, buckets=97, seed=5, least_words=3, percent=40), Settings(words=2, buckets=50_000, least_words=0, percent=100)])
def test_scores_and_draw_are_the_plain_ones(spark, settings):
    rows = [*enumerate(texts(250, 1)), (1000, None), (1001, ""), (1002, " .,-\t"), (1003, "one " * 50_000), (1004, "ÀÉ A1b_2c"), (None, "a b c d e " * 9)]
    target = [*texts(30, 2), None, ""]
    assert run(spark, rows, target, settings) == plain_resample(rows, target, settings)


def test_repeated_rows_are_drawn_each_by_itself(spark):
    rows = [(7, "a b c d e " * 5)] * 40 + [(8, "z z z " * 9)] * 40
    got = run(spark, rows, ["a b"], Settings(percent=50))
    assert len(got) == 80 and sorted(r[4] for r in got if r[4]) == list(range(1, 41)) and len({r[0] for r in got if r[4]}) == 1


def test_empty_tables(spark):
    assert run(spark, [], ["a"], Settings()) == []
    rows = [*enumerate(texts(40, 3))]
    assert run(spark, rows, [], Settings()) == plain_resample(rows, [], Settings())


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffix_array_and_runs(depth):
    rng = np.random.default_rng(depth)
    for n in (0, 1, 2, 50, 400):
        ids = rng.integers(0, 4, n)
        order = resample.suffix_array(ids, depth)
        keys = [tuple(ids[i : i + depth].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
        share = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert resample.shared_words(ids, order, depth).tolist() == [share(a, b) for a, b in zip([(), *keys], keys, strict=False)]


def test_each_repeated_n_gram_is_hashed_once(monkeypatch):
    hashed = []
    real = zlib.crc32
    monkeypatch.setattr(resample.zlib, "crc32", lambda b: hashed.append(b) or real(b))
    words = [t.encode().split() for t in ("a b a b a b", "b a b", "", "a")]
    lists = resample.bucket_lists(words, Settings(words=2, buckets=1000))
    assert sorted(hashed) == [b"a", b"a b", b"b", b"b a"]
    assert [len(x) for x in lists] == [11, 5, 0, 1]
    assert lists[1].tolist() == [real(f) % 1000 for f in (b"b", b"a", b"b", b"b a", b"a b")]


def test_query_is_its_sql(spark):
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    found = queries.op13_resample(spark, SF)
    want = connection.execute(queries.RESAMPLE_SQL).fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
