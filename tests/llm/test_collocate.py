"""Phrase collocations against plain counting, and bitmaps against sets of places."""

import os
import random
import re
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pytest

from lodestone.llm import collocate, queries
from lodestone.llm.collocate import Bitmaps, Extender, Settings

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, s):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, s.most + 1):
                for i in range(len(w) - k + 1):
                    c = f.setdefault(lang, Counter())
                    c[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        able = {p: a for p, a in c.items() if len(p) > 1 and a >= s.least}
        held = {}
        for q, a in able.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    held[q[i : i + m]] = max(a, held.get(q[i : i + m], 0))
        best = []
        for p, a in able.items():
            if p in held and 100 * held[p] >= s.share * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(best)[: s.top], 1)]
    return sorted(out)


def texts(n, seed, longest=200):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "É", "日本", "x-y", "the"]
    glue = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "\xa0"]
    return [(rng.choice(["en", "en", "de", None]), "".join(rng.choice([w, w.upper()]) + rng.choice(glue) for w in rng.choices(words, weights=range(8, 0, -1), k=rng.randint(0, longest)))) for _ in range(n)]


def run(spark, rows, s, parts=4):
    docs = spark.createDataFrame([(i, lang, t, "x", 1, 2) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, shard int, n int").repartition(parts)
    return sorted(tuple(r) for r in collocate.collocations(docs, s).collect())


@pytest.mark.parametrize("s", [Settings(least=6), Settings(least=3, places=64, top=25), Settings(least=3, places=64, broadcast=0), Settings(most=3, least=2, share=60), Settings(most=2, least=1), Settings(most=12, least=2, places=100)])
def test_phrases_are_the_plain_ones(spark, s):
    rows = [*texts(60, s.least + s.most), ("en", None), ("en", ""), (None, None), ("de", " .,;\n"), ("fr", "tout seul"), ("", "a b a b a b a b a b a b a b")]
    assert run(spark, rows, s) == plain(rows, s)


def test_one_piece_goes_over_many_shards(spark):
    words = " ".join(random.Random(1).choices("abcde", weights=[9, 5, 3, 2, 1], k=3000))
    rows = [("en", words), ("en", words), ("en", "the end")]
    want = plain(rows, Settings(least=4))
    assert run(spark, rows, Settings(least=4, places=64), 1) == want
    assert run(spark, rows, replace(Settings(least=4, places=64), broadcast=0), 1) == want
    assert run(spark, rows, Settings(least=4), 1) == want


def test_repeated_rows_count_and_many_languages(spark):
    rows = [("en", "same words here again")] * 150 + [(f"l{i}", "a b " * 40) for i in range(30)]
    s = Settings(least=100, places=64)
    assert run(spark, rows, s) == plain(rows, s)
    s = Settings(least=20, places=64)
    assert run(spark, rows, s) == plain(rows, s)


def test_empty_tables_and_settings(spark):
    assert run(spark, [], Settings()) == [] and run(spark, [("en", "too few words")], Settings()) == []
    with pytest.raises(ValueError):
        Settings(most=1)


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([([1, 2], 3_000_000_000_000)], "ids array<long>, f long")
    words = spark.createDataFrame([("en", "a", 3_000_000_000_001, 1), ("en", "b", 4_000_000_000_000, 2)], "lang string, word string, f long, number long")
    totals = spark.createDataFrame([("en", 900_000_000_000_000)], "lang string, n long")
    (row,) = collocate.report(phrases, words, totals, Settings()).collect()
    assert row.score == 1000 * 3_000_000_000_000 * 900_000_000_000_000 // (3_000_000_000_001 * 4_000_000_000_000)


def test_bitmaps_shift_and_count():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 5, 900)  # 0: a gap
    real = ids > 0
    maps = Bitmaps.of(ids[real] - 1, np.arange(8, 908)[real], 4)
    back = Bitmaps.read(4, *maps.stored())
    assert all((x == y).all() for x, y in ((maps.word, back.word), (maps.block, back.block), (maps.bits, back.bits)))
    one = maps.only(np.array([2, 0]))
    assert one.words == 2 and (np.bincount(one.word) == np.bincount(maps.word)[[2, 0]]).all()
    extender = Extender(maps, 8)
    ((words, *at),) = extender.roots()
    rows = words[:, None]
    for k in range(2, 6):
        parent, word, *at, found = extender.extend(*at)
        rows = np.column_stack([rows[parent], word])
        told = Counter(tuple((ids[i : i + k] - 1).tolist()) for i in range(900 - k + 1) if real[i : i + k].all())
        assert {tuple(w): n for w, n in zip(rows.tolist(), found.tolist(), strict=True)} == told
    # Along some pairs only.
    ((words, *at),) = extender.roots()
    *_, found = extender.extend(*at, lambda p, w: (words[p] == 0) & (w == 1))
    assert found.tolist() == [sum(ids[i] == 1 and ids[i + 1] == 2 for i in range(899))]


def test_trie_of_phrases():
    numbers = np.array([3, 5, 9, 20])
    two = (np.array([100, 101, 102, 103]), np.array([9, 3, 7, 5]), np.array([3, 5, 9, 9]))  # 9-3, 3-5, 7-9 (not here), 5-9
    three = (np.array([7, 8, 9]), np.array([101, 103, 102]), np.array([9, 3, 3]))  # 3-5-9, 5-9-3, 7-9-3
    trie = collocate.Trie(numbers, [two, three])
    assert trie.numbers[1].tolist() == [101, 103, 100] and trie.numbers[2].tolist() == [7, 8]
    assert trie.suffix[1].tolist() == [1, 2, 0] and trie.suffix[2].tolist() == [1, 2]
    assert trie.child(3, np.array([0, 0, 1, -1]), np.array([2, 1, 0, 0])).tolist() == [0, -1, 1, -1]
    none = np.zeros(0, np.int64)
    empty = collocate.Trie(none, [(none, none, none)])
    assert len(empty.numbers[1]) == 0 and empty.child(2, none, none).tolist() == []


def test_query_is_its_sql(spark):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = queries.op12_collocations(spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = connection.execute(queries.COLLOCATIONS_SQL).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
