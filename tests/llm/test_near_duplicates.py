import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embed_dedup, ngram_join, winnow
from lodestone.llm.common import Scratch
from lodestone.llm.components import components


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def word_sets(texts, k):
    out = []
    for text in texts:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        grams = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
        out.append(grams or ({tuple(words)} if words else set()))
    return out


def family(rng, n_words, copies, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus():
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [None, "", " \n\t", "one", "One", "one two three", "ONE two\tthree", "é É", "x " * 40, "y" * 5000]
    texts += family(rng, 120, 60, 6) + family(rng, 40, 20, 2) + family(rng, 12, 8, 1)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) + " " + passage for _ in range(40)]
    texts += [texts[20]] * 5 + [passage] * 3
    return texts


@pytest.mark.parametrize(("k", "percent", "small"), [(4, 85, 48), (5, 80, 3), (1, 50, 1)])
def test_ngram_join_finds_all_links(spark, monkeypatch, k, percent, small):
    monkeypatch.setattr(ngram_join, "SMALL_LIST", small)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 20)
    texts = corpus()
    ids = [i * 3 + 7 for i in range(len(texts))]
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n int, own string").repartition(3)
    got = {r.doc_id: r for r in ngram_join.near_groups(table, ngram_join.Similarity(k, percent)).collect()}
    sets = dict(zip(ids, word_sets(texts, k)))
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(ids, links)
    assert len(links) > 100
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in ids}


def test_ngram_join_of_repeated_ids_nulls_and_nothing(spark):
    kind = "doc_id long, text string"
    assert ngram_join.near_groups(spark.createDataFrame([], kind)).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other words stand here now"), (None, "a b c d e f"), (9, "A B c d e f"), (None, None)]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert found == sorted([(5, 2, 5), (5, 2, 5), (5, 1, 5), (None, 2, 5), (9, 2, 5), (None, 0, None)], key=str)


def test_keep_one_of_each_group(spark):
    rows = [(3, "a b c d e f", "en"), (1, "a b c d e f", "de"), (1, "a b c d e f", "de"), (2, "unlike all of the others here", "en"), (4, "", "en"), (6, "", "en"), (7, None, "fr")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(1, "a b c d e f"), (2, "unlike all of the others here")]
    assert kept.count() == 5


def test_one_id_in_unrelated_groups_loses_none_of_them(spark):
    first, second = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(5, first), (5, second), (6, first), (7, second + " "), (8, "one two three four five six"), (None, "alone with no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.keep_one(docs)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, rows[5][1]), (5, first), (5, second), rows[4]]
    found = {(r.doc_id, r.text): r for r in ngram_join.near_groups(docs).join(docs.selectExpr("doc_id as id", "text", "xxhash64(text) as m"), F.expr("id <=> doc_id and m = mark")).collect()}
    roots = [bytes(found[row].root) for row in rows[:5]]
    assert roots[0] == roots[2] != roots[1] == roots[3] != roots[4] and {found[row].component_id for row in rows[:4]} == {5}


def test_word_hashes_do_not_mix_texts():
    many = ngram_join.shingles(["a b c", "", "d", "a b c d", "A  b\nC\td "], 3)
    assert [len(x) for x in many] == [1, 0, 1, 2, 2]
    assert many[0][0] == many[3][0] and (many[3] == many[4]).all()
    assert (ngram_join.shingles(["a b c d"], 3)[0] == many[3]).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(30)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(60)]
    found = components(Scratch(spark), spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.root for r in found.collect()}
    linked = {i for a, b in links if a != b for i in (a, b)}
    want = roots(linked, [(a, b) for a, b in links if a != b])
    assert got == {i: want[i] for i in linked}


def vectors(rng):
    rows = []
    for label in (0, 1):
        for _ in range(60):
            x = rng.normal(size=16)
            rows.append((x, label))
            for _ in range(rng.integers(0, 6)):
                rows.append((x + rng.normal(scale=rng.uniform(0, 0.35), size=16), label))
    rows += [(rows[0][0], 0)] * 4 + [(rows[0][0] * 3, 0), (rows[0][0], 1), (rows[0][0], None), (np.zeros(16), 0), (rows[0][0][:8], 0), (rows[0][0][:8], 0)]
    return rows


@pytest.mark.parametrize("residents", [1024, 20, 1])
def test_embedding_links_are_those_of_brute_force(spark, monkeypatch, residents):
    monkeypatch.setattr(embed_dedup, "RESIDENTS", residents)
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    rows = vectors(np.random.default_rng(2))
    table = [(i, [float(np.float32(v)) for v in x], label, i) for i, (x, label) in enumerate(rows)]
    table += [(900, None, 0, 0), (901, [], 0, 0), (902, [float("nan")] * 16, 0, 0), (903, [None] * 16, 0, 0), (904, [float("inf")] * 16, 0, 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, weight long").repartition(3)
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    assert len(got) == len(table)
    good = {}
    for i, x, label, _ in table:
        if x and label is not None and None not in x and np.isfinite(x).all() and np.any(x):
            good[i] = (label, np.array(x) / np.linalg.norm(x))
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.93]
    want = roots([t[0] for t in table], links)
    counts = {i: sum(i in pair for pair in links) for i in got}
    assert len(links) > 50
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (counts[i], want[i], want[i] == i) for i in got}


def test_vectors_of_any_length_and_size_are_linked(spark):
    x = np.random.default_rng(3).normal(size=3000)
    rows = [(1, (x * 1e200).tolist(), "a"), (2, (x * 1e-200).tolist(), "a"), (3, (-x).tolist(), "a"), (4, x.tolist(), "b"), (5, x[:2000].tolist(), "a"), (5, x[:2000].tolist(), "a"), (None, x.tolist(), "a")]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == [("1", 2, 1), ("2", 2, 1), ("3", 0, 3), ("4", 0, 4), ("5", 1, 5), ("5", 1, 5), ("None", 2, 1)]


def test_cells_in_two_levels_miss_no_link():
    rng = np.random.default_rng(4)
    x = embed_dedup.unit_vectors(rng.normal(size=(60, 8)).repeat(20, axis=0) + rng.normal(scale=0.2, size=(1200, 8)))
    cells = embed_dedup.Cells(x, 200)
    assert len(cells.coarse) > 5 and len(cells) > 100
    home, at, cell = cells.of(x, np.sqrt(2 - 2 * 0.93) / 2)
    goes = {*zip(at.tolist(), cell.tolist())}
    assert all((i, int(h)) in goes for i, h in enumerate(home))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert len(a) > 1000 and all((i, int(home[j])) in goes or (j, int(home[i])) in goes for i, j in zip(a.tolist(), b.tolist()))
    assert len(goes) < 0.5 * len(x) * len(cells)


def test_embeddings_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_vectors(empty).count() == 0


def brute_marks(text, k, w):
    if not text:
        return []
    k = min(k, len(text))
    hashes = [int(winnow.chosen(text[i : i + k], k, 1)[1][0]) for i in range(len(text) - k + 1)]
    w, out = min(w, len(hashes)), []
    for i in range(len(hashes) - w + 1):
        low = min(hashes[i : i + w])
        at = max(j for j in range(i, i + w) if hashes[j] == low)
        if not out or out[-1] != (at, low):
            out.append((at, low))
    return out


def test_winnowing_takes_the_rightmost_minimum():
    rng = random.Random(5)
    for _ in range(100):
        text = "".join(rng.choice("ab é😀") for _ in range(rng.randint(0, 90)))
        for k, w in ((12, 48), (5, 7), (3, 4), (1, 1)):
            at, hashes = winnow.chosen(text, k, w)
            assert list(zip(at.tolist(), hashes.tolist())) == brute_marks(text, k, w)


def test_a_shared_run_of_the_guaranteed_length_shares_a_mark():
    rng = random.Random(6)
    run = "".join(rng.choice("abcdefgh ") for _ in range(winnow.WINDOW + winnow.K - 1))
    a, b = ("".join(rng.choice("xyz ") for _ in range(300)) for _ in range(2))
    assert set(winnow.chosen(a + run + b)[1].tolist()) & set(winnow.chosen(b + run)[1].tolist())


def test_neighbours_follow_the_ids(spark):
    rng = random.Random(7)
    ids = rng.sample(range(10_000), 60)
    texts = ["".join(rng.choice("abc dé\n") for _ in range(rng.choice([0, 1, 3, 40, 400]))) for _ in ids]
    texts[4], texts[9] = None, "z" * 5000
    table = spark.createDataFrame([(i, t, 1.0) for i, t in zip(ids, texts)], "doc_id long, text string, near_next double").repartition(5)
    got = {r.doc_id: r for r in winnow.neighbours(table).collect()}
    assert len(got) == len(ids)
    order = sorted(ids)
    text_of = {i: t or "" for i, t in zip(ids, texts)}
    import hashlib

    for at, i in enumerate(order):
        text, following = text_of[i], text_of[order[(at + 1) % len(order)]]
        quarter = len(text) // 4
        new = text[: len(text) - quarter] + following[:quarter]
        marks = [set(winnow.chosen(t)[1].tolist()) for t in (text, new, following)]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == winnow.fingerprint(*winnow.chosen(text)) and r.edited_fingerprint == winnow.fingerprint(*winnow.chosen(new))
        assert r.near_edited == winnow.likeness(marks[0], marks[1]) and r.near_next == winnow.likeness(marks[0], marks[2])


def test_neighbours_of_few_rows_and_null_ids(spark):
    kind = "doc_id long, text string"
    assert winnow.neighbours(spark.createDataFrame([], kind)).count() == 0
    assert [r.near_next for r in winnow.neighbours(spark.createDataFrame([(4, "abcd")], kind)).collect()] == [1.0]
    rows = [(None, "first"), (3, "aa"), (3, "bb"), (3, "bb"), (8, None)]
    assert winnow.neighbours(spark.createDataFrame(rows, kind)).count() == 5


def test_fingerprints_refuse_what_they_cannot_hold(spark):
    with pytest.raises(ValueError):
        winnow.chosen("text", 12, 400)
    with pytest.raises(TypeError):
        winnow.neighbours(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_rows_without_ids_come_first_in_the_order_of_their_texts(spark):
    texts = [f"text number {i} of many " * 9 for i in range(7)]
    rows = [(None, t) for t in texts[:4]] + [(5, texts[4]), (5, texts[5]), (9, texts[6])]
    got = winnow.neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = [*sorted(texts[:4]), *sorted(texts[4:6]), texts[6]]
    prints = lambda t: set(winnow.chosen(t)[1].tolist())
    want = sorted((winnow.fingerprint(*winnow.chosen(t)), winnow.likeness(prints(t), prints(order[(i + 1) % 7]))) for i, t in enumerate(order))
    assert sorted((r.fingerprint, r.near_next) for r in got) == want
