import dataclasses
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import html_text, linededup, lm_score, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


# Line dedup


def brute_lines(rows, agree=0.75, share=0.001, halving=8.0):
    lines, total = defaultdict(set), sum(text is not None for _, text in rows)
    parse = lambda line: tuple(re.sub("[0-9]+", "<*>", " ".join(re.split(r"[ \t\r\f\x0b]+", line)).strip(" ")).split(" "))
    size = lambda words: sum(len(w.replace("<*>", "")) for w in words)
    for i, text in rows:
        for line in [] if text is None else text.split("\n"):
            if size(parse(line)):
                lines[parse(line)].add(i)
    leaves = defaultdict(list)
    for words in lines:
        leaves[len(words), words[:3]].append(words)
    template = {}
    for words in lines:
        leaf = leaves[len(words), words[:3]]
        holders = lambda at, w: set().union(*(lines[x] for x in leaf if x[at] == w))
        grown = tuple(w if len(holders(at, w)) > 1 else None for at, w in enumerate(words))
        template[words] = grown if sum(w is not None for w in grown) >= agree * len(words) else words
    members = defaultdict(list)
    for words, grown in template.items():
        members[grown].append(words)
    first = {}
    for grown, all_ in members.items():
        found = set().union(*(lines[x] for x in all_))
        if len(found) > 1 and sum(len(lines[x]) for x in all_) >= max(2, share * total * 2 ** (-size(w for w in grown if w) / halving)):
            first |= dict.fromkeys(all_, min(found))
    out = {}
    for i, text in rows:
        kept = None if text is None else [x for x in text.split("\n") if first.get(parse(x), i) == i]
        out[i] = (None, 0) if text is None else ("\n".join(kept), len(text.split("\n")) - len(kept))
    return out


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_recurring_templates_stay_in_the_first_document(spark, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_LEAVES", broadcast)
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.choice(["", 1, 22]))
    shared = [" ".join(word() for _ in range(n)) for n in (2, 3, 5, 8, 12, 16, 21) for _ in range(3)]
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "only this one line here"), (5, "only this one line here\nuser 17 logged in"), (6, "user 99 logged in\nand more words follow")]
    for i in range(7, 60):
        lines = [rng.choice(shared) for _ in range(rng.randrange(5))]
        changed = []
        for line in lines:
            words = line.split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(["new", "77", "eps"])
            changed.append(rng.choice(["  ", ""]) + "  ".join(words))
        rows.append((i, "\n".join(changed)))
    rows.append((60, "long " * 4000))
    got = linededup.drop_recurring_lines(documents(spark, rows).repartition(4))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_dropped"]
    want = brute_lines(rows)
    for r in got.collect():
        assert (r.text, r.n_dropped) == want[r.doc_id], r.doc_id
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert sum(n for _, n in want.values()) > 30


def test_a_template_is_what_the_lines_of_a_leaf_agree_on(spark):
    a = "the job named first has run on host alpha today and ended well"
    rows = [(1, a), (2, a.replace("alpha", "omega")), (3, a.replace("alpha", "delta").replace("well", "badly")), (4, a.replace("job", "task")), (5, "the job named " + "other words stand here now " * 2)]
    got = {r.doc_id: r.text for r in linededup.drop_recurring_lines(documents(spark, rows)).collect()}
    # host and the last word vary: "well" stands in two documents, so it is fixed there; "badly" is not
    assert got == {1: a, 2: "", 3: rows[2][1], 4: rows[3][1], 5: rows[4][1]}
    three = [(1, a.replace("well", "1")), (2, a.replace("alpha", "omega").replace("well", "2")), (3, a.replace("alpha", "x").replace("well", "3"))]
    got = {r.doc_id: r.text for r in linededup.drop_recurring_lines(documents(spark, three)).collect()}
    assert got == {1: three[0][1], 2: "", 3: ""}


def test_short_lines_have_to_be_in_more_documents_than_long_ones(spark):
    rules = linededup.Rules(share=0.2)
    passage = "a passage of rather many characters that two documents share"
    url, cjk = "https://example.org/" + "a1b2" * 40, "\u8fd9\u662f\u4e00\u6bb5" * 30 + "2024"
    rows = [(i, f"{'qrstuvwxyz'[i % 10] * 9} {'abcdefghij'[i // 10] * 9}\nLes.\n17" + ("\nSome." if i < 9 else "") + ("\n" + passage + "\n" + url + "\n" + cjk if i in (5, 6) else "")) for i in range(100)]
    got = {r.doc_id: r.text.split("\n") for r in linededup.drop_recurring_lines(documents(spark, rows), rules=rules).collect()}
    assert got == {i: t.split("\n") for i, (t, _) in brute_lines(rows, share=0.2).items()}
    # 4 characters need 20 / 2 ** 0.5 documents of the hundred; numbers alone never recur
    assert sum("Les." in t for t in got.values()) == 1 and sum("Some." in t for t in got.values()) == 9 and all("17" in t for t in got.values())
    assert [sum(x in t for t in got.values()) for x in (passage, url, cjk)] == [1, 1, 1]


def test_short_and_unspaced_lines_recur_too(spark):
    rng = random.Random(12)
    url, cjk = "https://example.org/" + "a1b2" * 40, "\u8fd9\u662f\u4e00\u6bb5" * 30 + "2024"
    lines = ["Les.", "And ornd.", "1 2", "3 4", "17", "18", "Page 4", "Page 5", url, url + "x", cjk, "", " \t ", "\tLes. ", "three short words", "item 1 of", "item 2 of", "long " * 9 + "line"]
    rows = [(i, "\n".join([f"own line{i} {'qrs'[i % 3]}{'tuvwx'[i % 5]} of {'abcdefgh'[i % 8]}"] + [rng.choice(lines) for _ in range(rng.randint(0, 6))] + ["end"])) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "Les."), (73, "16"), (74, "\n\n")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.drop_recurring_lines(documents(spark, rows).repartition(4)).collect()}
    assert got == brute_lines(rows)
    for line in ("Les.", "And ornd.", url, url + "x", cjk):
        assert sum(line.split() in [x.split() for x in t.split("\n")] for t, _ in got.values() if t) == 1, line


def test_line_dedup_of_repeated_rows_clashing_names_and_nothing(spark):
    kind = "doc_id long, text string, id string, mark int, drop string, n_dropped string"
    assert linededup.drop_recurring_lines(spark.createDataFrame([], kind)).count() == 0
    line = "some words that recur here"
    rows = [(1, line, "a", 1, "x", "y"), (1, line, "a", 1, "x", "y"), (None, line, "b", 2, "x", "y"), (2, line + "\nown", "c", 3, "x", "y")]
    got = sorted(((r.id, r.text, r.n_dropped, r.drop) for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, kind)).collect()), key=str)
    assert got == [("a", "", 1, "x"), ("a", "", 1, "x"), ("b", line, 0, "x"), ("c", "own", 1, "x")]
    rows = [(1, line, "a", 1, "x", "y"), (1, line + "\nmore", "b", 1, "x", "y"), (1, line + "\nmore", "b", 1, "x", "y"), (1, "other", "c", 1, "x", "y")]
    got = [r.id for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, kind)).collect() if r.n_dropped]
    assert got in (["a"], ["b", "b"])  # of one id the text with the smallest hash keeps it


# Toxicity


def labelled(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["wretchling", "snarkopath", "vilefoot"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxic(spark):
    rows = labelled(900)
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "quiet words " * 3000), (5003, "abc wretchlings and snarkopaths")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5001, 1, None), (7000, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_texts_are_told_apart(spark, toxic):
    rows, docs, labels = toxic
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 4
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i, _, _ in rows)
    right = sum(got[i].predicted == rows[i][2] for i in held)
    assert right / len(held) > 0.93, right / len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[5000].score == got[5001].score and got[5001].predicted == 0
    assert got[5003].predicted == 1  # unseen forms share n-grams


def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(spark, toxic):
    rows, docs, labels = toxic
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("src")})
    scores = lambda d, y: {r.doc_id: r.score for r in toxicity.classify(d, y).collect()}
    assert scores(docs, labels) == scores(other, flipped)


def test_toxic_rows_go_and_columns_stay(spark, toxic):
    rows, docs, labels = toxic
    from pyspark.sql import functions as F

    named = docs.withColumn("score", F.lit("mine"))
    kept = toxicity.drop_toxic(named, labels)
    assert kept.columns == named.columns
    assert {5000, 5001, 5002} <= {r.doc_id for r in kept.collect()}
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    none = labels.where("false")
    assert toxicity.drop_toxic(docs, none).count() <= docs.count()
    one = labels.where("toxic = 0")
    assert {r.predicted for r in toxicity.classify(docs, one).collect()} == {0}


def test_labels_without_a_usable_text_take_no_place_in_the_sample(spark, toxic):
    rows, docs, labels = toxic
    more = spark.createDataFrame([(10_000 + i, 1, i % 2) for i in range(3000)], labels.schema)
    few = toxicity.Settings(rows=60, longest=5000)
    held = {i: y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels.unionAll(more), few).collect()}
    assert sum(got[i] == y for i, y in held.items()) / len(held) > 0.85


def test_scores_of_repeated_rows_and_clashing_names(spark, toxic):
    _, docs, labels = toxic
    from pyspark.sql import functions as F

    odd = docs.limit(50).unionAll(docs.limit(50)).withColumns({"__text": F.lit("a"), "score": F.lit("b"), "Score_": F.lit("c"), "held_out": F.lit("d")})
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.where("score = 'b' and __text = 'a'").count() == kept.count() > 0
    assert toxicity.classify(odd, labels).count() == 100


def test_best_windows_are_those_of_brute_force():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 3, 12, 5, 0, 40, 1])
    parts = rng.normal(size=lengths.sum())
    at, size, means = toxicity.best_windows(parts, lengths, 5)
    start = 0
    for i, n in enumerate(lengths):
        text = parts[start : start + n]
        if n:
            w = min(5, n)
            best = max(text[k : k + w].mean() for k in range(n - w + 1))
            assert means[i] == pytest.approx(best) and size[i] == w
            assert parts[at[i] : at[i] + w].mean() == pytest.approx(best)
        else:
            assert means[i] == 0
        start += n


# LM scoring


SMALL = lm_score.Settings(dim=8, words=30, growth=1, others=4, learned=4000, share=0.2, piece=32, slice=500, rounds=2, epochs=4)


def sentences(n, seed=2):
    rng = random.Random(seed)
    grammar = [["the", "a"], ["red", "blue", "old"], ["cat", "dog", "house"], ["sees", "hears"], ["me", "you"]]
    return [" ".join(rng.choice(g) for _ in range(rng.randint(1, 12)) for g in grammar) + (f" rare{rng.randrange(500)}" if rng.random() < 0.5 else "") for _ in range(n)]


def plain_chance(net, around, word):
    """Log-probability of a word (-1: one outside the vocabulary) from the inputs around it, by loops."""
    h = [math.tanh(net.hidden[d] + sum(net.places[p][x][d] for p, x in enumerate(around))) for d in range(len(net.hidden))]
    classes, size = net.word_bias.shape
    share = lambda logits, at: logits[at] - math.log(sum(math.exp(x) for x in logits))
    kind = classes if word < 0 else word // size
    out = share([sum(h[d] * net.to_class[d][c] for d in range(len(h))) + net.class_bias[c] for c in range(classes + 1)], kind)
    if word >= 0:
        out += share([sum(h[d] * net.to_word[kind][d][w] for d in range(len(h))) + net.word_bias[kind][w] for w in range(size)], word % size)
    return out


def plain_scores(texts, model):
    """The definition, word by word: each one masked, from two words on both sides."""
    out, others = [], len(model.vocabulary)
    number = {}
    for text in texts:
        split = (text or "").lower().split()
        for w in split:
            number.setdefault(w, model.vocabulary.get(w, others + int(lm_score.pd.util.hash_array(np.array([w], dtype=object), categorize=False)[0] % np.uint64(model.settings.others))))
        ids = [number[w] for w in split]
        total = 0.0
        for i, w in enumerate(split):
            around = [ids[i + p] if 0 <= i + p < len(ids) else model.edge for p in (-2, -1, 1, 2)]
            total += plain_chance(model.network, around, model.vocabulary.get(w, -1))
            if w not in model.vocabulary:
                data = [lm_score.END, *w.encode(), lm_score.END]
                total += sum(model.bytes[a * 257 + b] for a, b in zip(data, data[1:], strict=False))
        out.append(total)
    return out


def test_scores_are_those_of_brute_force_whatever_the_partitions(spark):
    texts = sentences(300)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (903, texts[0]), (904, "you hears dog blue a " * 6), (905, "cat " * 3000), (905, "Cat " * 9), (None, "A red dog")]
    table = documents(spark, rows).withColumnsRenamed({"lang": "block", "source": "data"})
    got = lm_score.score(table.repartition(5), settings=SMALL).collect()
    assert len(got) == len(rows)
    model, total = lm_score.fit(table, SMALL)
    assert total == sum(len((t or "").split()) for _, t in rows) == sum(r.n_tokens for r in got)
    want = plain_scores([t for _, t in rows], model)
    told = sorted((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in got)
    wanted = sorted((str(i), len((t or "").split()), s) for (i, t), s in zip(rows, want, strict=True))
    assert [t[:2] for t in told] == [t[:2] for t in wanted]
    assert [t[2] for t in told] == pytest.approx([float(t[2]) for t in wanted], abs=1e-2, rel=1e-4)
    assert {(r.n_tokens, r.log_likelihood, r.per_token) for r in got if r.doc_id in (900, 901, 902)} == {(0, 0.0, None)}
    again = {(r.doc_id, r.n_tokens): r.log_likelihood for r in lm_score.score(table.coalesce(1), settings=SMALL).collect()}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.log_likelihood, abs=1e-2, rel=1e-4) for r in got)


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(4)
    net = lm_score.Network.start(np.array([9.0, 7, 5, 4, 3, 2, 1]), 6.0, 12, 3, 1)
    net = lm_score.Network(*(getattr(net, f).astype(np.float64) for f in ("places", "hidden", "to_class", "class_bias", "to_word", "word_bias")))
    near, word = rng.integers(0, 12, (4, 20)), rng.integers(-1, 7, 20)
    g = net.gradients(near, word)
    dense = {"hidden": g.hidden, "to_class": g.to_class, "class_bias": g.class_bias, "word_bias": g.word_bias, "to_word": np.zeros_like(net.to_word), "places": np.zeros_like(net.places)}
    for c, change in g.to_word:
        dense["to_word"][c] = change
    for p, (rows, change) in enumerate(g.places):
        dense["places"][p, rows] = change
    loss = lambda: -sum(plain_chance(net, near[:, i].tolist(), int(word[i])) for i in range(20)) / 20
    for name, told in dense.items():
        values = getattr(net, name)
        for at in [tuple(x) for x in np.argwhere(np.isfinite(values))[:: max(1, values.size // 25)].tolist()]:
            old = values[at]
            values[at] = old + 1e-5
            up = loss()
            values[at] = old - 1e-5
            down = loss()
            values[at] = old
            assert told[at] == pytest.approx((up - down) / 2e-5, abs=1e-6), (name, at)


def test_slices_learn_by_themselves_and_are_averaged(spark):
    rng = np.random.default_rng(5)
    net = lm_score.Network.start(np.array([5.0, 4, 3, 2]), 2.0, 7, 4, 1)
    assert all((a == b).all() for a, b in zip(net.with_flat(net.flat()).places, net.places, strict=True))
    pieces = [(i % 3, i, rng.integers(0, 6, rng.integers(3, 30)).astype(np.int32)) for i in range(12)]
    table = spark.createDataFrame([(s, n, p.tobytes()) for s, n, p in pieces], "slice long, name long, piece binary").repartition(4)
    got = lm_score.trained(table, net, 4, 6, SMALL, 9)
    total, weight = 0, 0
    for s in range(3):
        mine = [p for k, _, p in pieces if k == s]
        flat, own = np.concatenate(mine), net.with_flat(net.flat())
        own.train(flat, np.where(flat < 4, flat, -1), np.array([len(p) for p in mine]), 6, SMALL.epochs, SMALL.rate, 9)
        total, weight = total + len(flat) * own.flat().astype(float), weight + len(flat)
    assert got.flat() == pytest.approx(total / weight, abs=1e-5)
    assert abs(got.flat() - net.flat()).max() > 0.01


def test_what_is_learned_grows_with_the_corpus(spark):
    settings = dataclasses.replace(SMALL, learned=0, share=0.5)
    sizes = []
    for n in (200, 800):
        texts = [f"{t} x{i}" for i, t in enumerate(sentences(n))]
        total = sum(len(t.split()) for t in texts)
        pieces = lm_score.sample(documents(spark, list(enumerate(texts))).repartition(3), "doc_id", "text", {"the": 0}, settings, total)
        sizes.append(sum(len(r.piece) // 4 for r in pieces.collect()) / total)
    assert sizes == pytest.approx([0.5, 0.5], abs=0.1)


def test_every_word_of_the_corpus_is_learned_from(spark):
    settings = dataclasses.replace(lm_score.Settings(), learned=0, piece=32)
    texts = [*sentences(150), None, "", "cat " * 3000]
    rows = [*enumerate(texts), (7, texts[7]), (None, texts[8])]
    coded = lm_score.coded(documents(spark, rows).repartition(3), "doc_id", "text")
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in rows for w in (t or "").lower().split()}))}
    pieces = lm_score.pieces(coded, vocabulary, settings, 10**12).collect()
    learned = Counter(x for r in pieces for x in np.frombuffer(r.piece, np.int32).tolist())
    assert learned == Counter(vocabulary[w] for _, t in rows for w in (t or "").lower().split())
    assert {r.word: r.n for r in lm_score.word_counts(coded).collect()} == {w: learned[i] for w, i in vocabulary.items()}


def test_a_slice_of_many_pieces_is_learned_to_its_end(spark, monkeypatch):
    rng = np.random.default_rng(6)
    net = lm_score.Network.start(np.array([5.0, 4, 3, 2, 2]), 2.0, 7, 4, 1)  # one place of a class is empty
    table = [(0, i, rng.integers(0, 7, 20).astype(np.int32)) for i in range(12)]
    monkeypatch.setattr(lm_score, "MIXED", 100)
    df = spark.createDataFrame([(s, n, p.tobytes()) for s, n, p in table], "slice long, name long, piece binary").repartition(4)
    own = lm_score.Trainer(net.with_flat(net.flat()))
    for at in (0, 5, 10):
        flat = np.concatenate([p for _, _, p in table[at : at + 5]])
        own.train(flat, np.where(flat < 5, flat, -1), np.full(len(flat) // 20, 20), 6, SMALL.epochs, SMALL.rate, 9)
    assert lm_score.trained(df, net, 5, 6, SMALL, 9, 2).flat() == pytest.approx(own.network.flat(), abs=1e-5)


def test_pieces_are_cut_and_dealt_once_for_all_rounds(spark, monkeypatch):
    made, cut, kinds = [], lm_score.pieces, []
    monkeypatch.setattr(lm_score, "pieces", lambda *a: made.append(cut(*a)) or made[-1])
    model, _ = lm_score.fit(documents(spark, list(enumerate(sentences(150)))), dataclasses.replace(SMALL, rounds=3))
    assert len(made) == 1
    # Each round goes on from the one before, on the same pieces, whatever the numbers' kind is.
    rows, net = made[0].collect(), model.network
    for kind in (np.uint16, np.int32):
        told = [(r.name % 2, r.name, np.frombuffer(r.piece, np.uint16).astype(kind).tobytes()) for r in rows]
        df = spark.createDataFrame(told, "slice long, name long, piece binary")
        kinds.append(lm_score.averaged(lm_score.dealt(df, 2), net, len(model.vocabulary), model.edge, SMALL, 9, kind).flat())
    assert kinds[0] == pytest.approx(kinds[1], abs=1e-5)
    assert abs(kinds[0][:100] - net.flat()[:100]).max() > 0.001


def test_words_are_counted_across_flushes(spark, monkeypatch):
    texts = [*sentences(300), None, ""]
    monkeypatch.setattr(lm_score, "REMEMBERED", 5)
    counts = lm_score.word_counts(lm_score.coded(documents(spark, list(enumerate(texts))).repartition(7), "doc_id", "text")).collect()
    assert {r.word: r.n for r in counts} == Counter(w for t in texts for w in (t or "").lower().split()) and len(counts) == len({r.word for r in counts})


@pytest.mark.parametrize("dim", [3, 4])
def test_training_is_plain_adagrad_however_far_its_steps_go(dim):
    rng = np.random.default_rng(8)
    net = lm_score.Network.start(np.array([9.0, 7, 5, 4, 3, 2, 1]), 6.0, 12, dim, 1)  # the last class is not full
    flat, lengths = rng.integers(0, 11, 6000).astype(np.int32), np.array([1000, 0, 5000])
    word = np.where(flat < 7, flat, -1)
    own, rate = net.with_flat(net.flat()), 2.5
    own.train(flat, word, lengths, 11, 1, rate, 3)
    around, mixed = lm_score.windows(flat, lengths, 11), np.random.default_rng(3).permutation(len(flat))
    values, seen = {"places": net.places, "hidden": net.hidden, "to_class": net.to_class, "class_bias": net.class_bias, "to_word": net.to_word, "word_bias": net.word_bias}, {}
    for i in range(0, len(flat), 2048):
        some = mixed[i : i + 2048]
        g = net.gradients(around[:, some], word[some])
        dense = {"hidden": g.hidden, "to_class": g.to_class, "class_bias": g.class_bias, "word_bias": g.word_bias, "to_word": np.zeros_like(net.to_word), "places": np.zeros_like(net.places)}
        for c, change in g.to_word:
            dense["to_word"][c] = change
        for p, (rows, change) in enumerate(g.places):
            assert len(set(rows.tolist())) == len(rows)
            dense["places"][p, rows] = change
        for name, change in dense.items():
            square = (change**2).mean(-1, keepdims=True) if name == "places" else change**2
            seen[name] = seen.get(name, 1e-6) + square
            values[name] -= rate * change / np.sqrt(seen[name])
    assert own.flat()[np.isfinite(own.flat())] == pytest.approx(net.flat()[np.isfinite(net.flat())], abs=2e-2, rel=1e-2)


def test_lm_of_an_empty_table(spark):
    assert lm_score.score(documents(spark, [])).count() == 0


# HTML

PAGES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>one<li>two<ol start=3><li>x</ol></ul>", "- one\n- two\n  3. x"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>", "Name       Qty\napple pie  3"),
    ("<head><title>T</title></head><body>x<script>if(a<b){}</script><style>p{}</style>y", "xy"),
    ('<div hidden>no</div><div style="display:none">no</div><span style="visibility: hidden">no</span><b>yes</b>', "yes"),
    ("a<br>b<br/><br>c", "a\nb\n\nc"),
    ("<pre>\n  x\n y</pre>z", "  x\n y\n\nz"),
    ("1 &lt; 2 &amp; 3&nbsp;&copy", "1 < 2 & 3\xa0©"),
    ("<!-- <p>no</p> -->yes<!DOCTYPE html>", "yes"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<details><summary>s</summary>hidden</details><details open><summary>s2</summary>shown</details>", "s\ns2\nshown"),
    ("</p>text</div><i>un<b>closed", "text unclosed".replace(" un", "un")),
    ("<p>cut off at the en<a href=\"x", "cut off at the en"),
    ("", ""),
    (None, None),
    ("  \n ", ""),
    ("<h1>H</h1><p>one\n two</p>", "H\n\none two"),
    ("<select><option>a<option>b</select>", "a\nb"),
]


def test_pages_are_rendered_as_they_look(spark):
    rows = [(i, page, "x") for i, (page, _) in enumerate(PAGES)]
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()}
    for i, (page, want) in enumerate(PAGES):
        assert got[i].text == want, page
    assert got[0].n_lines == 3 and got[13].n_lines == 0 and got[14].n_lines is None
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_deep_and_broken_pages_keep_their_text():
    assert html_text.render("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.render("<ul><li>" * 1000 + "deep").strip(" -") == "deep"
    assert "tail" in html_text.render("<b" + " x" * 5000 + ">tail")
    rng = random.Random(9)
    for _ in range(300):
        html_text.render("".join(rng.choice(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "x ", "<", "&", "\"", "<!--", "-->", "<script>", "</script>"]) for _ in range(60)))


MISPLACED = [
    ("<table><tr><form><td>x</td></form></tr></table>", "x"),
    ("<table><tbody><td>x<td>y</table>", "x  y"),
    ("<table><tr>text <b>bold</b><td>x</table>", "text bold\nx"),
    ("<table><tbody><div>a</div><tr><td>x</td></tr><p>b</p></tbody></table>", "a\n\nb\n\nx"),
    ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    ("<table><caption>C</caption><colgroup>g<col></colgroup><tr><div>d<td>x</table>z", "C\ng\nd\nx\n\nz"),
    ("<table><tr><td>a<table><tbody><td>in</table>b<td>c</table>", "a   c\nin\nb"),
    ("<table><tr hidden><td>no</tr><tbody style='display:none'><td>no</tbody><tr><td hidden>no</td><td>x</table>", "x"),
]
SEEN = [
    '<p title="the hidden cost">x</p>',
    '<p alt="a hidden gem">x</p>',
    '<body style="overflow: hidden !important"><p>x</p>',
    '<p data-type="hidden">x</p>',
    '<p data-style="display:none" class=hidden aria-hidden=false>x</p>',
    '<p style="display:none;display:block">x</p>',
    '<p title="style=display:none">x</p>',
]
UNSEEN = ["<dialog>x</dialog>", "<svg><title>x</title><defs><text>x</text></defs><desc>x</desc></svg>", "<math><annotation>x</annotation></math>", "<p style='v&#105;sibility:hidden'>x</p>", "<p HIDDEN>x</p>", '<p hidden="">x</p>', '<p id=a hidden>x</p>', '<p style="color:red; DISPLAY : none !important; display:block">x</p>', "<p style=visibility:hidden>x</p>", '<p style="visibility&#58;collapse">x</p>', '<details title="open "><p>x</p></details>']


def test_misplaced_parts_of_tables_keep_their_text():
    for page, want in MISPLACED:
        assert html_text.render(page) == want, page
    rng = random.Random(4)
    tags = "table tr td th tbody thead tfoot caption colgroup form div p b".split()
    for _ in range(400):
        parts = [rng.choice(["w%d " % i, "<%s>" % rng.choice(tags), "</%s>" % rng.choice(tags)]) for i in range(60)]
        got = html_text.render("".join(parts)).split()
        assert sorted("".join(got)) == sorted("".join(x for x in parts if x[0] == "w").replace(" ", "")), parts
    for most in (190, 203, 5000):
        assert "kept" in html_text.render("<div>" * most + "<table><tr><td>kept")
        assert "kept" in html_text.render("<div>" * most + "<table><td>kept")
    assert "deep" in html_text.render("<table>" * 1000 + "deep")
    assert "deep" in html_text.render("<table><tr><td>" * 1000 + "deep")
    assert "deep" in html_text.render("<table><td>" * 1000 + "deep")


def test_only_attributes_of_that_name_hide():
    for page in SEEN:
        assert html_text.render(page) == "x", page
    for page in UNSEEN:
        assert html_text.render(page) == "", page
    assert html_text.render('<ol data-start="7" start=" 3"><li>x</ol>') == "3. x"


def test_rules_hold_at_any_depth():
    for n in (250, 30_000):
        page = "<div>" * n + "<div hidden>SECRET</div><p>seen<ul><li>item</ul><pre> kept  spaces</pre><table><tr><td>a<td>b<tr><td>long<td>c</table>"
        assert html_text.render(page) == "seen\n\n- item\n\n kept  spaces\n\na     b\nlong  c"
        assert html_text.render("<p>" + "<span>" * n + "x" + "</span>" * n + "<p>y") == "x\n\ny"
        assert html_text.render("<ul><li>" * n + "x<p>y").split() == ["-", "x", "y"]
    assert html_text.render("<table><tr><td>" * 3000 + "in").strip() == "in"


SPANS = [
    ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>c</table>", "wide  c\na  b  c"),
    ("<table><tr><td colspan=2>very wide<td>c<tr><td>a<td>b<td>c</table>", "very wide  c\na  b       c"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tbody><tr><td rowspan=9>a<td>b</tbody><tbody><tr><td>c<td>d</tbody></table>", "a  b\nc  d"),
    ("<table><tr><td colspan=0>a<td colspan=x>b<tr><td colspan=99999>c</table>", "a  b\nc"),
    ("<table><tr><td>a<td><td>b<tr><td>cc<td><td>d</table>", "a   b\ncc  d"),
    ("<table><tr><td>a<br>bb<td>c<tr><td>d<td>e</table>", "a   c\nbb\nd   e"),
]


def test_cells_stand_in_their_columns():
    for page, want in SPANS:
        assert html_text.render(page) == want, page
    row = "<tr>" + "".join(f"<td>{'x' * (30 + i % 5)}" for i in range(40))
    lines = html_text.render(f"<table>{row}<tr>{'<td>y' * 40}</table>").split("\n")
    assert [i for i, c in enumerate(lines[1]) if c == "y"] == [i for i, c in enumerate(lines[0]) if c == "x" and (i == 0 or lines[0][i - 1] == " ")]
    long = "word " * 200
    assert html_text.render(f"<table><tr><td>{long}<td>b<tr><td>aaa<td>c<tr><td>a<td>d</table>") == f"{long.strip()}  b\n{'aaa':402}c\n{'a':402}d"


def plain_rendering(tree):
    """Blocks, inline elements, line breaks and hidden parts, by recursion."""
    lines, line = [], []

    def end():
        if line:
            lines.append(" ".join(line))
            line.clear()

    def walk(node):
        for child in node[1]:
            if isinstance(child, str):
                line.append(child)
            elif child[0] == "br":
                if line:
                    end()
                elif lines:
                    lines.append("")
            elif child[0] in ("div", "section"):
                end()
                walk(child)
                end()
            elif child[0] not in ("script", 'div hidden', 'b style="display:none"'):
                walk(child)

    walk(tree)
    end()
    return "\n".join(lines)


def test_random_trees_are_rendered_as_by_a_plain_renderer():
    rng = random.Random(11)
    tags = ["div", "section", "b", "span", "i", "br", "script", "div hidden", 'b style="display:none"']

    def tree(depth):
        tag = rng.choice(tags)  # a script holds text alone
        return (tag, [f"w{rng.randrange(99)}" if rng.random() < 0.5 or depth > 5 or tag == "script" else tree(depth + 1) for _ in range(rng.randrange(5))])

    def page(node):
        inner = " ".join(c if isinstance(c, str) else page(c) for c in node[1])
        return "<br>" if node[0] == "br" else f"<{node[0]}> {inner} </{node[0].split()[0]}>"

    for _ in range(400):
        node = ("div", [tree(0) for _ in range(4)])
        assert html_text.render(page(node)) == plain_rendering(node), page(node)


def test_pages_repeated_and_without_ids(spark):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (None, "b", "y"), (None, None, "y"), (2, "c" * 2_000_000, "z")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, n_lines string")).collect()
    assert sorted(((str(r.page_id), (r.text or "")[:3], r.n_lines) for r in got), key=str) == [("1", "a", 1), ("1", "a", 1), ("2", "ccc", 1), ("None", "", None), ("None", "b", 1)]


SHOWN_AGAIN = [
    ('<span style="visibility:hidden">no<b style="visibility:visible">yes</b></span>', "yes"),
    ('<div style="visibility:hidden">no<p>no<i style="visibility:inherit">no</i><u style="visibility:initial">yes</u></p></div>', "yes"),
    ('<ul style="visibility:hidden"><li>no<li style="visibility:visible">yes</ul>', "- yes"),
    ('<table><tbody style="visibility:hidden">no<tr>no<td>no<td style="visibility:visible">yes<tr style="visibility:visible"><td>one<td>two</table>', "     yes\none  two"),
    ('<hr style="visibility:hidden">a<hr>b', "a\n---\nb"),
    ("<dialog open>yes</dialog><dialog>no</dialog>", "yes"),
    ("a <svg><g><text>in a drawing</text></g></svg> b", "a in a drawing b"),
    ("x = <math><mi>a</mi><mo>+</mo><mi>b</mi></math>", "x = a+b"),
    ("<style>p { display: none }</style><p>sheets are not looked at</p>", "sheets are not looked at"),
]


@pytest.mark.parametrize(("page", "text"), SHOWN_AGAIN)
def test_visibility_is_inherited_and_turned_on_again(page, text):
    assert html_text.render(page) == text


def test_columns_grow_up_to_their_most_and_no_further():
    for n in (398, 399, 400, 401, 900):
        rows = html_text.render(f"<table><tr><td>{'a' * n}<td>b<tr><td>c<td>d</table>").split("\n")
        assert rows[0] == "a" * n + "  b" and rows[1] == "c".ljust(min(n, 400) + 2) + "d"


def test_no_pages(spark):
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string, text int")).count() == 0
