import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import bytebpe, packing, wordbpe

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "\n", "a", "don't we'LL 'S", "<|endoftext|>", "x<|startoftext|>y <|END|>", "İstanbul ΣΑΣ ½²Ⅷ", "日本語テキスト 😀👍🏽", "x\x1cy a\x85b\xa0c",
    "aaaa" * 60, "abab" * 60, "a b  c\n d\n\ne ", "word " * 3000, "z" * 5000, "same text", "same text",
]


def noise(n, seed=0):
    rng = random.Random(seed)
    letters = "aabbeinnsstth'.,!  \n\téüßñ0123😀Ωσ日<|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def docs(spark, texts):
    # Other columns carry the names of results.
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int")


def test_merger_applies_all_occurrences_only_where_order_cannot_matter():
    # ab (rank 0) then abc; cab is made late but abc early: c,a,b -> the order of ranks decides.
    merger = wordbpe.RankMerger([(1, 2, 4), (4, 3, 5), (3, 4, 6)])
    flat, n = merger.merge(np.array([1, 2, 3, 1, 2, 3, 3, 3]), np.array([6, 2]))
    assert flat.tolist() == [5, 5, 3, 3] and n.tolist() == [2, 2]
    runs = wordbpe.RankMerger([(1, 1, 2)])
    assert runs.merge(np.array([1] * 5), np.array([5]))[0].tolist() == [2, 2, 1]


def test_token_counts_are_the_library_s(spark):
    texts = ODD + noise(300)
    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in wordbpe.count_tokens(docs(spark, texts), WORD, 100).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 100), text


def test_word_memory_can_be_emptied_in_the_middle_of_a_batch(monkeypatch):
    monkeypatch.setattr(wordbpe, "REMEMBERED", 3)
    memory = wordbpe.WordMemory(wordbpe.WordBpe(WORD), False)
    texts = ["one two three four five", "six one seven", "one one eight nine"]
    want = [[len(memory.bpe.library.encode(w, add_special_tokens=False).ids) for w in t.split()] for t in texts]
    for _ in range(3):
        assert memory.words(texts) == want


def test_counts_and_ids_of_texts_are_those_of_their_words(monkeypatch):
    monkeypatch.setattr(wordbpe, "REMEMBERED", 4)
    bpe = wordbpe.WordBpe(WORD)
    counting, spelling = wordbpe.WordMemory(bpe, False), wordbpe.WordMemory(bpe, True)
    for texts in (["one two  three", "", "it's <|endoftext|> une forêt", "a\x1cb", "日本 語 one"], [], [""], ["four five six seven eight one two"], ["one two three four", "\n one"]):
        want = [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert counting.token_counts(texts).tolist() == list(map(len, want))
        ids, n = spelling.token_ids(texts)
        assert (ids.tolist(), n.tolist()) == ([x for w in want for x in w], list(map(len, want)))
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice("ab <|'\t\x1b\x1c\x1f\x7fé日ı") for _ in range(rng.randrange(6)))
        assert wordbpe.is_unusual(text) == bool(wordbpe._UNUSUAL.search(text))


def test_words_asked_for_again_stay_when_the_memory_is_renewed(monkeypatch):
    monkeypatch.setattr(wordbpe, "REMEMBERED", 20)
    memory = wordbpe.WordMemory(wordbpe.WordBpe(WORD), True)
    learned = []
    plain = memory.plain
    monkeypatch.setattr(memory, "plain", lambda words: learned.extend(words) or plain(words))
    for i in range(30):
        memory.token_ids([f"often new{'x' * i} also"])
    assert learned.count("often") == learned.count("also") == 1 and len(memory.known) + len(memory.old) <= 2 * 25


def test_ranks_are_found_where_hashes_clash():
    rng = random.Random(3)
    pairs = rng.sample([(a, b) for a in range(300) for b in range(300)], 5000)
    merger = wordbpe.RankMerger([(a, b, 300 + i) for i, (a, b) in enumerate(pairs)])
    assert merger.shared.any()
    rank = {p: i for i, p in enumerate(pairs)}
    left, right = np.divmod(np.arange(90_000), 300)
    assert merger.ranks(left, right).tolist() == [rank.get(p, wordbpe.NONE) for p in zip(left.tolist(), right.tolist(), strict=True)]


def test_empty_table(spark):
    empty = docs(spark, [])
    assert wordbpe.count_tokens(empty, WORD, 10).count() == 0
    assert bytebpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.pack_documents(empty, WORD).count() == 0


def test_byte_bpe_is_tiktoken_s_and_comes_back(spark):
    texts = ODD + noise(300, 1)
    memory = bytebpe.part_memory(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=memory.bpe.ranks, special_tokens={})
    table = docs(spark, texts)
    for r in bytebpe.digests(table, RANKS, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids), text
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest(), text


def test_byte_bpe_offsets_and_texts(spark):
    texts = ["ab cd", "日本語 é", "", None]
    encoded = bytebpe.encode(docs(spark, texts), RANKS, public_tokenizers.PATTERN)
    bpe = bytebpe.part_memory(RANKS, public_tokenizers.PATTERN).bpe
    for r in encoded.collect():
        data = (texts[r.doc_id] or "").encode()
        ends = [*r.starts[1:], len(data)]
        assert [data[a:b] for a, b in zip(r.starts, ends)] == [bpe.tokens[i] for i in r.ids]
        assert "".join(bpe.decode_text(r.ids)) == data.decode()  # split characters are put together
        assert list(r.char_starts) == [len(data[:a].decode("utf-8", "ignore")) if a == 0 or data[a] & 0xC0 != 0x80 else len(data[:a].decode("utf-8", "ignore")) for a in r.starts]
    back = {r.doc_id: r.text for r in bytebpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_ties_of_any_length_are_the_rank_file_s():
    bpe = bytebpe.part_memory(RANKS, public_tokenizers.PATTERN).bpe
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(6)
    parts = ["".join(rng.choice(a) for _ in range(rng.choice([3, 8, 40, 65, 300]))) for a in ("ab", "an", "é日", "=-", "aeiou", "éèê") for _ in range(60)]
    parts += ["=" * 500, "-=" * 300, "nan" * 100, "日本" * 200, "ab" * 20_000]
    for part in parts:
        want = library.encode_ordinary(part)
        assert bpe.encode_each([part])[0].tolist() == want, part[:80]
        assert [i for m in bpe.matches(part) for i in bpe.by_rank(m.encode())] == want, part[:80]
    texts = [" ".join(rng.sample(parts[:-1], 3)) + rng.choice(["", "  ", "\n\n", "\n x"]) for _ in range(40)]
    memory = bytebpe.PartMemory(bpe)
    for _ in range(2):
        assert [t[0] for t in memory.texts(texts)] == ["".join(f"{i}," for i in library.encode_ordinary(t)).encode() for t in texts]


def test_encoding_and_decoding_of_nothing(spark):
    empty = bytebpe.encode(docs(spark, []), RANKS, public_tokenizers.PATTERN)
    assert empty.count() == 0 and bytebpe.decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing_holds_every_id_once_and_fills_sequences(spark):
    texts = ODD + noise(200, 2) + ["some longer text of words " * 400] * 5
    library = Tokenizer.from_file(WORD)
    table = docs(spark, texts).repartition(3)
    rows = packing.pack_documents(table, WORD).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert len(pieces) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            data = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length])
            assert r.ids_crc32 == zlib.crc32(data)
            at += r.length
        assert at == len(ids)
    padded = total = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padded += at if at & (at - 1) == 0 else 2048
    assert padded / total < 1.02


def test_packer_keeps_all_three_limits():
    rng = random.Random(4)
    packer = packing.Packer(packing.Limits(512, 8, 100))
    lengths = [rng.randint(1, 900) for _ in range(200)]
    quiet = [rng.randint(0, 700) for _ in range(200)]
    packer.add(list(range(200)), lengths, quiet)
    packer.finish()
    held, loss, segments = {}, {}, {}
    for name, start, length, sequence, offset, borne in packer.pieces:
        assert held.get(sequence, 0) == offset
        held[sequence] = offset + length
        segments[sequence] = segments.get(sequence, 0) + 1
        loss[sequence] = loss.get(sequence, 0) + max(0, start + length - max(start, quiet[name]))
        assert borne == max(0, start + length - max(start, quiet[name]))
    assert sum(held.values()) == sum(lengths)
    assert max(held.values()) <= 512 and max(segments.values()) <= 8 and max(loss.values()) <= 100


def test_the_largest_dot_product_is_placed_first():
    packer = packing.Packer(packing.Limits(100, 4, 50))
    packer.add([0, 1, 2], [60, 50, 30], [60, 5, 0])
    packer.fill(100)
    # (60, 1, 0): 0.6 + 0.25; (50, 1, 45): 0.5 + 0.25 + 0.9; (30, 1, 30): 0.3 + 0.25 + 0.6
    assert [p[0] for p in packer.pieces][:1] == [1]
    free = np.array([50, 3, 5]) / np.array([100, 4, 50])
    assert packer.pieces[1][0] == 0 and free.min() > 0  # the others fit no more: a cut from the largest


def test_conversations_are_packed_under_all_three_limits(spark):
    library = Tokenizer.from_file(WORD)
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    said = lambda own: f"case when role {'=' if own else '<>'} 'assistant' then text end"
    table = turns.selectExpr("conv_id * 1000 + turn as turn_id", "text as other", f"{said(False)} as prompt", f"{said(True)} as reply").repartition(2)
    limits = packing.Limits(512, 6, 200)
    rows = packing.pack_documents(table, WORD, limits, id_col="turn_id", text_col="reply", prompt_col="prompt").collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.turn_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    ids_of = lambda text: library.encode(text or "", add_special_tokens=False).ids
    for t in table.collect():
        quiet, ids = len(ids_of(t.prompt)), [*ids_of(t.prompt), *ids_of(t.reply), 1]
        at = 0
        for r in sorted(pieces.pop(t.turn_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            assert r.loss_tokens == sum(i >= quiet for i in range(at, at + r.length))
            at += r.length
        assert at == len(ids)
    assert not pieces
    for parts in sequences.values():
        assert sum(r.length for r in parts) <= 512 and len(parts) <= 6 and sum(r.loss_tokens for r in parts) <= 200
    assert max(sum(r.loss_tokens for r in parts) for parts in sequences.values()) == 200


def plain_fill(examples, limits, tokens):
    """One sequence, by going through all (name, start, left, quiet) for each piece."""
    most = [limits.tokens, limits.segments, limits.tokens if limits.loss is None else limits.loss]
    free, pieces = [min(most[0], tokens), most[1], most[2]], []
    while free[0] >= 1 and free[1] >= 1 and examples:
        bare = lambda e: max(0, e[3] - e[1])
        loss = lambda e: min(e[2], max(e[1] + e[2] - e[3], 0))
        whole = [e for e in examples if e[2] <= free[0] and loss(e) <= free[2] and (free[1] > 1 or e[2] == free[0])]
        product = lambda e: e[2] * free[0] / most[0] ** 2 + (loss(e) * free[2] / most[2] ** 2 + free[1] / most[1] ** 2)
        if whole:
            best = max(whole, key=product)
            length = best[2]
        else:
            cut = lambda e: min(e[2], free[0], bare(e) + free[2])
            able = [e for e in examples if cut(e) >= 1]
            if not able:
                break
            best = max(able, key=lambda e: e[2])
            length = cut(best)
        borne = max(0, length - bare(best))
        pieces.append((best[0], best[1], length, borne))
        free = [free[0] - length, free[1] - 1, free[2] - borne]
        best[1] += length
        best[2] -= length
        if not best[2]:
            at = examples.index(best)
            examples[at] = examples[-1]  # the last one takes its place
            examples.pop()
    return pieces


def test_packer_is_the_plain_one():
    rng = random.Random(8)
    for limits in (packing.Limits(64, 6), packing.Limits(50, 5, 12), packing.Limits(40, 3, 1)):
        packer, examples = packing.Packer(limits), []
        lengths, quiet = [rng.randint(1, 90) for _ in range(120)], [rng.choice([0, 0, rng.randint(0, 90)]) for _ in range(120)]
        packer.add(list(range(120)), lengths, quiet)
        examples = [[i, 0, n, q] for i, (n, q) in enumerate(zip(lengths, quiet, strict=True))]
        for _ in range(60):
            if not examples:
                break
            packer.pieces.clear()
            packer.fill(limits.tokens)
            assert [(p[0], p[1], p[2], p[5]) for p in packer.pieces] == plain_fill(examples, limits, limits.tokens)


def test_a_prompt_is_cut_when_no_more_loss_is_allowed():
    packer = packing.Packer(packing.Limits(100, 8, 10))
    packer.add([0, 1, 2], [10, 500, 80], [0, 0, 60])
    packer.fill(100)
    assert [(p[0], p[2], p[5]) for p in packer.pieces] == [(0, 10, 10), (2, 60, 0)]
    for broken in ({"loss": 0}, {"tokens": 0}, {"segments": 0}):
        with pytest.raises(ValueError):
            packing.Limits(**broken)


def test_undoubted_matches_have_the_library_s_ids(spark):
    bpe = bytebpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(12)
    short = [t.decode("latin-1") for t in bpe.ranks if 1 < len(t) < 5 and t.isalpha()]
    repeats = ["".join(rng.choice([a, a, a[:-1], a[1:], rng.choice(short)]) for _ in range(rng.randint(2, 6))) for a in rng.choices(short, k=4000)]
    parts = sorted({m for t in texts + repeats for m in bpe.matches(t) if m})
    sure = [p for p in parts if not bpe.doubtful(p.encode())]
    assert 0 < len(parts) - len(sure) < 0.2 * len(parts)
    for part, found in zip(sure, bpe.library.encode_batch_fast(sure, add_special_tokens=False), strict=True):
        assert found.ids == library.encode_ordinary(part), part
    for part in set(parts) - set(sure):
        assert bpe.by_rank(part.encode()) == library.encode_ordinary(part), part


def test_offsets_are_the_library_s(spark):
    texts = [t for t in ODD if t] + noise(200, 3)
    library = bytebpe.ByteBpe(RANKS, public_tokenizers.PATTERN).library
    rows = bytebpe.encode(docs(spark, texts), RANKS, public_tokenizers.PATTERN).collect()
    same = 0
    for r in rows:
        told = library.encode(texts[r.doc_id], add_special_tokens=False)
        if told.ids == r.ids:
            same += 1
            assert r.char_starts == [a for a, _ in told.offsets]
            assert r.char_starts == bytebpe.character_starts(texts[r.doc_id].encode(), np.array(r.starts)).tolist()
    assert same >= 0.9 * len(rows)
