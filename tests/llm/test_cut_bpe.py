"""Forced-boundary BPE against the tokenizers library, which encodes and decodes whole texts."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import cut_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n", "a", "don't we'LL 'S", "a!'s b", "x'", "''ss'rere", "<|endoftext|>", "x<|endoftext|> <|endoftext|<|endoftext|>y <|END|>", "İstanbul ΣΑΣ ½²Ⅷ", "日本語テキスト 😀👍🏽",
    "x\x1cy a\x85b\xa0c　　ꙮ  ꙮ", "aaaa" * 60, "abab" * 60, "a b  c\n d\n\ne ", "word " * 3000, "z" * 200_000, "ꙮ" * 3000, "same text", "same text", "éà ​﻿",
]
POOL = [*"aabeinst'' \n\t.,!?0123éüßñ😀Ωσ日本 　 ​\x1c\x85ꙮ𐍈ˈ́²½sredl<|>", "<|endoftext|>", "'s", "'re", "  ", "\r\n", " '", "!'", "n't"]


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def docs(spark, texts):
    # Other columns carry the names of results.
    return spark.createDataFrame([(i, t, "clash", i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int, ids_sha256 string")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_digests_are_the_library_s(spark):
    library = Tokenizer.from_file(PATH)
    texts = ODD + noise(2000, 7)
    got = {r.doc_id: r for r in cut_bpe.digests(docs(spark, texts), PATH).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(decoded.encode())), text


def test_fragments_tile_the_text_and_are_encoded_by_themselves():
    bpe, library = cut_bpe.CutBpe(PATH), Tokenizer.from_file(PATH)
    cuts = 0
    for text in ODD[1:] + noise(3000, 8):
        pieces = bpe.fragments(text.encode())
        assert b"".join(pieces) == text.encode()
        cuts += len(pieces)
        each = [i for p in pieces for i in library.encode(p.decode(), add_special_tokens=False).ids]
        assert each == library.encode(text, add_special_tokens=False).ids
        for a, b in zip(pieces, pieces[1:], strict=False):
            assert not any(a[-1:] + b[:1] in token for token in (b"'s", b"<|endoftext|>"))
    assert cuts > 20_000


def test_no_cut_lies_inside_of_a_token():
    bpe = cut_bpe.CutBpe(PATH)
    made = json.load(open(PATH, encoding="utf-8"))
    assert len(bpe.bytes_of) == len(made["model"]["vocab"]) + 1
    for token in bpe.bytes_of.values():
        assert all(bpe.inside[x, y] for x, y in zip(token, token[1:], strict=False))


def test_ids_come_back_as_text(spark):
    texts = ODD + noise(200, 9)
    encoded = cut_bpe.encode(docs(spark, texts), PATH)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert rows[0].ids == [] and rows[0].n_fragments == 0 and rows[texts.index("ꙮ" * 3000)].n_fragments >= 1
    back = {r.doc_id: r.text for r in cut_bpe.decode(encoded, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    # Half a character is no text; null lists give nothing.
    half = spark.createDataFrame([(1, rows[texts.index("ꙮ" * 3000)].ids[:1]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in cut_bpe.decode(half, PATH).collect()} == {1: Tokenizer.from_file(PATH).decode(rows[texts.index("ꙮ" * 3000)].ids[:1]), 2: ""}


def test_memory_can_be_emptied_and_long_fragments_are_not_kept(monkeypatch):
    monkeypatch.setattr(cut_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(cut_bpe, "SHORT", 6)
    bpe, library = cut_bpe.CutBpe(PATH), Tokenizer.from_file(PATH)
    texts = ["one two three four five extraordinarily", "six one extraordinarily seven", "one one eight nine"]
    want = [library.encode(t).ids for t in texts]
    for _ in range(3):
        found = bpe.texts(texts)
        assert [[int(i) for i in b"".join([x[0] for x in f]).split(b",")[:-1]] for f in found] == want
    assert all(len(k) <= 6 for k in bpe.known)


def test_empty_table_null_ids_and_other_tokenizers(spark):
    assert cut_bpe.digests(docs(spark, []), PATH).count() == 0 and cut_bpe.encode(docs(spark, []), PATH).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in cut_bpe.digests(nulls, PATH).collect()) == [0, 2]
    with pytest.raises(ValueError):
        cut_bpe.CutBpe(public_tokenizers.path("word_bpe_49k.json"))
