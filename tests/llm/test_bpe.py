"""Byte-level BPE against the tokenizers library and against plain merging."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assetlake.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = [
    "a", "b", "e", "the", "ing", "T", " ", " ", "  ", "\n", "\t", "\r", "\0", "'s", "'ll", "'", "1", "23", "²", "Ⅷ", "é", "ß", "日", "本", "́",
    "\x1c", "\x1f", "\x85", "\xa0", "​", " ", "　", "﻿", "᠎", "😀", ".", ",", "!!", "_", "-", "<|endoftext|>", "<|", "ा", "१"]


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


@pytest.mark.parametrize("at_once", [400_000, 40])
def test_odd_texts_as_the_library(words, library, monkeypatch, at_once):
    monkeypatch.setattr(bpe, "_AT_ONCE", at_once)
    rng = random.Random(7)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(120))) for _ in range(3000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [ids(i) for i in bpe.Encoder(words, most_bytes=20_000).of(texts)]
    assert got == want
    decoder = bpe.Decoder(words)
    assert [decoder.of(np.array(i, dtype=np.int32)) for i in got] == texts


def test_speculated_words_are_the_merged_ones(words):
    rng = random.Random(8)
    tokens = [b for b in words.bytes_of if b]
    some = [b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 5))) for _ in range(20_000)] + [b"a" * n for n in range(1, 40)]
    merged = words.merged(some)
    assert words.encode_words(some) == merged
    tokens, of = words.proposals(some)
    assert sorted(of.tolist()) == of.tolist() and words.proposals([b"", b""])[0].tolist() == []
    proposed = [tokens[of == k].astype("<u4").tobytes() for k in range(300)]
    assert b"".join(words.bytes_of[i] for i in tokens) == b"".join(some)
    failing = sum(p != m for p, m in zip(proposed, merged))
    assert 0 < failing < 150


def test_words_merge_as_one_pair_after_the_other(words):
    rng = random.Random(9)
    for n in (2, 50, 400):
        word = bytes(rng.choice(b"aehint") for _ in range(n))
        base = [words.by_bytes[word[i:i + 1]] for i in range(n)]
        plain = list(base)
        while found := [(words.merge_of[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in words.merge_of]:
            (_, made), i = min(found)
            plain[i:i + 2] = [made]
        assert words._merged_by_heap(list(base)) == plain == ids(words.merged([b"", word])[1])


def test_ids_that_are_no_text(words, library):
    rng = random.Random(10)
    decoder = bpe.Decoder(words)
    for _ in range(300):
        some = [rng.randrange(50_257) for _ in range(6)]
        assert decoder.of(np.array(some)) == library.decode(some, skip_special_tokens=False)
    assert decoder.of(np.array([-1, 70_000, 64])) == library.decode([64])


def test_odd_rows(spark, library):
    long = "word and " * 120_000 + "x" * 300_000
    rows = [(1, None, "p"), (1, "", "p"), (None, "Hello  world\n<|endoftext|> it's", None), (2, long, "q"), (2, long, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(df, PATH, keep=["doc_id", "ids"], into="_j")
    back = bpe.decode(coded, PATH, keep=["doc_id", "ids", "_j"], ids="_j").collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.ids) for r in back))) == sorted(map(repr, ((a, b or "", c) for a, b, c in rows)))
    assert all(r._j == library.encode(r.text, add_special_tokens=False).ids for r in back)
    lists = spark.createDataFrame([(1, None), (2, []), (3, [None, 64, -5])], "doc_id int, ids array<long>")
    assert {r.doc_id: r.text for r in bpe.decode(lists, PATH).collect()} == {1: None, 2: "", 3: "a"}
    assert bpe.encode(df.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        bpe.encode(df, PATH, into="doc_id")


def test_op13_against_the_library(spark, library, tmp_path):
    import hashlib

    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é <|endoftext|>\n\n x")], "doc_id long, text string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = queries.queries()["op13_bpe_round_trip"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    want = set()
    for r in docs.collect():
        i = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(i), sha(",".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))))
    assert set(map(tuple, got.collect())) == want
