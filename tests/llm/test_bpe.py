"""Byte-pair encoding against the tokenizers library and a plain version of the merges."""

from __future__ import annotations

import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packlens.llm import bpe
from packlens.llm.q_bpe import VOCABULARY, op13_bpe

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.WordTokenizer(PATH)


def encoded(own, texts):
    out = [[] for _ in texts]
    for i, _, ids in bpe._encoded(own, texts):
        out[i] += ids.tolist()
    return out


def test_every_character_and_mixed_texts(own, library):
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[i : i + 300]) for i in range(0, len(every), 300)]
    rng = random.Random(1)
    pool = "aAbBéÉΣσςİ ̇ '’sŚ <|endoftext|>12½²日本語ก\n\t"
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    texts += ["<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|ENDOFTEXT|>", "aaaa" * 50, "", "'s't'LL it's", "abc" * 8000, "ab " * 5]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = encoded(own, texts)
    assert got == want
    assert [own.decode(np.array(g, np.int64)) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    got = encoded(bpe.tokenizer(PATH), [text])[0]
    assert got == _LIBRARY.encode(text, add_special_tokens=False).ids


_LIBRARY = Tokenizer.from_file(PATH)


def plain_merges(pairs, word):
    rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(pairs)}
    while found := [(rank[p][0], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in rank]:
        i = min(found)[1]
        word = [*word[:i], rank[word[i], word[i + 1]][1], *word[i + 2 :]]
    return word


@pytest.mark.parametrize("longest", [20_000, 0])
def test_rounds_are_the_plain_merges(monkeypatch, longest):
    """Few letters, so that pairs overlap and repeat; with ``longest`` 0 every word goes through the heap."""
    monkeypatch.setattr(bpe, "LONG_WORD", longest)
    rng = random.Random(4)
    symbols, pairs = 3, []
    while len(pairs) < 40:
        a, b = rng.randrange(symbols), rng.randrange(symbols)
        if (a, b) not in [p[:2] for p in pairs]:
            pairs.append((a, b, symbols))
            symbols += 1
    merges = bpe.Merges(pairs, symbols)
    words = [[rng.randrange(3) for _ in range(rng.randint(1, 40))] for _ in range(400)] + [[0] * n for n in range(1, 30)]
    flat, sizes = merges.merged(np.array([s for w in words for s in w]), np.array([len(w) for w in words]))
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [plain_merges(pairs, w) for w in words]


def test_pairs_ranked_before_their_symbols_are_refused():
    with pytest.raises(ValueError, match="before"):
        bpe.Merges([(0, 2, 3), (0, 1, 2)], 4)


def test_pieces_and_forgotten_words(monkeypatch, own, library):
    monkeypatch.setattr(bpe, "PIECE_WORDS", 7)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 20)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    assert encoded(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_columns_of_nulls_empties_repeats_and_long_texts(spark, library):
    texts = [None, "", " \n", "Same text", "Same text", "<|endoftext|>", "word " * 50_000, "x" * 30_000]
    docs = spark.createDataFrame([(i, t, "kept", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    got = docs.select("doc_id", "ids", bpe.encode(F.col("text"), PATH).alias("e")).withColumn("d", bpe.decode(F.col("e"), PATH)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert r["e"] == want and r["d"] == library.decode(want, skip_special_tokens=False) and r["ids"] == "kept"
    odd = spark.createDataFrame([(None,), ([],), ([None, 320, -5, 10**6],)], "ids array<int>")
    assert [r[0] for r in odd.select(bpe.decode(F.col("ids"), PATH)).collect()] == ["", "", library.decode([320], skip_special_tokens=False)]
    empty = docs.limit(0).select(bpe.digests(F.col("text"), PATH).alias("x"), bpe.encode(F.col("text"), PATH))
    assert empty.collect() == []


def test_registered_query(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op13_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
