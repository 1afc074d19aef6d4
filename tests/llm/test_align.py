"""Tokenizer alignment against a plain version on the libraries' own output."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from packlens.llm import align
from packlens.llm.q_align import BYTE_LEVEL, PIECES, op12_tokenizer_links

A, B = public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)


def by_hand(texts):
    """Facts per text, from the json file, the model, and dictionaries."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter, free = {}, 256
    for b in range(256):
        letter[chr(b) if b in prints else chr(free)] = b
        free += b not in prints
    rows, counts = [], Counter()
    for text in texts:
        groups = []
        if text:
            ids_a = first.encode(" " + text, add_special_tokens=False).ids
            ids_b = second.encode(text)
            own_a = [bytes(letter[c] for c in first.id_to_token(i)) for i in ids_a]
            names = [second.id_to_piece(i) for i in ids_b]
            own_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, names, strict=True)]
            if b"".join(own_a) == b"".join(own_b) == (" " + text).encode():
                i = j = size_a = size_b = 0
                group = ([], [])
                while i < len(ids_a) or j < len(ids_b):
                    if size_a <= size_b and i < len(ids_a):
                        group[0].append(ids_a[i])
                        size_a += len(own_a[i])
                        i += 1
                    else:
                        group[1].append(ids_b[j])
                        size_b += len(own_b[j])
                        j += 1
                    if size_a == size_b:
                        groups.append(group)
                        group = ([], [])
        links = [(g[0][-1], g[1][-1]) for g in groups]
        counts.update(links)
        rows.append((groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sums = (len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links))
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), *sums, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, counts, rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def odd_texts():
    rng = random.Random(3)
    words = ["the", "house", "größe", "naïve", "日本語", "🙂", "  ", "\n", "<s>", "<|endoftext|>", "<0x41>", "12345", "don't", "\t", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    return [*texts, texts[0], texts[0], None, "", " ", "▁", "a▁b", "x" * 3000, " " * 500, " " * 1999, "a" + " " * 300_000 + "b", "the " * 4000, "\x00\x01", "﻿start"]


@pytest.mark.parametrize("sizes", [(16_384, 1_500_000), (48, 500)])
def test_documents_and_pairs_against_plain_counts(spark, monkeypatch, sizes):
    for name, n in zip(("SLOTS", "BLOCK_POSTINGS"), sizes, strict=True):
        monkeypatch.setattr(align, name, n)  # they travel to the workers with the job's functions
    texts = odd_texts()
    rows = [(None if i == 5 else i // 2, t, "kept", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pair int").repartition(3)
    want, counts, linked = by_hand(texts)
    parts = align.linked(docs, A, B)
    scores = align.pair_scores(parts)
    got = sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS]) for r in align.document_scores(parts, scores).collect())
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))
    in_docs = Counter(x for _, links in linked for x in set(links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"], r["best"]) for r in scores.collect()} == {x: (in_docs[x], n, n == most[x[1]]) for x, n in counts.items()}


def test_bitmaps_give_back_what_was_put_in():
    rng = np.random.default_rng(1)
    code = rng.choice(50 * 16_384, 4000, replace=False)
    pair, slot, times = code // 16_384, code % 16_384, rng.integers(1, 3000, 4000)
    parts = [align.planes(pair[i::3], slot[i::3], times[i::3]) for i in range(3)]
    own, docs, links, entries, offsets = align._bitmaps(parts)
    assert own.tolist() == sorted(set(pair.tolist()))
    found = np.zeros((50, 16_384), np.int64)
    row = np.repeat(own, np.diff(offsets))
    for at, place, weight in align.posted(entries):
        np.add.at(found, (row[at], place), weight)
    want = np.zeros((50, 16_384), np.int64)
    want[pair, slot] = times
    assert (found == want).all()
    assert docs.tolist() == (want > 0).sum(axis=1)[own].tolist() and links.tolist() == want.sum(axis=1)[own].tolist()


def test_empty_tables_and_texts_without_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    parts = align.linked(docs, A, B)
    assert sorted(tuple(r) for r in align.document_scores(parts, align.pair_scores(parts)).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    parts = align.linked(docs.limit(0), A, B)
    assert align.pair_scores(parts).collect() == [] == align.document_scores(parts, align.pair_scores(parts)).collect()


def test_registered_query(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    want, *_ = by_hand([r["text"] for r in rows])
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op12_tokenizer_links(spark, small).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}
