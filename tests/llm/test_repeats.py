"""Repeated passages against a search of every run of sentences, with a splitter of its own."""

from __future__ import annotations

import re

import numpy as np
import pytest

from packlens.llm import repeats


def split(text):
    """Sentences as lists of words, by reading word for word."""
    out, now = [], []
    for word, gap in re.findall(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", text or ""):
        now.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word))
        if word[-1] in ".!?" or "\n" in gap:
            out.append(tuple(now))
            now = []
    return [*out, tuple(now)] if now else out


def by_hand(docs):
    """Covered sentences per row: every run of two or more sentences and twenty or more words, non-first occurrences."""
    places = {}
    for k, t in docs:
        if k is None:
            continue
        own = split(t)
        for i in range(len(own)):
            for j in range(i + 2, len(own) + 1):
                if sum(map(len, own[i:j])) >= 20:
                    places.setdefault(tuple(own[i:j]), set()).add((k, i, j))
    gone = {}
    for found in places.values():
        for k, i, j in found - {min(found)}:
            gone.setdefault(k, set()).update(range(i, j))
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_every_run_of_sentences(spark, seed):
    rng = np.random.default_rng(seed)
    ends = [". ", "! ", "?  ", "\n", ".\n", " .. "]
    say = lambda: " ".join(["Wörter", "so", "w日", "x"][rng.integers(4)] + str(rng.integers(40)) for _ in range(int(rng.integers(1, 12)))) + ends[rng.integers(6)]
    pool = [say() for _ in range(60)]
    docs = []
    for k in range(40):
        at = int(rng.integers(40))
        body = [say() for _ in range(int(rng.integers(0, 6)))] + pool[at : at + int(rng.integers(0, 14))] + [say() for _ in range(int(rng.integers(0, 4)))]
        if k % 7 == 0:
            body += body[:8]
        docs.append((k * 3 % 41, ("" if k % 5 else "\n ") + "".join(body).rstrip(" " if k % 3 else "")))
    docs += [(200, None), (201, ""), (202, " \n"), (203, "One. Two."), (None, docs[0][1]), (None, None)]
    want = by_hand(docs)
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, h int, ends string").repartition(3)
    got = repeats.without_repeats(frame).collect()
    assert len(got) == len(docs) and sum(map(len, want.values())) > 40
    texts = {}
    for k, t in docs:
        texts.setdefault(k, []).append(t)
    for r in got:
        gone = want.get(r["doc_id"], set())
        assert r["n_removed"] == len(gone)
        if not gone:
            assert r["text"] in texts[r["doc_id"]]
        else:
            (whole,) = texts[r["doc_id"]]
            assert split(r["text"]) == [s for i, s in enumerate(split(whole)) if i not in gone]
            assert r["n_sentences"] == len(split(whole))


def test_batches_do_not_matter(monkeypatch):
    """Sentences and runs of many texts at once are those of each text alone."""
    rng = np.random.default_rng(4)
    texts = ["".join(f"w{rng.integers(30)}" + [" ", " ", ". ", "\n", "  "][rng.integers(5)] for _ in range(int(rng.integers(0, 150)))) for _ in range(40)]
    texts += ["", " ", "größe " * 60, "a" * 5000, "no end at all " * 30]
    whole = repeats.cut([t.encode() for t in texts])
    first, n, hashed = repeats.runs_of(whole)
    start = np.searchsorted(whole.text, np.arange(len(texts)))
    for i, t in enumerate(texts):
        alone = repeats.cut([t.encode()])
        mine = whole.text == i
        assert whole.stop[mine].tolist() == alone.stop.tolist() and whole.ends[mine].tolist() == alone.ends.tolist()
        f, k, h = repeats.runs_of(alone)
        of = whole.text[first] == i
        assert (first[of] - start[i]).tolist() == f.tolist() and n[of].tolist() == k.tolist() and hashed[of].tolist() == h.tolist()
        assert max(np.diff(alone.bounds), default=0) <= repeats.LONGEST or not t


def test_rows_of_one_key_are_one_place(spark):
    passage = " ".join(f"p{i}" + (". " if i % 6 == 5 else "") for i in range(36))
    rows = [(1, passage), (1, passage), (1, "Before it. " + passage), (2, passage + "Own end.")]
    got = sorted((r["doc_id"], r["text"]) for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([*rows[:3], (2, "Own end.")])
