"""Near copies, leaks, repeats, nearest vectors: against brute force on small fixtures."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.llm.common import words_of
from packlens.llm.decontaminate import leaks
from packlens.llm.graph import components
from packlens.llm.neardup import linked_sets, near_groups
from packlens.llm.q_decontaminate import OP4, op4_decontamination
from packlens.llm.q_topk import OP3, op3_top_k
from packlens.llm.repeats import runs, sentences, without_repeats
from packlens.llm.topk import branch_and_bound, scaled, top_k


def shingles(text):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def family_texts():
    """Copies, near copies by edits, a chain of them, and strangers that share a passage."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for n in range(60):
        t = list(base)
        for _ in range(n % 5):
            t[int(rng.integers(120))] = f"x{n}"
        texts.append(" ".join(t))
    chain = [f"c{i}" for i in range(100)]
    for n in range(12):
        chain[8 * n] = f"new{n}"
        texts.append(" ".join(chain))
    texts += [" ".join([f"s{n}_{i}" for i in range(60)] + base[:20]) for n in range(20)]
    return texts + texts[:10] + ["one two", "One  TWO", "one", "", None, " x y z", "a b c d e", "A B C D E"]


def components_by_hand(sets, percent=85):
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and sets[j]:
            a, b = root(i), root(j)
            top[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_groups_are_those_of_all_pairs(spark):
    texts = family_texts()
    rows = [(i * 7 % 1009, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[0], 1, "x"), (None, None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component int, digest string")
    got = near_groups(docs).collect()
    assert len(got) == len(rows)
    want = components_by_hand({r[0]: shingles(r[1]) for r in rows if r[0] is not None})
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is False
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
            assert r["n_shingles"] == len(shingles(dict((a, b) for a, b, *_ in rows)[r["doc_id"]]))


@pytest.mark.parametrize("percent", [60, 80])
def test_groups_at_lower_thresholds(spark, percent):
    """Pairs of one text and a copy with more or fewer words changed, each pair alone."""
    texts = []
    for n in range(40):
        t = [f"p{n}_{i}" for i in range(200)]
        texts.append(" ".join(t))
        for k in range(n % 20):
            t[6 * k] = "new"
        texts.append(" ".join(t))
    got = {r["doc_id"]: r["component_id"] for r in near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=percent).collect()}
    sets = [shingles(t) for t in texts]
    linked = [100 * len(sets[i] & sets[i + 1]) >= percent * len(sets[i] | sets[i + 1]) for i in range(0, 80, 2)]
    assert got == {j: i if linked[i // 2] else j for i in range(0, 80, 2) for j in (i, i + 1)} and 0 < sum(linked) < 40


def test_groups_of_repeated_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_groups(docs).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert near_groups(docs.limit(0)).collect() == []


def test_products_count_common_members():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    for i, js in linked_sets(sets, 50):
        want = [j for j in range(i + 1, 30) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))]
        assert js.tolist() == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[301] == 300 and 200 not in got


# ------------------------------------------------------------------ leaks


def test_leaks_against_sets(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(40)}"
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 30))))) for i in range(25)] + [(90, None), (91, ""), (None, "w1 w2 w3 w4 w5"), (92, "w1 w2"), (93, "w1 w2")]
    docs = []
    for i in range(60):
        body = [word() for _ in range(int(rng.integers(0, 60)))]
        if i % 3 == 0:
            piece = (items[i % 25][1]).upper().split()
            if len(piece) > 12:
                piece[int(rng.integers(len(piece)))] = "changed"
            body[5:5] = piece
        docs.append((i, "  ".join(body)))
    docs += [(200, None), (201, "w1 w2"), (None, items[3][1])]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i, len(shingles(b)), len(shingles(a) & shingles(b))) for d, a in docs for i, b in items if d is not None and i is not None and shingles(b) and 100 * len(shingles(a) & shingles(b)) >= 80 * len(shingles(b))}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert leaks(docs.limit(0), items).collect() == [] and leaks(docs, items.limit(0)).collect() == []


def test_leak_search_runs_without_python(spark, small):
    plan = op4_decontamination(spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize(("query", "sql"), [(op4_decontamination, OP4), (op3_top_k, OP3)])
def test_queries_against_sql(spark, small, query, sql):
    from compare import check, connect

    ok, message, *_ = check(spark, connect(small), small, query, sql)
    assert ok, message


# ------------------------------------------------------------------ repeats


def test_sentences_are_the_text():
    for text in ("", "A b. C d! E\nf  g...  ", "no end", "...", " lead. x", "\n\n", "3.14 is. Ok?", "w " * 100, "äö. ü"):
        assert "".join(sentences(text)) == text
    assert max(len(s.split()) for s in sentences("w " * 100)) == 24


def test_repeats_against_plain_search(spark):
    rng = np.random.default_rng(8)
    say = lambda: " ".join(f"w{rng.integers(500)}" for _ in range(int(rng.integers(2, 14)))) + ". "
    shared = ["".join(say() for _ in range(6)) for _ in range(4)]
    docs = [(i, "".join(say() for _ in range(5)) + shared[i % 4].upper() + "".join(say() for _ in range(3)) + (shared[0] if i % 5 == 0 else "")) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "Short."), (None, docs[0][1])]
    occurrences = {}
    for i, t in docs:
        if i is None:
            continue
        first, n, hashed = runs(sentences(t))
        words = [tuple(p.lower().split()) for p in sentences(t)]
        for f, k, h in zip(first, n, hashed, strict=True):
            occurrences.setdefault(tuple(itertools.chain(*words[f : f + k], [k])), []).append((i, int(f), int(k)))
    gone = {}
    for places in occurrences.values():
        for i, f, k in places:
            if (i, f) != min(places)[:2]:
                gone.setdefault(i, set()).update(range(f, f + k))
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, h string, first int")
    got = without_repeats(frame).collect()
    assert len(got) == len(docs)
    for r in got:
        pieces = sentences(dict(docs)[r["doc_id"]])
        assert r["n_removed"] == len(gone.get(r["doc_id"], ()))
        assert r["text"] == (dict(docs)[r["doc_id"]] and "".join(p for k, p in enumerate(pieces) if k not in gone.get(r["doc_id"], ())))
    assert sum(map(len, gone.values())) > 50
    assert without_repeats(frame.limit(0)).collect() == []


def test_runs_cover_a_passage_to_its_last_sentence():
    passage = ["one two three four five six seven. "] * 3 + ["tail. "]
    first, n, _ = runs(passage)
    assert {*range(4)} == {i for f, k in zip(first, n, strict=True) for i in range(f, f + k)}


def test_passages_in_mid_sentence_and_without_punctuation(spark):
    rng = np.random.default_rng(12)
    say = lambda n: [f"w{rng.integers(3000)}" for _ in range(n)]
    docs, passages = [], []
    for n in range(30):
        passage = say(60)
        if n % 3 == 0:  # two inner sentence ends; the passage starts and ends in mid-sentence
            passage[25] += "."
            passage[38] += "."
        elif n % 3 == 1:  # one inner sentence end
            passage[30] += "."
        passages.append(passage)
        docs += [(2 * n + k, " ".join(say(30 + 7 * k + n) + passage + say(40 - k))) for k in (0, 1)]
    got = {r["doc_id"]: r["text"].split() for r in without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for n, passage in enumerate(passages):
        own = docs[2 * n + 1][1].split()
        assert got[2 * n] == docs[2 * n][1].split()
        left = got[2 * n + 1]
        assert [w for w in left if w not in passage] == [w for w in own if w not in passage]
        assert len(own) - len(left) >= 25, n


def test_one_short_sentence_is_no_passage(spark):
    shared = " ".join(f"s{i}" for i in range(22)) + ". "
    docs = [(k, f"first {k} words here. {shared}last words {k} there.") for k in range(3)]
    got = without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == docs


# ------------------------------------------------------------------ nearest vectors


def test_branch_and_bound_is_exact():
    rng = np.random.default_rng(9)
    for trial in range(40):
        c = rng.integers(-5, 6, (int(rng.integers(1, 80)), 24)).astype(float) * (1 if trial % 2 else 4000)
        x = rng.integers(-5, 6, 24).astype(float)
        skip = int(rng.integers(len(c))) if trial % 3 == 0 else -1
        score = (c.astype(np.int64) @ x.astype(np.int64)).tolist()
        want = sorted((-s, i) for i, s in enumerate(score) if i != skip)[:5]
        assert branch_and_bound(x, np.ascontiguousarray(c.T), (c**2).sum(1), 5, skip) == [(i, -s) for s, i in want]


def test_top_k_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (100, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", scaled(F.col("embedding")).alias("vector"))
    got = sorted(tuple(r) for r in top_k(frame, frame.filter("vec_id % 50 = 0"), 3).collect())
    one = 256 * 256
    assert got == [(0, 1, 1, one), (0, 2, 2, one), (0, 3, 50, one // 2), (50, 1, 0, one // 2), (50, 2, 1, one // 2), (50, 3, 2, one // 2)]
    assert top_k(frame.limit(0), frame.limit(0)).collect() == []
