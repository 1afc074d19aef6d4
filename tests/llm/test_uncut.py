"""Cases that bounds of earlier versions cut off, and recall of what the personal-data model adds."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packlens.llm import langid, pii, quality
from packlens.llm.topk import branch_and_bound, scaled, top_k

# ------------------------------------------------------------------ personal data

NAMED = {
    "phone_plain": ("phone ", "tel: ", "call "), "email_spelled": ("mail ", "contact: "), "iban": ("iban ", "account: "),
    "national_id": ("ssn ", "identity: "), "ip6": ("host ", "server: "), "number": ("account ", "konto: ", "passport no "),
}


def drawn(kind, rng):
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *a: a[int(rng.integers(len(a)))]
    if kind == "phone_plain":
        return pick(f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"({d(3)}) {d(3)}-{d(4)}")
    if kind == "email_spelled":
        return pick("kim.lee (at) post (dot) net", "desk[at]shop[dot]org", "rosa at mail dot com")
    if kind == "iban":
        body = d(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"
    if kind == "national_id":
        return f"{rng.integers(100, 899)}-{rng.integers(10, 99)}-{d(4)}"
    if kind == "ip6":
        return ":".join(f"{x:x}" for x in rng.integers(256, 65536, 8))
    return d(int(rng.integers(10, 18)))


@pytest.fixture(scope="module")
def trees(spark, small):
    return pii.train(spark.read.parquet(f"{small}/documents.parquet"))


@pytest.fixture(scope="module")
def held_out(spark):
    """Words of documents that no training text comes from."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id >= 500").select("text").limit(60).collect()
    return [w for r in rows for w in r["text"].split() if w.isalpha()]


@pytest.mark.parametrize("hinted", [True, False])
@pytest.mark.parametrize("kind", NAMED)
def test_recall_of_added_kinds(trees, held_out, kind, hinted):
    if kind == "number" and not hinted:
        return  # a bare number is no personal data
    rng = np.random.default_rng(len(kind) + hinted)
    found = 0
    for _ in range(200):
        at = int(rng.integers(len(held_out) - 20))
        before = " ".join(held_out[at : at + 8]) + " " + (NAMED[kind][int(rng.integers(len(NAMED[kind])))] if hinted else "")
        span = drawn(kind, rng)
        got = pii.all_spans(f"{before}{span} {' '.join(held_out[at + 8 : at + 14])}", trees)
        found += any(s <= len(before) and e >= len(before) + len(span) and k not in pii.BASE for k, s, e, *_ in got)
    assert found >= 180, (kind, hinted, found)


def test_precision_on_plain_numbers(trees, held_out):
    """Dates, versions, orders and times in running text."""
    rng = np.random.default_rng(1)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    wrong = 0
    for n in range(300):
        at = int(rng.integers(len(held_out) - 20))
        plain = [f"version {d(2)}.{d(2)}.{d(3)}", f"order {d(12)}", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"page {d(3)}", f"2024-{rng.integers(10, 13)}-{rng.integers(10, 28)} {rng.integers(10, 24)}", f"total {d(10)}"][n % 6]
        wrong += bool(pii.all_spans(f"{' '.join(held_out[at : at + 6])} {plain} {' '.join(held_out[at + 6 : at + 10])}", trees))
    assert wrong <= 30, wrong


def test_overlaps_cost_no_more_than_the_text(trees):
    part = "mail a.b@c.de or 10.0.0.1, tel 030 1234 5678, id 123-45-6789 and (555) 123-4567; "

    def spent(n):
        start = time.process_time()
        got = pii.all_spans(part * n, trees)
        return time.process_time() - start, len(got)

    spent(50)
    (small, few), (large, many) = spent(500), spent(4000)
    assert many >= 7.9 * few and large < 20 * small


def test_taken_stretches():
    rng = np.random.default_rng(2)
    for _ in range(300):
        held, own = [], pii.Taken()
        for _ in range(12):
            s = int(rng.integers(60))
            e = s + int(rng.integers(1, 12))
            assert own.meets(s, e) == any(s < b and e > a for a, b in held)
            if not own.meets(s, e):
                own.add(s, e)
                held.append((s, e))


# ------------------------------------------------------------------ languages, quality


def test_every_label_is_learned_and_marks_are_no_letters(spark):
    rows = [(i, f"word{i} " * 5, f"l{i % 90:02d}") for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.sample_windows(docs, key="doc_id", text="text", lang="lang", in_all=100)
    assert found.select("lang").distinct().count() == 90 and found.count() == 90
    net = langid.train(docs.filter("doc_id < 4"))
    signs = spark.createDataFrame([("² ½ ①",), ("Ⅷ 12",), ("ª",), ("語",)], "text string")
    got = [r["lang"] for r in signs.select(langid.identify(spark, net, F.col("text")).alias("x")).select("x.lang").collect()]
    assert got[:2] == ["und", "und"] and "und" not in got[2:]


def test_without_labels_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "1 2", None), (3, None, None), (4, "日本", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()) == [1, 4]


def test_capitals_are_capitals():
    share = lambda t: quality.Features().of(t)[2][3]
    assert share("éàü 日本") == 0 and share("ÉA b") == 0.5 and share("ABcd") == 0.5


def test_long_labelled_texts_are_sampled(spark):
    docs = spark.createDataFrame([(1, "a b c " * 60_000, 3), (2, "x y", 3), (3, "a", 3)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = quality.sample(docs, labels, key="doc_id", text="text", label="quality", meta=["n_chars"], per_label=10, counts={0: 1, 1: 1}).collect()
    assert sorted(r["k"] for r in got) == [1, 2]


# ------------------------------------------------------------------ nearest vectors


def test_large_components_take_part(spark):
    rows = [(0, [300_000.0, 0.0]), (1, [1.0, 5.0]), (2, [2.0**40, 1.0]), (3, [-(2.0**40), 2.0]), (4, [1e300, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", scaled(F.col("embedding")).alias("vector"))
    whole = {i: [int(256 * x) for x in v] for i, v in rows if i != 4}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in top_k(frame, frame, 5).collect()}
    clip = lambda n: max(-(2**63), min(2**63 - 1, n))
    assert got == {(a, b): clip(sum(x * y for x, y in zip(whole[a], whole[b], strict=True))) for a in whole for b in whole if a != b}


def test_bounds_hold_for_large_numbers():
    rng = np.random.default_rng(4)
    for trial in range(30):
        top = 2 ** int(rng.integers(10, 50))
        c = rng.integers(-top, top, (60, 24)).astype(float)
        x = rng.integers(-top, top, 24).astype(float)
        want = sorted((-max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, row, strict=True)))), i) for i, row in enumerate(c))[:5]
        assert branch_and_bound(x, np.ascontiguousarray(c.T), (c**2).sum(1), 5) == [(i, -s) for s, i in want], trial
