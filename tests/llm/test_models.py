"""Language, quality and personal-data operators: trained parts on held-out rows, rules against plain versions."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from packlens.llm import boost, langid, pii, quality
from packlens.llm.q_langid import op9_language_id
from packlens.llm.q_pii import op2_personal_data
from packlens.llm.q_quality import op5_quality

EDGE = "doc_id long, text string, lang string, source string, n_chars long, score double, k int"


def edge_docs(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "12 34 !?", "en", "a", -1), (3, "word", None, "b", 4), (3, "word", None, "b", 4), (4, "the of and " * 40_000, "en", None, 5)]
    return spark.createDataFrame([(*r, 0.5, 1) for r in rows], EDGE)


# ------------------------------------------------------------------ language


def test_tables_give_the_networks_answers():
    rng = np.random.default_rng(0)
    windows = np.concatenate([langid.windows_of("der die und das " * 12), langid.windows_of("the of and was " * 12)] * 20)
    net = langid.fit_network(windows, np.array([0, 1] * 20), ("de", "en"), epochs=2)
    x = rng.integers(0, 255, (5, langid.WINDOW + 3)).astype(np.uint8)
    seen = net.bytes_[x]
    spans = np.stack([seen[:, i : i + 4].reshape(5, -1) for i in range(langid.WINDOW)], 1)
    want = langid.softmax(np.maximum((spans @ net.filters).max(1) + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(net.probabilities(x, net.pair_tables()), want, atol=1e-3)
    assert net.probabilities(windows[:2], net.pair_tables()).argmax(1).tolist() == [0, 1]


def test_windows_cover_the_whole_text():
    text = "äbc" * 1000
    assert langid.windows_of(text)[:, : langid.WINDOW].tobytes().rstrip(b"\0") == text.encode()
    assert langid.windows_of("x").shape == (1, langid.WINDOW + 3)


def test_language_on_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    got = op9_language_id(spark, small).join(docs, "doc_id").filter("held_out and lang_pred <> 'und'").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("hit"), "score").collect()
    assert len(got) > 20 and np.mean([r["hit"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_rows(spark):
    docs = edge_docs(spark)
    net = langid.train(docs)
    assert net.languages == ("en",)
    got = docs.select("doc_id", langid.identify(spark, net, F.col("text")).alias("x")).select("doc_id", "x.*").collect()
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in got) == [(0, "und"), (1, "und"), (2, "und"), (3, "en"), (3, "en"), (4, "en")]
    assert langid.train(docs.limit(0)) is None
    assert [r["lang"] for r in docs.select(langid.identify(spark, None, F.col("text")).alias("x")).select("x.lang").collect()] == ["und"] * 6


# ------------------------------------------------------------------ quality


def test_linear_time_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    size = quality.BUCKETS + 2
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)), np.zeros(2), np.ones(2))
    ids, x, dense = np.array([3, 9, 77]), np.array([0.5, 0.1, 0.8], np.float32), np.array([[0.4, -1.0]])
    at, values = np.concatenate([ids, [quality.BUCKETS, quality.BUCKETS + 1]]), np.concatenate([x, dense[0]]).astype(float)
    z = 0.3 + m.weights[at] @ values + sum(m.factors[at[i]] @ m.factors[at[j]] * values[i] * values[j] for i in range(5) for j in range(i))
    assert np.isclose(m.scores([ids], [x], dense)[0], 1 / (1 + np.exp(-z)), atol=1e-6)


def test_quality_on_held_out_documents(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    got = op5_quality(spark, small).join(labels, "doc_id").select("held_out", "quality", "score", "predicted").collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["quality"] == r["predicted"] for r in held]) > 0.8
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_quality_edge_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (None, 1), (9, 1), (3, None), (4, 7)], "doc_id long, quality int")
    machine = quality.train(docs, labels)
    got = [r[0] for r in docs.select(quality.score(spark, machine, F.col("text"), [F.col("n_chars")])).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for s in got)
    assert quality.train(docs, labels.limit(0)) is None
    assert [r[0] for r in docs.select(quality.score(spark, None, F.col("text"))).collect()] == [0.5] * 6


# ------------------------------------------------------------------ personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_plain_patterns():
    rng = np.random.default_rng(4)
    parts = list("ab1.@-+ ()9%_é\n") + ["1.2.3.4", "4111 1111 1111 1111", "+49 (30) 123-4567", "x@y.de", "..", "@@", "256.1.1.1", "4111111111111111"]
    for _ in range(4000):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), int(rng.integers(1, 14))))
        assert pii.base_spans(text) == plain_spans(text), text


def test_hostile_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "1-" * 100_000):
        pii.base_spans(text)
        pii.candidates(text)


def test_added_spans_find_formats_and_leave_numbers(spark, small):
    model = pii.train(spark.read.parquet(f"{small}/documents.parquet"))
    found = {k for text in ("call (555) 123-4567 now", "write info (at) example (dot) org please", "iban DE89370400440532013000 is", "ssn 123-45-6789 is") for k, *_ in pii.all_spans(text, model)}
    assert {"phone_plain", "email_spelled", "iban", "national_id"} <= found
    for text in ("order 4652511922028857 was", "version 12.34.567 of", "on 2021-03-04 12", "at 12:34:56:78", "nothing here", "", None):
        assert pii.all_spans(text, model) == []
    assert pii.redacted("call (555) 123-4567 now", pii.all_spans("call (555) 123-4567 now", model)) == "call [PHONE_PLAIN] now"


def test_personal_data_query_against_plain_patterns(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in op2_personal_data(spark, small).collect():
        want = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]


def test_personal_data_edge_rows(spark):
    docs = edge_docs(spark)
    got = docs.select(pii.find(spark, pii.train(docs), F.col("text")).alias("x")).select("x.*").collect()
    assert all(r["spans"] == [] and r["redacted"] is None for r in got)
    assert isinstance(pii.train(docs.limit(0)), boost.Boosted)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = boost.fit(x, y)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.95


def test_spans_of_a_batch_leave_the_task_in_parts():
    import pandas as pd

    from packlens.llm import pii as op

    texts = pd.Series(["plain words " * 50_000] * 6 + ["write to a@b.example", None])
    parts = list(op.found_in(iter([texts]), None))  # nothing here needs the trees
    assert len(parts) > 2 and sum(map(len, parts)) == len(texts)
    assert [len(s) for p in parts for s in p["spans"]] == [0] * 6 + [1, 0]
    assert parts[-1]["redacted"].tolist()[-2:] == ["write to [EMAIL]", None]
