"""Source mix and the corpus pipeline."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from packlens.llm.mixing import largest_flow, mix, water_targets, word_count
from packlens.llm.q_mixing import op6_source_mix
from packlens.session import staging_path


def targets_by_hand(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def test_targets_by_hand(spark):
    for sizes in ({"b": 100, "a": 10, None: 50, "c": 900, "é": 0}, {"x": 7}, {f"s{i:02}": i * i for i in range(40)}, {}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in water_targets(frame).collect()}
        want = targets_by_hand(sizes)
        assert got.keys() == want.keys() and all(np.isclose(got[s], want[s]) for s in want)


def test_flow_is_largest_and_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(1, 4))
        patterns = [(sorted(rng.choice(n, int(rng.integers(1, n + 1)), replace=False).tolist()), int(rng.integers(1, 4))) for _ in range(3)]
        quotas = rng.integers(0, 6, n).tolist()
        drawn = largest_flow(patterns, quotas)

        def fits(amounts, patterns=patterns, quotas=quotas):
            """Hall's condition on every set of sources."""
            return all(
                sum(a for a, (s, _) in zip(amounts, patterns, strict=True) if set(s) <= set(k)) <= sum(quotas[i] for i in k)
                for r in range(len(quotas) + 1) for k in itertools.combinations(range(len(quotas)), r)
            )

        possible = [a for a in itertools.product(*[range(2 * s + 1) for _, s in patterns]) if fits(a)]
        cost = lambda a: sum(x + max(0, x - s) for x, (_, s) in zip(a, patterns, strict=True))
        most = max(map(sum, possible))
        assert fits(drawn) and sum(drawn) == most
        assert cost(drawn) == min(cost(a) for a in possible if sum(a) == most)


def test_mix_meets_targets_with_overlap(spark):
    rng = np.random.default_rng(2)
    names = [["a"], ["b"], ["a", "b"], ["c"], [None], ["c", None]]
    rows = [(i, names[i % 6], int(rng.integers(0, 30)), "x") for i in range(900)] + [(None, ["a"], 5, "x"), (1, ["b"], 9, "x"), (2000, [], 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long, words string")
    targets = spark.createDataFrame([("a", 3000.0), ("b", 2500.0), ("c", 100.0), (None, 1500.0)], "source string, target double")
    got = mix(docs, targets).collect()
    again = mix(docs.repartition(7), targets).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["copies"])
    assert len(got) == len(rows) and sorted(map(key, got)) == sorted(map(key, again))
    assert all(0 <= r["copies"] <= 2 for r in got) and not [r for r in got if r["doc_id"] == 2000 and r["copies"]]
    assert abs(sum(r["copies"] * r["size"] for r in got) - 7100) < 10
    assert mix(docs.limit(0), targets).collect() == []


def test_many_patterns_meet_all_targets(spark):
    names = [["a", "b"], ["a", "c"], ["b", "c"], ["a"], ["b"], ["c"]]
    docs = spark.createDataFrame([(i, names[i % 6], 10 + i % 3) for i in range(600)], "doc_id long, sources array<string>, size long")
    targets = spark.createDataFrame([("a", 2000.0), ("b", 3000.0), ("c", 1000.0)], "source string, target double")
    got = mix(docs, targets).collect()
    assert len(got) == 600 and abs(sum(r["copies"] * r["size"] for r in got) - 6000) < 20
    assert sorted(map(tuple, (r["sources"] for r in got))) == sorted(map(tuple, (names[i % 6] for i in range(600))))


def best_flow(patterns, quotas):
    """(words, cost) of the largest and then cheapest amounts of ``patterns`` (sources, words), by trying all amounts."""
    found, names = (0, 0), {q for s, _ in patterns for q in s}
    for amounts in itertools.product(*[range(2 * w + 1) for _, w in patterns]):
        fits = all(
            sum(a for a, (s, _) in zip(amounts, patterns, strict=True) if set(s) <= set(k)) <= sum(quotas.get(q, 0) for q in k)
            for r in range(len(names) + 1) for k in itertools.combinations(names, r)
        )
        if fits:
            found = min(found, (-sum(amounts), sum(a + max(0, a - w) for a, (_, w) in zip(amounts, patterns, strict=True))))
    return found


def test_mix_of_components_is_the_best_flow(spark):
    """Each component of sources against all amounts: documents of one word, so that a flow is met exactly."""
    groups = [
        ([(["a", "b"], 3), (["b"], 2), (["a"], 1)], {"a": 5, "b": 4}),
        ([(["c", None], 2), ([None], 3), (["c"], 2)], {"c": 3, None: 9}),
        ([(["d", "e"], 2), (["e", "f"], 2), (["f"], 1)], {"d": 1, "e": 2, "f": 4}),
        ([(["g"], 4)], {"g": 5}),
        ([(["h", "no target"], 2)], {"h": 3}),
        ([(["no target either"], 2)], {}),
    ]
    rows, n = [], 0
    for patterns, _ in groups:
        for sources, words in patterns:
            for _ in range(words):
                rows.append((n, sources if n % 2 else sources[::-1] + sources[:1], 1))
                n += 1
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    targets = spark.createDataFrame([(s, float(q)) for _, quotas in groups for s, q in quotas.items()], "source string, target double")
    copies = {r["doc_id"]: r["copies"] for r in mix(docs, targets).collect()}
    at = 0
    for patterns, quotas in groups:
        amounts = []
        for _, words in patterns:
            amounts.append(sum(copies[at + i] for i in range(words)))
            at += words
        want = best_flow(patterns, quotas)
        assert (-sum(amounts), sum(a + max(0, a - w) for a, (_, w) in zip(amounts, patterns, strict=True))) == want


def test_mix_query(spark, small):
    got = op6_source_mix(spark, small).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    want = targets_by_hand(sizes)
    assert all(np.isclose(target[s], want[s]) for s in want)
    largest = {s: max(r["size"] for r in got if source[r["doc_id"]] == s) for s in want}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in want)
    assert all(r["source_size"] == sizes[source[r["doc_id"]]] for r in got)


def test_word_count(spark):
    rows = [("a\tb  c\x0bd e",), (None,), ("",), (" \n",), ("é",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(word_count(F.col("t"))).collect()] == [4, 0, 0, 0, 1]


def test_pipeline_stages_take_effect(spark, small):
    """Each stage against a plain version of its rule, on its own input."""
    from test_pairs import components_by_hand, shingles

    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r["item_id"], shingles(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = staging_path(spark, name)
        stage(spark, docs, small).write.parquet(path)
        out = spark.read.parquet(path)
        before = {r["doc_id"]: r for r in docs.collect()}
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert out.dtypes == docs.dtypes
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        elif name == "near_dedup":
            want = components_by_hand({i: shingles(r["text"]) for i, r in before.items()}, 80)
            assert set(after) == {i for i in want if want[i] == i}
        elif name == "decontamination":
            leaked = {i for i, r in before.items() if any(s and 100 * len(s & shingles(r["text"])) >= 80 * len(s) for _, s in items)}
            assert set(after) == set(before) - leaked
        elif name == "personal_data":
            from test_models import plain_spans

            assert set(after) == set(before)
            for i, r in after.items():
                assert not plain_spans(r["text"])
                assert plain_spans(before[i]["text"]) or r == before[i]
        else:
            assert all(r["copies"] in (1, 2) for r in after.values())
        docs = out


def test_pipeline_of_edge_rows(spark):
    """Nulls, empty texts, repeated rows and further columns pass through every stage."""
    rows = [(None, "the of and was", "en", "s", 14), (1, None, "en", None, None), (2, "", None, "s", 0), (3, "the of and was in it", "en", "s", 20), (3, "the of and was in it", "en", "s", 20), (4, "der die und das", "de", None, 15)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string, size int")
    sf_dir = staging_path(spark, "sf")
    spark.createDataFrame([(1, "nothing of the kind is here")], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    for rows_now in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            path = staging_path(spark, name)
            stage(spark, rows_now, sf_dir).write.parquet(path)
            rows_now = spark.read.parquet(path)
            if name == "near_dedup":
                assert rows_now.filter("doc_id = 3").count() <= 1
