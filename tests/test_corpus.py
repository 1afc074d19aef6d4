import json

import pytest
from pyspark.sql import functions as F

from packlens.operators import chunking, evalgate, ingest
from packlens.sources import corpus, golden, sinks


def test_files_are_read_with_relative_sources(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.MD").write_text("alpha\nbeta", encoding="utf-8")
    (tmp_path / "sub dir" / "b+c.txt").write_text("gamma é", encoding="utf-8")
    (tmp_path / "blank.txt").write_text(" \n\t", encoding="utf-8")
    (tmp_path / "d.json").write_text("{}", encoding="utf-8")
    rows = {(r.source, r.text) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {("a.MD", "alpha\nbeta"), ("sub dir/b+c.txt", "gamma é")}
    one = corpus.read_corpus(spark, str(tmp_path / "a.MD")).collect()
    assert [(r.source, r.text) for r in one] == [("a.MD", "alpha\nbeta")]


@pytest.mark.parametrize("cut", [chunking.fixed_chunks, chunking.boundary_chunks])
def test_chunks_cover_the_text(spark, small, cut):
    texts = ["x" * 5000, "short", "", "word " * 900, ("line of text\n" * 30 + "\n") * 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    chunks = cut(rows, size=200, overlap=20).orderBy("id", "start_index").collect()
    assert {c.id for c in chunks} == {0, 1, 3, 4}
    for number, text in enumerate(texts):
        end = 0
        mine = [c for c in chunks if c.id == number]
        for i, c in enumerate(mine):
            assert c.chunk == text[c.start_index : c.start_index + len(c.chunk)] and len(c.chunk) <= 200
            assert c.start_index <= end and (i == 0 or end - c.start_index <= 20)
            end = c.start_index + len(c.chunk)
        assert end == len(text)


def test_boundary_chunks_prefer_paragraphs_then_lines_then_words(spark):
    texts = [("a" * 120 + "\n\n" + "b" * 20 + "\n" + "c" * 300), ("a" * 120 + "\n" + "b " * 200), "ab " * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    first = chunking.boundary_chunks(rows, size=200, overlap=20).where("start_index = 0").orderBy("id").collect()
    assert [len(c.chunk) for c in first] == [122, 121, 198]


def test_writing_with_reset_is_idempotent(spark, tmp_path):
    rows = spark.range(10).withColumn("t", F.lit("x"))
    path = str(tmp_path / "index")
    ingest.write_index(spark, rows, path)
    assert ingest.write_index(spark, rows, path).count() == 10
    assert ingest.write_index(spark, rows, path, reset=False).count() == 20
    assert sinks.replace_counted(spark, rows, path) == 10


def test_json_keeps_other_scripts(spark):
    row = sinks.as_json(spark.createDataFrame([("é漢", 1)], "a string, b int")).first()
    assert row.payload == '{"a":"é漢","b":1}'


GOLDEN = {
    "corpus": "docs",
    "items": [
        {"id": "a", "category": "factual", "answerable": True, "query": "q", "reference_answer": "r",
         "expected_chunks": [{"source": "one.md", "must_contain": ["Alpha", "beta"]}, {"source": "two.md"}]},
        {"id": "b", "category": "vague", "answerable": False, "query": "q", "reference_answer": "r", "expected_chunks": []},
        {"id": "c", "category": "factual", "answerable": True, "query": "q", "reference_answer": "r",
         "expected_chunks": [{"source": "one.md", "must_contain": ["alpha", "gone"]}]},
    ],
}


def test_golden_file_and_recall(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text(json.dumps(GOLDEN, indent=1))
    items = golden.read_golden(spark, str(path))
    expected = golden.expected_of(items)
    retrieved = spark.createDataFrame(
        [("a", "docs/one.md", "ALPHA and Beta"), ("a", "docs/three.md", "x"), ("c", "one.md", "alpha"), ("c", "one.md", "gone")],
        "id string, source string, text string",
    )
    got = {r.id: r.recall for r in evalgate.chunk_recall(items, expected, retrieved, "id").collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 0.0}


def test_trajectory_file(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"items": [{"id": "a", "query": "q", "category": "c", "expected_tools": ["x|y"]}]}))
    row = golden.read_trajectories(spark, str(path)).first()
    assert row.expected_tools == ["x|y"] and row.forbidden_tools is None


def gate_of(spark, tmp_path, payload):
    path = tmp_path / "report.json"
    if payload is not None:
        path.write_text(json.dumps(payload, indent=1))
    report = golden.read_report(spark, str(path))
    rows = evalgate.report_gate(report, golden.gates(spark)).collect()
    return {(r.metric, r.kind): r.actual for r in rows}


def test_report_gate(spark, tmp_path):
    from packlens.settings import SCORE_GATES

    passing = dict(SCORE_GATES)
    assert gate_of(spark, tmp_path, {"scores": passing}) == {}
    assert gate_of(spark, tmp_path, passing) == {}
    low = passing | {"faithfulness": 0.79}
    assert gate_of(spark, tmp_path, {"scores": low}) == {("faithfulness", "score"): 0.79}
    del low["faithfulness"]
    assert gate_of(spark, tmp_path, {"scores": low}) == {("faithfulness", "score"): 0.0}
    thin = {"scores": passing, "coverage": {"faithfulness": 3, "other": 10}, "n_answerable": 10}
    assert gate_of(spark, tmp_path, thin) == {("faithfulness", "coverage"): 0.3}
    assert gate_of(spark, tmp_path, thin | {"n_answerable": 0}) == {}


def test_a_missing_report_fails(spark, tmp_path):
    assert gate_of(spark, tmp_path, None) == {("report", "missing"): 0.0}


def records(spark, *rows):
    return spark.createDataFrame(
        list(rows), "id long, answerable boolean, refused boolean, refusal_reason string, recall double"
    )


def rolled(spark, items, judged=()):
    judged = spark.createDataFrame(list(judged), "id long, metric string, value double")
    rows = evalgate.roll_up(items, evalgate.scored_items(items, judged, ["id"])).collect()
    return {r.metric: (r.score, r.scored) for r in rows}, rows[0]


def test_roll_up_rules(spark):
    items = records(
        spark,
        (1, True, False, None, 1.0),
        (2, True, True, "low_confidence", 0.0),
        (3, False, True, "out_of_scope", 1.0),
        (4, False, True, "invalid_output", 1.0),
        (5, False, True, "provider_error", 1.0),
    )
    judged = [(1, "faithfulness", 0.8), (1, "context_recall", float("nan")), (3, "faithfulness", 1.0), (1, "other", 1.0)]
    scores, counts = rolled(spark, items, judged)
    assert scores["faithfulness"] == (0.4, 2)
    assert scores["context_recall"] == (0.0, 1)
    assert scores["retrieval_recall"] == (0.5, None)
    assert abs(scores["refusal_accuracy"][0] - 2 / 3) < 1e-12
    assert scores["output_validity"] == (0.75, None)
    assert (counts.n_items, counts.n_answerable, counts.n_provider_errors) == (5, 2, 1)


def test_roll_up_of_nothing_is_zero(spark):
    scores, counts = rolled(spark, records(spark).limit(0))
    assert {s for s, _ in scores.values()} == {0.0} and counts.n_items == 0


def test_published_scores_credit_any_refusal(spark):
    items = records(spark, (4, False, True, "invalid_output", 1.0), (1, True, False, None, 0.5))
    none = spark.createDataFrame([], "id long, metric string, value double")
    got = {(r.id, r.metric, r.value) for r in evalgate.published_scores(items, none, ["id"]).collect()}
    assert got == {(4, "refused_correctly", 1.0), (1, "retrieval_recall", 0.5)}


def test_rotten_truth(spark):
    rows = [(1, "a", ["X"]), (2, "a", ["x", "z"]), (3, "gone", ["x"]), (4, "a", []), (5, "a", ["x", "Y"]), (6, "a", None), (7, "a", [""])]
    expected = spark.createDataFrame(rows, "id long, source string, must_contain array<string>")
    texts = spark.createDataFrame([("a", "Xy")], "source string, text string")
    got = {r.id: r.problem for r in evalgate.rotten_truth(expected, texts).collect()}
    none = "no text required"
    assert got == {2: "text not found", 3: "unknown source", 4: none, 6: none, 7: none}


def test_chunking_takes_linear_time(spark):
    import time

    from packlens.operators import chunking

    def seconds(n, cut):
        rows = spark.createDataFrame([("wörd é. " * (n // 8),)], "text string")
        cut(rows).count()
        start = time.time()
        assert cut(rows).agg({"chunk": "max"}).first()[0]
        return time.time() - start

    for cut in (chunking.fixed_chunks, chunking.boundary_chunks):
        seconds(1000, cut)
        assert seconds(1_600_000, cut) < 8 * seconds(400_000, cut) + 2


def test_recursive_chunks_cover_every_text():
    import random

    from packlens.operators.chunking import recursive_spans

    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "bb", "ccc", " ", "\n", "\n\n", "  "]) for _ in range(rng.randint(0, 80)))
        size = rng.randint(2, 30)
        spans = list(recursive_spans(text, size, rng.randint(0, size - 1)))
        assert all(0 < e - s <= size and text[s:e] == text[s:e].strip() for s, e in spans)
        assert {i for i, c in enumerate(text) if not c.isspace()} <= {i for s, e in spans for i in range(s, e)}
        assert all(a[1] < b[1] for a, b in zip(spans, spans[1:]))
    text = "para one here.\n\npara two is a bit longer than that\nline"
    assert [text[s:e] for s, e in recursive_spans(text, 20, 6)] == ["para one here.", "para two is a bit", "a bit longer than", "than that", "line"]


def test_chunks_of_a_batch_leave_the_task_in_parts():
    import pandas as pd

    from packlens.functions.text import HELD_CHARS, few_at_once
    from packlens.operators import chunking

    texts = pd.Series(["word " * 40_000] * 20 + ["a"])
    parts = list(chunking.cut_batches(iter([texts, texts.iloc[:0]]), lambda t: chunking.recursive_spans(t, 1000, 100)))
    assert len(parts) > 2 and max(sum(len(c["chunk"]) for row in p for c in row) for p in parts) < 2 * HELD_CHARS
    assert [len(row) for p in parts for row in p] == [len(list(chunking.recursive_spans(t, 1000, 100))) for t in texts]
    assert [p.tolist() for p in few_at_once(pd.Series(["abc", None, "d", "efghij"]), 4)] == [["abc", None, "d"], ["efghij"]]


def test_index_rows_hold_their_chunk_alone(spark, tmp_path, monkeypatch):
    from packlens.operators import ingest
    from packlens.plans import corpus as plans

    spark.createDataFrame([(1, "word " * 1000, "en", "web", 5000)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen, write = [], ingest.write_index
    monkeypatch.setattr(ingest, "write_index", lambda spark, chunks, *a, **b: seen.append(chunks.columns) or write(spark, chunks, *a, **b))
    plans.ingest_idempotent(spark, str(tmp_path)).collect()
    assert len(seen) == 4 and all("chunk" in c and "text" not in c for c in seen)
