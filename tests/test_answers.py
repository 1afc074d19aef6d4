from pyspark.sql import functions as F

from packlens.operators import answers


def graded(spark, answer, *contexts):
    rows = spark.createDataFrame([(answer, list(contexts))], "a string, c array<string>")
    row = answers.with_groundedness(rows, "a", "c").first()
    return row.groundedness, row.unsupported


CONTEXT = "A pack reaches end of life at 80% state of health. Heat speeds up ageing of cells."


def test_groundedness(spark):
    assert graded(spark, "A pack reaches end of life at 80% state of health.", CONTEXT) == (1.0, [])
    half, missing = graded(spark, "Heat speeds ageing of cells. Penguins prefer colder swimming pools.", CONTEXT)
    assert half == 0.5 and missing == ["Penguins prefer colder swimming pools."]
    assert graded(spark, "A pack reaches end of life at 70% state of health.", CONTEXT)[0] == 0.0
    assert graded(spark, "Any text.") == (0.0, ["Any text."])
    assert graded(spark, "", CONTEXT) == (0.0, [])
    assert graded(spark, "It is so.", CONTEXT)[0] == 1.0
    assert graded(spark, "About 1,500 cells.", "1500 cells")[0] == 0.0


def test_uncertainty_levels(spark):
    rows = spark.createDataFrame(
        [(0.9, 0.9, 0.9), (0.5, 0.9, 0.9), (0.5, 0.5, 0.9), (0.9, None, 0.9)], "c double, r double, g double"
    )
    found = rows.withColumn("why", answers.uncertainty_reasons(F.col("c"), F.col("r"), F.col("g")))
    levels = [(r.level, r.why) for r in found.withColumn("level", answers.uncertainty_level(F.col("why"))).collect()]
    assert levels == [
        ("low", []),
        ("medium", ["low_confidence"]),
        ("high", ["low_confidence", "weak_retrieval"]),
        ("medium", ["weak_retrieval"]),
    ]


ATTEMPTS = "id long, attempt long, raw string, status_code int, error_module string"
GOOD = '{"answer": "yes", "confidence": 1.4, "sources": [1]}'


def test_output_resolution(spark):
    rows = [
        (1, 1, "not json", None, None), (1, 2, GOOD, None, None),
        (2, 1, "not json", None, None), (2, 2, '{"answer": "no confidence"}', None, None), (2, 3, GOOD, None, None),
        (3, 1, GOOD, 503, None), (3, 2, GOOD, None, None),
        (4, 1, "x", None, "builtins"), (4, 2, None, None, "httpx._exceptions"),
        (5, 1, '{"answer": "a", "confidence": 0.5}', None, None),
    ]
    found = answers.resolve_outputs(spark.createDataFrame(rows, ATTEMPTS), ["id"]).orderBy("id").collect()
    assert [(r.failure, r.attempts) for r in found] == [
        (None, 2), ("invalid_output", 2), ("provider_error", 1), ("provider_error", 2), (None, 1),
    ]
    assert found[0].answer == "yes" and found[1].answer is None and found[4].sources == []


def test_assembly_precedence(spark):
    screened = spark.createDataFrame(
        [
            (1, 1, False, "out_of_scope", "no", "q"),
            (2, 2, True, "ok", "", "q"),
            (3, 1, True, "ok", "", "q"),
            (4, 1, True, "ok", "", "q"),
            (5, 1, True, "ok", "", "q"),
            (6, 1, True, "ok", "", "q"),
            (7, 1, True, "ok", "", "q"),
        ],
        "id long, vec long, allowed boolean, reason string, message string, query string",
    )
    kept = spark.createDataFrame(
        [(1, [(1, "s.md", "Heat speeds ageing.", 0.9)])],
        "qid long, kept array<struct<rank:int,source:string,text:string,relevance:double>>",
    )
    resolved = spark.createDataFrame(
        [
            (1, "a", 0.9, [1], 1, None),
            (2, "a", 0.9, [1], 1, None),
            (3, None, None, None, 1, "provider_error"),
            (4, None, None, None, 2, "invalid_output"),
            (5, "a", 0.2, [1], 1, None),
            (6, "Heat speeds ageing.", 7.0, [9], 1, None),
        ],
        "id long, answer string, raw_confidence double, sources array<bigint>, attempts bigint, failure string",
    )
    rows = {r.id: r for r in answers.assemble(screened, kept, resolved, ["id"], "vec").collect()}
    assert [rows[i].outcome for i in range(1, 8)] == [
        "out_of_scope", "no_relevant_context", "provider_error", "invalid_output", "low_confidence", "answered",
        "provider_error",
    ]
    assert rows[1].answer == "no" and rows[1].uncertainty_level == "high" and rows[1].citations == []
    assert rows[5].confidence == 0.2 and rows[4].confidence == 0.0
    good = rows[6]
    assert (good.confidence, good.groundedness, good.uncertainty_level, good.refused) == (1.0, 1.0, "low", False)
    assert [(c.source, c.snippet) for c in good.citations] == [("s.md", "Heat speeds ageing.")]
    assert rows[3].answer.startswith("I couldn't reach") and rows[2].answer.startswith("I don't know")
