import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from packlens.operators import answers, ingest, pivots, retrieval

VECTORS = "chunk_id long, embedding array<float>"
QUERIES = "qid long, embedding array<float>"


def random_vectors(n, dims=8, seed=3):
    rng = random.Random(seed)
    rows = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(n)]
    # A third of all vectors are copies of one.
    return [rows[0] if i % 3 == 0 else v for i, v in enumerate(rows)]


def brute_force(queries, vectors, k):
    def unit(m):
        m = np.asarray(np.asarray(m, dtype=np.float32), dtype=np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    scores = np.round(unit(queries) @ unit(vectors).T, 10)
    out = set()
    for q, row in enumerate(scores):
        best = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        out |= {(q, i, r, round(float(row[i]), 6)) for r, i in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("way", ["broadcast", "blocks"])
def test_nearest_is_exact_with_many_ties(spark, way):
    vectors, queries = random_vectors(200), random_vectors(40, seed=4)
    v = spark.createDataFrame(list(enumerate(vectors)), VECTORS).repartition(5)
    q = spark.createDataFrame(list(enumerate(queries)), QUERIES)
    sizes = {} if way == "broadcast" else {"broadcast_bytes": 0, "block_bytes": 800}
    hits = retrieval.nearest(q, v, 4, **sizes).collect()
    assert {(h.qid, h.chunk_id, h["rank"], round(h.score, 6)) for h in hits} == brute_force(queries, vectors, 4)


def test_fewer_vectors_than_k_and_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], VECTORS)
    q = spark.createDataFrame([(7, [1.0, 0.0])], QUERIES)
    hits = {(h.chunk_id, h["rank"], h.score) for h in retrieval.nearest(q, v, 4).collect()}
    assert hits == {(1, 1, 1.0), (2, 2, 0.0)}


def test_floor_keeps_the_score_of_each_passage(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.2, 2)], "qid long, chunk_id long, score double, rank int")
    assert [(r.chunk_id, r.relevance) for r in retrieval.above_floor(hits, 0.5).collect()] == [(10, 0.9)]
    row = retrieval.candidate_scores(hits, 0.5).first()
    assert (row.scores, row.n_kept) == ([0.9, 0.2], 1)


def test_context_block_is_numbered_in_rank_order(spark):
    rows = spark.createDataFrame([(1, 2, "b.md", "two"), (1, 1, "a.md", "one")], "qid long, rank int, source string, text string")
    assert retrieval.context_block(rows).first()["context"] == "[1] (source: a.md)\none\n\n[2] (source: b.md)\ntwo"


def problems(spark, stored, chunks=((1, "a"), (2, "b"))):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], QUERIES)
    texts = spark.createDataFrame(list(chunks), "chunk_id long, text string")
    checked = retrieval.self_retrieval(texts, queries, spark.createDataFrame(stored, VECTORS))
    return {r.chunk_id: r.problem for r in checked.collect()}


def test_self_retrieval_verdicts(spark):
    assert problems(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]) == {1: None, 2: None}
    assert problems(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.1])])[2] == "weak"
    assert problems(spark, [(1, [0.3, 1.0]), (2, [0.0, 1.0])])[1] == "weak"
    assert problems(spark, [(1, [-1.0, 0.0]), (2, [0.1, 1.0])])[1] == "outranked"
    assert problems(spark, []) == {1: "retrieved nothing", 2: "retrieved nothing"}


def test_an_exact_copy_may_win(spark):
    assert problems(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0])], [(1, "a"), (2, "a")])[1] is None


def test_publishing_stops_on_a_bad_vector(spark, tmp_path):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], QUERIES)
    schema = "chunk_id long, source string, text string, embedding array<float>"
    good = spark.createDataFrame([(1, "s", "a", [1.0, 0.0]), (2, "s", "b", [0.0, 1.0])], schema)
    bad = spark.createDataFrame([(1, "s", "a", [1.0, 0.0]), (2, "s", "b", [1.0, 0.0])], schema)
    path = str(tmp_path / "index")
    assert ingest.publish_verified(spark, good, queries, path).count() == 2
    with pytest.raises(ingest.IndexProblems) as caught:
        ingest.publish_verified(spark, bad, queries, path)
    assert caught.value.total == 1 and caught.value.examples == ["2: outranked"]
    assert spark.read.parquet(caught.value.path).count() == 1
    assert ingest.published_index(spark, path).where("chunk_id = 2").first()["embedding"] == [0.0, 1.0]
    assert ingest.publish_verified(spark, good.where("chunk_id = 1"), queries, path).count() == 1
    assert ingest.published_index(spark, path).count() == 1


def test_calibration_uses_the_exclusive_quartile(spark):
    import statistics

    values = [0.31, 0.5, 0.52, 0.77, 0.9]
    rows = [(True, v) for v in values] + [(False, 0.2), (False, 0.4)]
    top1 = spark.createDataFrame(rows, "answerable boolean, relevance double")
    by_class = {r.answerable: r for r in retrieval.relevance_summary(top1).collect()}
    assert abs(by_class[True].p25 - statistics.quantiles(values, n=4)[0]) < 1e-12
    assert by_class[True].median == 0.52 and by_class[False].p25 is None
    assert abs(by_class[False]["median"] - 0.3) < 1e-12
    row = retrieval.separability(top1).first()
    assert row.separable is False
    only = retrieval.separability(top1.where("answerable")).first()
    assert only.separable is None and only.suggested_floor is None


def cited(spark, sources):
    kept = F.array(
        F.struct(F.lit("a").alias("source"), F.lit("one  two").alias("text")),
        F.struct(F.lit("b").alias("source"), F.lit("three").alias("text")),
    )
    given = F.array(*[F.lit(s) for s in sources]).cast("array<bigint>")
    row = spark.range(1).select(answers.citations(given, kept).alias("c")).first()
    return [(c.source, c.snippet) for c in row.c]


def test_citations(spark):
    assert cited(spark, [1, 99, 0]) == [("a", "one two")]
    assert cited(spark, [2, 2]) == [("b", "three")]
    assert cited(spark, []) == [("a", "one two"), ("b", "three")]
    assert cited(spark, [7]) == [("a", "one two"), ("b", "three")]


def test_all_ways_of_search_agree(spark):
    """Broadcast queries, broadcast vectors and blocks; ties, equal vectors, zero vectors, fewer vectors than k."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(90)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    queries = vectors.withColumnRenamed("chunk_id", "qid")
    few, small = queries.where("qid < 7"), vectors.where("chunk_id % 30 = 1")
    for q, v in ((queries, vectors), (few, vectors), (queries, small)):
        ways = [retrieval.nearest(q, v, 4), retrieval.nearest(q, v, 4, broadcast_bytes=-1, block_bytes=700)]
        ways += [retrieval.nearest(q, v, 4, broadcast_bytes=10**9)]
        want = sorted(map(tuple, ways[0].select("qid", "chunk_id", "score", "rank").collect()))
        for way in ways[1:]:
            assert sorted(map(tuple, way.select("qid", "chunk_id", "score", "rank").collect())) == want
        scores = {i: np.array(e) for i, e in rows}
        for qid, chunk, score, _ in want:
            a, b = scores[qid], scores[chunk]
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            assert abs(score - (a @ b / norm if norm else 0)) < 1e-9
    assert retrieval.nearest(queries.limit(0), vectors).collect() == [] == retrieval.nearest(queries, vectors.limit(0)).collect()


def by_index(q, v, k, block_bytes):
    looked = pivots.search(q, pivots.index(v, block_bytes), k).cache()
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    best = pivots.hits(looked).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return {(r.qid, r.chunk_id, r["rank"], round(r.score, 6)) for r in best.collect()}, pivots.pairs_compared(looked)


@pytest.mark.parametrize(("k", "block_bytes"), [(1, 200), (4, 200), (4, 12000), (1, 10**8)])
def test_pivot_index_is_exact_and_skips_far_groups(spark, k, block_bytes):
    """Tight clusters, one of them a third of all rows and all alike; bins smaller and larger than a group."""
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(11, 16))
    rows = [middles[0] if i % 3 == 0 else middles[i % 11] + 0.02 * rng.normal(size=16) for i in range(600)]
    asked = [middles[i % 11] + 0.02 * rng.normal(size=16) for i in range(60)]
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], VECTORS).repartition(4)
    q = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(asked)], QUERIES)
    found, compared = by_index(q, v, k, block_bytes)
    assert found == brute_force(asked, rows, k)
    assert compared < 0.3 * len(rows) * len(asked)


def test_pivot_index_of_one_vector_zero_vectors_and_nothing(spark):
    zero = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(6)], VECTORS)
    one = spark.createDataFrame([(9, [0.0, -1.0])], VECTORS)
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -2.0])], QUERIES)
    assert by_index(q, zero, 2, 16)[0] == {(i, c, c + 1, 0.0) for i in (1, 2, 3) for c in (0, 1)}
    want = {(1, 0, 1, 0.0), (1, 1, 2, 0.0), (2, 0, 1, 0.0), (2, 1, 2, 0.0), (3, 9, 1, 1.0), (3, 0, 2, 0.0)}
    assert by_index(q, zero.union(one), 2, 16)[0] == want
    assert by_index(q, one, 2, 16)[0] == {(1, 9, 1, 0.0), (2, 9, 1, -1.0), (3, 9, 1, 1.0)}
    assert by_index(q, one.limit(0), 2, 16) == (set(), 0) == by_index(q.limit(0), one, 2, 16)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_no_score_lies_above_its_bound(seed):
    rng = np.random.default_rng(seed)
    centre, query, *others = np.stack([v / np.linalg.norm(v) for v in rng.normal(size=(9, 4))])
    angles = [np.arccos(centre @ o) for o in others]
    bound = pivots.score_bound(np.array(np.arccos(centre @ query)), np.array(min(angles)), np.array(max(angles)))
    assert max(query @ o for o in others) <= bound + 1e-9


def test_block_search_holds_arrays_and_is_exact(spark):
    from packlens.functions import vectors as blocks

    rows = [(5, [1.0, 0.0]), (2, [0.0, 2.0])]
    ids, units = retrieval._matrix(spark.createDataFrame(rows, VECTORS), "chunk_id")
    assert ids.tolist() == [2, 5] and units.dtype == np.float64 and units.tolist() == [[0.0, 1.0], [1.0, 0.0]]

    # Neighbours closer than single precision can tell, many copies, and a vector that holds no number.
    rng = np.random.default_rng(4)
    base = blocks.unit(rng.normal(size=(60, 16)))
    stored = blocks.unit(np.concatenate([base, base[:1].repeat(300, 0), base + 1e-8 * rng.normal(size=base.shape), rng.normal(size=(500, 16))]))
    queries = blocks.unit(np.concatenate([base, rng.normal(size=(40, 16))]))
    exact = np.round(queries @ stored.T, blocks.SCORE_PLACES)
    spoilt = np.vstack([stored, np.full((1, 16), np.nan)])
    parts = [(np.arange(len(spoilt))[i : i + 100], spoilt[i : i + 100]) for i in range(0, len(spoilt), 100)]
    found = blocks.running_best(np.arange(len(queries)), queries, iter(parts), 4)
    for q, own in found.groupby("qid"):
        best = sorted(range(len(stored)), key=lambda i: (-exact[q, i], i))[:4]
        assert own["chunk_id"].tolist() == best
    assert len(found) == 4 * len(queries)


def test_vectors_that_find_themselves_look_into_few_groups(spark):
    """Vectors in all directions, where bands of angles alone leave out next to nothing; one holds no number."""
    rng = np.random.default_rng(7)
    rows = [[float(x) for x in r] for r in rng.normal(size=(1500, 16))]
    v = spark.createDataFrame(list(enumerate(rows)), VECTORS)
    q = v.withColumnRenamed("chunk_id", "qid")
    for more in (0, 1):
        spoilt = v.union(spark.createDataFrame([(9000, [float("nan")] * 16)], VECTORS)) if more else v
        found, compared = by_index(q, spoilt, 1, 8 * 16 * 200)
        assert found == {(i, i, 1, 1.0) for i in range(1500)}
        assert compared < 0.1 * 1500 * 1500


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_no_score_lies_above_the_bound_of_its_side(seed):
    rng = np.random.default_rng(seed)
    centres, queries, others = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.normal(size=(n, 3)) for n in (6, 20, 200)))
    bound = pivots.side_bound(queries @ centres.T, centres, np.arange(6))
    group = (others @ centres.T).argmax(axis=1)
    assert (queries @ others.T <= bound[:, group] + 1e-9).all()
