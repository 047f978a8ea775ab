"""Search, roll-up, cuts and fusion: worked cases, brute force, order independence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import fusion, retrieval, vectors

# Published similarity lists of adaptive runs, already cut; the rule gives the
# same size again.
GOLDEN = [
    [0.6591, 0.5928, 0.5692, 0.47, 0.4537, 0.4449, 0.4371, 0.4352],
    [0.5692, 0.527, 0.4626, 0.4537, 0.4371, 0.4352, 0.4233],
    [0.6506, 0.635, 0.6277, 0.6195, 0.6108, 0.603, 0.5953, 0.594, 0.5892, 0.5866, 0.5855, 0.5844, 0.5797, 0.5787,
     0.5713, 0.5709, 0.5694, 0.5692, 0.5684],
    [0.6506, 0.635, 0.6277, 0.6195, 0.6108, 0.603, 0.594, 0.5892, 0.5866, 0.5855, 0.5797, 0.5787, 0.5713, 0.5709,
     0.5694, 0.5692, 0.5681],
    [0.6617, 0.613, 0.6055, 0.5898, 0.578, 0.5767, 0.5681, 0.5653, 0.5647],
    [0.6055, 0.5898, 0.5767, 0.5653, 0.5646, 0.5558, 0.555],
    [0.658, 0.6399, 0.6296, 0.6231, 0.6229, 0.6194, 0.6134, 0.6052, 0.596, 0.5875, 0.5867, 0.5813, 0.5813, 0.5813],
    [0.6399, 0.6296, 0.6231, 0.6229, 0.6194, 0.6134, 0.6052, 0.596, 0.5875, 0.5867, 0.5813, 0.5813, 0.5813],
]
CASES = [
    ([0.9], 0, 1),
    ([0.7, 0.65, 0.2], 2, 3),
    ([0.59, 0.58, 0.40, 0.39, 0.38, 0.37, 0.36, 0.35, 0.34], 2, 7),
    ([0.25] * 8, 0, 5),
    ([0.5] * 30, 0, 5),
    ([0.9] * 30, 29, 20),
]


def lists(spark, score_lists):
    rows = [(q, s, float(x)) for q, xs in enumerate(score_lists) for s, x in enumerate(xs)]
    return spark.createDataFrame(rows, "query_id long, source_id long, score double")


def fold(scores, k):
    """The cut as one pass over a ranked list."""
    best, optimal = 0, 0
    for i in range(len(scores) - 1):
        if scores[i] >= 0.6:
            optimal = i + 1
        elif scores[i] < 0.3:
            break
        elif round(scores[i] - scores[i + 1], 6) > best:
            best, optimal = round(scores[i] - scores[i + 1], 6), i + 1
    return optimal, min(optimal + 5, k, len(scores))


def test_adaptive_cases(spark):
    found = retrieval.adaptive_k(lists(spark, [c[0] for c in CASES]), 20)
    got = {r.query_id: (r.o, r.n) for r in found.groupBy("query_id").agg(F.max("optimal_k").alias("o"), F.count("*").alias("n")).collect()}
    assert got == {q: (optimal, kept) for q, (_, optimal, kept) in enumerate(CASES)}


def test_adaptive_keeps_published_lists_whole(spark):
    found = retrieval.adaptive_k(lists(spark, GOLDEN), 20).groupBy("query_id").agg(F.max("optimal_k").alias("o"), F.count("*").alias("n"))
    assert {r.query_id: (r.o + 5, r.n) for r in found.collect()} == {q: (len(x), len(x)) for q, x in enumerate(GOLDEN)}


def test_adaptive_equals_fold_on_random_lists(spark):
    rng = random.Random(7)
    many = [sorted((round(rng.random(), rng.choice([1, 2, 6])) for _ in range(rng.randint(1, 40))), reverse=True) for _ in range(300)]
    found = retrieval.adaptive_k(lists(spark, many), 20)
    got = {r.query_id: (r.o, r.n) for r in found.groupBy("query_id").agg(F.max("optimal_k").alias("o"), F.count("*").alias("n")).collect()}
    assert got == {q: fold(s, 20) for q, s in enumerate(many)}


def test_rollup_clamps_and_drops_unknown_chunks(spark):
    hits = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.4), (0, 3, -0.2), (0, 99, 0.8)], "query_id long, chunk_id long, score double")
    chunks = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "chunk_id long, source_id string")
    got = {r.source_id: (r.chunk_ids, r.score) for r in retrieval.rollup(retrieval.attach_sources(hits, chunks)).collect()}
    assert got == {"A": ([1, 2], 0.9), "B": ([3], 0.0)}


def ranked(spark, ranking):
    rows = [("r", q, s, i, 1.0 / i, [q]) for q, names in enumerate(ranking) for i, s in enumerate(names, 1)]
    return spark.createDataFrame(rows, "request_id string, query_no int, source_id string, rank int, score double, chunk_ids array<int>")


def test_rrf(spark):
    got = fusion.rrf(ranked(spark, ["ABC", "BD"]), 10).orderBy("position").collect()
    assert [r.source_id for r in got] == ["B", "A", "D", "C"]
    assert [r.rrf_score for r in got] == [0.0325224749, 0.0163934426, 0.0161290323, 0.0158730159]
    assert got[0].chunk_ids == [0]


def test_single_query_is_not_fused(spark):
    requests = spark.createDataFrame([("r", 0)], "request_id string, query_no int")
    got = fusion.route(ranked(spark, ["CAB"]), requests, 2).orderBy("position").collect()
    assert [(r.source_id, r.rrf_score) for r in got] == [("C", None), ("A", None)]


@pytest.mark.parametrize("shipped", [None, 20])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_knn_equals_brute_force_with_ties_and_gaps(spark, shipped, ids):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 6)).round(1)
    base[130:270] = base[0]  # a third of all vectors are copies
    base[7] = 0
    name = (lambda i: int(i)) if ids == "long" else (lambda i: f"c{i:04d}")
    vecs = spark.createDataFrame([(name(i), v.tolist()) for i, v in enumerate(base)] + [(name(999), None)], f"chunk_id {ids}, embedding array<float>")
    asked = spark.createDataFrame([(name(i), base[i].tolist()) for i in range(0, 400, 9)], f"query_id {ids}, embedding array<float>")
    got = vectors.knn(asked, vecs.repartition(5), 20, max_shipped=shipped, sampled_from=0 if shipped else 99)
    unit = base.astype(np.float32).astype(float)
    size = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.divide(unit, size, out=np.zeros_like(unit), where=size > 0)
    expected = set()
    for i in range(0, 400, 9):
        best = sorted((-s, name(j)) for j, s in enumerate(np.round(unit @ unit[i], 10)))[:20]
        expected |= {(name(i), j, r) for r, (_, j) in enumerate(best, 1)}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == expected


def test_knn_with_empty_sides(spark):
    vecs = spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert vectors.knn(asked, vecs.limit(0), 5).count() == 0
    assert vectors.knn(asked.limit(0), vecs, 5).count() == 0
    assert vectors.knn(asked, vecs.limit(0), 5, sampled_from=0).count() == 0


def test_search_needs_one_shuffle_when_sources_travel_along(spark, sf):
    from registry import inputs

    index = inputs.vectors(spark, sf).withColumn("source_id", F.floor(F.col("chunk_id") / 4))
    plan = retrieval.retrieve(vectors.knn(inputs.queries(spark, sf), index, 40), None, "fixed", 20)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in text


def test_truncation_only_touches_the_embedding_text(spark):
    rows = spark.createDataFrame([("x" * 8001,), ("y" * 8000,), (None,)], "query string")
    got = retrieval.truncate_query(rows).collect()
    assert [(len(r.query or ""), len(r.embedding_text or ""), r.truncated) for r in got] == [
        (8001, 8000, True), (8000, 8000, False), (0, 0, False),
    ]


def test_near_ties_are_told_apart(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    rows = [(1, [1.0, 0.0012]), (2, [1.0, 0.0011])]
    vecs = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(2)
    assert [r.chunk_id for r in vectors.knn(queries, vecs, 1).collect()] == [2]
    assert [r.chunk_id for r in vectors.knn(queries, vecs, 1, max_shipped=1, sampled_from=0).collect()] == [2]


def test_exact_copies_tie_by_id_in_any_tile(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 4)
    queries = spark.createDataFrame([(1, [0.3, 0.7, 0.1])], "query_id long, embedding array<float>")
    rows = [(k, [0.1, 0.9, 0.4] if k % 3 else [0.2, 1.8, 0.8]) for k in range(40)]
    vecs = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    assert [r.chunk_id for r in vectors.knn(queries, vecs, 7).orderBy("rank").collect()] == list(range(7))


def test_emitted_hits_do_not_grow_with_the_tasks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4000, 8)).round(3).tolist()
    vecs = spark.createDataFrame(list(enumerate(base)), "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, base[i]) for i in range(20)], "query_id long, embedding array<double>").toArrow()
    schema, k = "query_id long, chunk_id long, score double", 10
    emitted = {}
    for tasks in (4, 40):
        rows = vecs.select("embedding", "chunk_id").repartition(tasks, "chunk_id")
        emitted[tasks] = [vectors._scan(asked, rows, k, schema, sampled).count() for sampled in (False, True)]
    assert emitted[40][0] == 20 * 40 * k
    assert emitted[4][1] <= emitted[40][1] < 20 * k * vectors.SAMPLE_SHARE * 2


@pytest.mark.parametrize("sampled_from", [1, 100])
def test_search_with_missing_sources(spark, sampled_from):
    big = 2**62 + 1  # more than a double can hold
    rows = [(big + i, None if i % 3 else big, [1.0, float(i)]) for i in range(9)]
    for some in (rows, [(i, None, v) for i, _, v in rows]):
        table = spark.createDataFrame(some, "chunk_id long, source_id long, embedding array<double>").repartition(3)
        asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
        found = vectors.knn(asked, table, 4, sampled_from=sampled_from).orderBy("rank").collect()
        assert [(r.chunk_id, r.source_id) for r in found] == [r[:2] for r in some[:4]]


def test_chunk_tables_travel_to_the_hits(spark, monkeypatch):
    hits = spark.range(200).select((F.col("id") % 9).alias("query_id"), (F.col("id") % 50).alias("chunk_id"), F.lit(0.5).alias("score"))
    chunks = spark.range(40).select(F.col("id").alias("chunk_id"), F.floor(F.col("id") / 4).alias("source_id"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for most, join in ((40, "BroadcastHashJoin"), (39, "SortMergeJoin")):
            monkeypatch.setattr(retrieval, "SHIPPED_CHUNKS", most)
            rows = retrieval.attach_sources(hits.repartition(3, "query_id"), chunks)
            assert join in rows._jdf.queryExecution().executedPlan().toString()
            found.append(sorted(map(tuple, rows.select("query_id", "chunk_id", "source_id").collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found[0] == found[1] == sorted((i % 9, i % 50, i % 50 // 4) for i in range(200) if i % 50 < 40)
