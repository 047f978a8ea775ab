"""The search by cells: exact, sparing, and without queries in the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import cells, vectors


def brute(asked, base, k):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=m.any(axis=1)[:, None])
    score = np.round(unit(asked) @ unit(base).T, 10)
    return {(q, int(j), r) for q, row in enumerate(score) for r, j in enumerate(np.lexsort((np.arange(len(base)), -row))[:k], 1)}


def table(spark, rows, name, kind="double"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], f"{name} long, embedding array<{kind}>")


def clustered(seed, clusters=12, each=60, width=5, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return (centres[:, None, :] + spread * rng.normal(size=(clusters, each, width))).reshape(-1, width)


@pytest.mark.parametrize("spread", [0.05, 3.0])
@pytest.mark.parametrize("block_rows", [4, 40, 10_000])
def test_blocks_of_any_size_give_the_exact_answer(spark, spread, block_rows):
    base = clustered(1, clusters=6, each=25, spread=spread)
    base[3], base[50:90], base[100] = 0, base[0], -base[0]  # no direction, many copies, the opposite
    asked = base[::10]
    found = cells.search(
        table(spark, asked, "query_id"), table(spark, base, "chunk_id"), 7, "query_id long, chunk_id long, score double", block_rows
    )
    got = vectors._best(found, 7).collect()
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == brute(asked, base, 7)


def test_more_answers_wanted_than_vectors(spark):
    base = clustered(2, clusters=2, each=4)
    got = vectors.knn(table(spark, base, "query_id"), table(spark, base, "chunk_id"), 50, max_shipped=1).collect()
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == brute(base, base, 50)


def test_rows_without_vector_and_repeated_queries(spark):
    base = clustered(3, clusters=2, each=10)
    vecs = table(spark, base, "chunk_id").unionByName(spark.createDataFrame([(99, None)], "chunk_id long, embedding array<double>"))
    asked = spark.createDataFrame([(0, base[0].tolist()), (0, base[0].tolist()), (1, None)], "query_id long, embedding array<double>")
    for shipped in (None, 1):
        got = vectors.knn(asked, vecs, 4, max_shipped=shipped).orderBy("rank").collect()
        # a query asked twice keeps the best four of both answers
        assert [(r.query_id, r["rank"]) for r in got] == [(0, 1), (0, 2), (0, 3), (0, 4)]
        assert [r.chunk_id for r in got[:2]] == [0, 0] and got[2].chunk_id == got[3].chunk_id != 0


def test_single_precision_and_other_columns(spark):
    base = clustered(4, clusters=3, each=20).astype(np.float32).astype(float)
    vecs = table(spark, base, "chunk_id", "float").withColumn("source_id", F.expr("if(chunk_id % 3 = 0, null, concat('s', chunk_id))"))
    got = vectors.knn(table(spark, base, "query_id", "float"), vecs, 5, max_shipped=1).collect()
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == brute(base, base, 5)
    assert all(r.source_id == (f"s{r.chunk_id}" if r.chunk_id % 3 else None) for r in got)


def visits(spark, base, asked, block_rows, k=5):
    """Blocks, and visits of the first and the second round."""
    vecs, queries = table(spark, base, "chunk_id"), table(spark, asked, "query_id")
    placed, directory = cells.build(vecs, len(base), base.shape[1], block_rows)
    assert placed.groupBy("block").count().agg(F.max("count")).first()[0] <= 3 * block_rows  # ids are hashed over the parts
    planned = cells.first_visits(queries, directory, max(k, len(base) // cells.FIRST_SHARE))
    near = cells._meet(
        placed, planned.withColumn("floor", F.lit(float("-inf"))), directory, k, "query_id long, chunk_id long, score double"
    )
    later = cells.later_visits(planned, near, directory, k)
    seen = [[set(r.blocks) for r in part.orderBy("query_id").collect()] for part in (planned, later)]
    assert all(not a & b for a, b in zip(*seen))
    return directory.blocks, *(sum(map(len, part)) for part in seen)


def test_far_cells_are_not_scanned(spark):
    base = clustered(5)
    asked = base[::24]
    blocks, first, later = visits(spark, base, asked, 30)
    assert blocks >= 12
    assert (first + later) / (blocks * len(asked)) < 0.4


def test_directions_without_clusters_are_scanned_whole(spark):
    base = np.random.default_rng(6).normal(size=(600, 64))
    blocks, first, later = visits(spark, base, base[::20], 60)
    assert (first + later) / (blocks * 30) > 0.9


def test_queries_stay_out_of_the_driver(spark, monkeypatch):
    base = clustered(7, clusters=4, each=150)
    asked = table(spark, np.tile(base, (4, 1)), "query_id")
    fetched = []
    for name in ("toArrow", "collect"):
        plain = getattr(type(asked), name)

        def counting(self, plain=plain):
            rows = plain(self)
            fetched.append((len(rows), self.columns))
            return rows

        monkeypatch.setattr(type(asked), name, counting)
    vectors.knn(asked, table(spark, base, "chunk_id"), 3, max_shipped=1).write.mode("overwrite").format("noop").save()
    assert fetched
    assert all("query_id" not in columns for _, columns in fetched)
    assert all(rows <= max(2 * cells.PIVOTS, (cells.PIVOTS + 1) * cells.RINGS) for rows, _ in fetched)


@pytest.mark.parametrize("extra", [0, 1])
def test_both_ways_agree_at_the_border(spark, extra):
    base = clustered(8, clusters=3, each=30)
    asked = base[: 10 + extra]
    got = vectors.knn(table(spark, asked, "query_id"), table(spark, base, "chunk_id"), 6, max_shipped=10).collect()
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == brute(asked, base, 6)


@pytest.mark.parametrize("block_rows", [4, 40])
def test_no_more_than_k_rows_of_a_query_leave_the_search(spark, block_rows):
    base = np.random.default_rng(9).normal(size=(160, 8))
    found = cells.search(
        table(spark, base, "query_id"), table(spark, base, "chunk_id"), 7, "query_id long, chunk_id long, score double", block_rows
    )
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {7}


@pytest.mark.parametrize("bytes_", [1, 10_000])
def test_groups_of_few_queries_give_the_exact_answer(spark, monkeypatch, bytes_):
    monkeypatch.setattr(cells, "GROUP_BYTES", bytes_)
    monkeypatch.setattr(cells, "ASKED_AT_ONCE", 3)
    base = clustered(10, clusters=4, each=20)
    got = vectors.knn(table(spark, base, "query_id"), table(spark, base, "chunk_id"), 6, max_shipped=1).collect()
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == brute(base, base, 6)


def test_held_winners_are_bounded_by_the_queries():
    rng = np.random.default_rng(11)
    asked, best, seen = rng.normal(size=(4, 5)), vectors._BestK(np.full(4, -np.inf), 3), []
    for at in range(0, 5_000, 100):
        seen.append(rng.normal(size=(100, 5)))
        best.offer_all(asked, seen[-1], [np.arange(at, at + 100)])
        assert best.held <= 2 * 3 * 4
    qi, score, ids = best._compact()
    every = np.round(asked @ np.concatenate(seen).T, vectors.SCORE_DIGITS)
    for q in range(4):
        assert ids[qi == q].tolist() == np.lexsort((np.arange(5_000), -every[q]))[:3].tolist()


def test_groups_are_no_more_than_cores_where_they_are_small(spark):
    base = np.random.default_rng(12).normal(size=(400, 8))
    placed, directory = cells.build(table(spark, base, "chunk_id"), len(base), 8, 20)
    planned = cells.first_visits(table(spark, base, "query_id"), directory, 50).withColumn("floor", F.lit(0.0))
    dealt, groups = cells._grouped(planned, directory, 5, 8)
    sizes = {r["group"]: r["count"] for r in dealt.groupBy("group").count().collect()}
    assert groups <= spark.sparkContext.defaultParallelism
    assert sum(sizes.values()) == 400 and set(sizes) <= set(range(groups))


def test_queries_of_one_home_first_visit_the_same_blocks(spark):
    base = np.random.default_rng(13).normal(size=(400, 8))
    _, directory = cells.build(table(spark, base, "chunk_id"), len(base), 8, 20)
    rows = cells.first_visits(table(spark, base, "query_id"), directory, 50).select("blocks").collect()
    # Before, a query's own angles decided, so that neighbours asked for different blocks.
    assert len({r.blocks[0] for r in rows}) == len({tuple(r.blocks) for r in rows})


def test_partitions_of_hits_grow_with_the_hits(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HITS_PER_TASK", 50)
    base = clustered(14, clusters=4, each=20)
    got = vectors.knn(table(spark, base, "query_id"), table(spark, base, "chunk_id"), 6, max_shipped=1)
    assert got.groupBy("query_id").agg(F.max("rank")).rdd.getNumPartitions() == -(-80 * 6 // 50)
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == brute(base, base, 6)
