"""Vector tables: exact cosine top-k, index membership, content-type selection, counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.vectors import normalize as _normalize
# Bytes of queries and winners that a task holds at most; more queries are met cell by cell.  A winner is held twice
# until the next cut, and copied by it.
MAX_SHIPPED_BYTES = 32 << 20
WINNER_BYTES = 100
# Hits that a task ranks, rolls up and cuts; they take some 340 bytes each while they are sorted, few enough not to spill.
HITS_PER_TASK = 500_000
# Tables of more partitions than this are sampled first for the scores to beat.
SAMPLED_FROM = 16
SAMPLE_SHARE = 16
# Similarities held at once inside a task (8 bytes each).
TILE = 1_000_000
# Scores are compared after rounding to ten digits, far above the noise of sums and far below what single precision
# tells apart, so exact copies tie; six digits are shown.
SCORE_DIGITS = 10
SHOWN_DIGITS = 6
# Of a whole number that holds a score of so many digits.
KEY_BITS = 36


def normalize(df: DataFrame, vec: str = "embedding", out: str = "embedding") -> DataFrame:
    """Scale vectors to unit length (inner product of two such vectors is their cosine)."""
    return _normalize(df, vec, out)


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    max_shipped: int | None = None,
    sampled_from: int = SAMPLED_FROM,
) -> DataFrame:
    """The ``k`` most similar chunks of every query: (query_id, chunk_id, score, rank).

    ``queries(query_id, embedding)`` against ``vectors(chunk_id, embedding)``, exact, ranked
    by cosine (ten digits) and then by chunk id; the score is shown with six digits.  A ``source_id`` kept with the
    vectors comes along, which spares the later roll-up a join with the chunk table.

    Queries of at most ``MAX_SHIPPED_BYTES`` (or ``max_shipped`` rows) travel to the tasks in one batch; the vectors are
    scanned in place and never shuffled.  A table of more than ``sampled_from`` partitions is sampled first: the k-th
    best score of the sample is a lower bound of the k-th best of all, and tasks emit only hits at or above it.  What is
    shuffled is then about ``SAMPLE_SHARE`` times k rows per query, however many tasks there are.
    More queries never pass the driver: they meet the vectors cell by cell, see ``cells``.
    ``queries`` should be a stored table, since it is counted first.
    """
    from lodestar.operators import cells  # built on the block search of this module

    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    tags = [c for c in ("chunk_id", "source_id") if c in vectors.columns]
    v = vectors.select("embedding", *tags)
    types = [("query_id", q.schema["query_id"]), *((c, v.schema[c]) for c in tags)]
    schema = ", ".join(f"{name} {field.dataType.simpleString()}" for name, field in types) + ", score double"
    n, width = q.agg(F.count("*"), F.max(F.size("embedding"))).first()
    shipped = max_shipped or max(1, MAX_SHIPPED_BYTES // (8 * max(width or 1, 1) + WINNER_BYTES * k))
    if n > shipped:
        # single precision takes half the shuffle where both sides have it
        alike = queries.schema["embedding"].dataType == v.schema["embedding"].dataType
        asked = queries.select("query_id", "embedding") if alike else q
        found = cells.search(asked, v if alike else v.withColumn("embedding", F.col("embedding").cast("array<double>")), k, schema)
        # What follows by query stays in these partitions, whose number grows with the hits.
        found = found.repartition(-(-n * k // HITS_PER_TASK), "query_id")
    else:
        found = _scan(q.toArrow(), v, k, schema, v.rdd.getNumPartitions() > sampled_from)
    return _best(found, k).withColumn("score", F.round("score", SHOWN_DIGITS))


def _scan(asked: pa.Table, v: DataFrame, k: int, schema: str, sampled: bool) -> DataFrame:
    rows, ids = _unit_rows(asked.column("embedding"), [asked.column("query_id")])
    floor = _bounds(rows, v, k) if sampled and len(rows) else np.full(len(rows), -np.inf)
    shipped = v.sparkSession.sparkContext.broadcast((rows, pa.array(ids[0]), floor))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rows, q_ids, floor = shipped.value
        best = _BestK(floor, k)
        fields = []
        for batch in batches:
            fields = [batch.schema.field(i) for i in range(1, batch.num_columns)]
            best.offer_all(q_rows, *_unit_rows(batch.column(0), batch.columns[1:]))
        if best.parts:
            yield from best.table(q_ids, fields).to_batches(max_chunksize=100_000)

    return v.mapInArrow(scan, schema)


def _bounds(rows: np.ndarray, v: DataFrame, k: int) -> np.ndarray:
    """For each query the k-th best score in a sample by chunk id; minus infinity if the sample is too small."""
    sample = v.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(SAMPLE_SHARE)) == 0)
    shipped = v.sparkSession.sparkContext.broadcast(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _BestK(np.full(len(shipped.value), -np.inf), k)
        for batch in batches:
            best.offer_all(shipped.value, *_unit_rows(batch.column(0), [batch.column(1)]))
        if best.parts:
            table = best.table(pa.array(np.arange(len(shipped.value))), [batch.schema.field(1)])
            yield from table.select(["query_id", "score"]).to_batches(max_chunksize=100_000)

    hits = sample.select("embedding", "chunk_id").mapInArrow(scan, "query_id long, score double")
    place = W.partitionBy("query_id").orderBy(F.desc("score"))
    kth = hits.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") == k).select("query_id", "score").toArrow()
    floor = np.full(len(rows), -np.inf)
    floor[kth.column("query_id").to_numpy()] = kth.column("score").to_numpy()
    return floor


def _best(found: DataFrame, k: int) -> DataFrame:
    """Merge per-task winners."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _unit_rows(vecs, tags: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """An Arrow list column as a matrix of unit-length rows, with the columns beside it.

    Rows without a vector are left out.
    """
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    keep = vecs.is_valid() if vecs.null_count else None
    columns = []
    for tag in tags:
        kept = pa.chunked_array([tag]) if isinstance(tag, pa.Array) else tag
        kept = kept if keep is None else kept.filter(keep)
        # numpy has no null numbers: columns with nulls stay Python objects
        columns.append(np.array(kept.to_pylist(), object) if kept.null_count else kept.to_numpy())
    vecs = vecs if keep is None else vecs.filter(keep)
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(np.unique(vecs.value_lengths().to_numpy(zero_copy_only=False))) > 1:
        raise ValueError("vectors of one table must have the same dimension")
    rows = flat.reshape(len(vecs), -1) if len(flat) else np.zeros((len(vecs), 0))
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0), columns


class _BestK:
    """Running exact top-k per query over blocks of vectors."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k = k
        self.floor = floor.copy()
        # Tuples of query number, score and the columns kept beside each vector, id first.
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def offer_all(
        self, q_rows: np.ndarray, v_rows: np.ndarray, tags: list[np.ndarray], only: np.ndarray | None = None
    ) -> None:
        """Offer vectors to all queries, or to those numbered in ``only``."""
        asked = q_rows if only is None else q_rows[only]
        if not len(asked) or not len(v_rows):
            return
        width = max(1, TILE // len(asked))
        for at in range(0, len(v_rows), width):
            self._offer(asked @ v_rows[at : at + width].T, [t[at : at + width] for t in tags], only)

    def _offer(self, scores: np.ndarray, tags: list[np.ndarray], only: np.ndarray | None) -> None:
        floor = self.floor if only is None else self.floor[only]
        # Only what may count is rounded: rounding moves a score by less than one of the last digit.
        least = floor - 10.0**-SCORE_DIGITS
        there = scores >= least[:, None]
        if scores.shape[1] > self.k and np.count_nonzero(there) > self.k * len(scores):
            cut = scores.shape[1] - self.k
            kth = np.partition(scores, cut, axis=1)[:, cut]
            there = scores >= np.maximum(least, kth - 10.0**-SCORE_DIGITS)[:, None]
        qi, vi = np.divmod(np.flatnonzero(there), scores.shape[1])
        score = np.round(scores[qi, vi], SCORE_DIGITS)
        there = score >= floor[qi]
        qi, vi, score = qi[there], vi[there], score[there]
        qi = (qi if only is None else only[qi]).astype(np.int32)
        self.parts.append((qi, score, *(t[vi] for t in tags)))
        self.held += len(qi)
        if self.held > 2 * self.k * len(self.floor):
            self._compact()

    def _compact(self) -> tuple[np.ndarray, ...]:
        qi, score, ids, *rest = (np.concatenate(c) for c in zip(*self.parts))
        # Query and score as one whole number: far faster to sort than three columns.
        key = (qi.astype(np.int64) << KEY_BITS) - np.rint(score * 10.0**SCORE_DIGITS).astype(np.int64)
        order = np.argsort(key)
        key, qi = key[order], qi[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        ends = np.flatnonzero(place[1:] == self.k)
        if (key[ends] == key[ends + 1]).any():  # equal scores at the cut: the smallest ids stay
            order = order[np.lexsort((ids[order], key))]
        order = order[place < self.k]
        last = place == self.k - 1
        self.floor[qi[last]] = score[order][last[place < self.k]]
        self.parts = [(qi[place < self.k], score[order], ids[order], *(r[order] for r in rest))]
        self.held = len(order)
        return self.parts[0]

    def table(self, q_ids: pa.Array, fields: list[pa.Field], last: bool = False) -> pa.Table:
        """The winners; or the ``last`` of each query that has ``k``."""
        qi, score, *tags = self._compact()
        if last:
            ends = np.flatnonzero(np.arange(len(qi)) - np.searchsorted(qi, qi) == self.k - 1)
            qi, score, *tags = (c[ends] for c in (qi, score, *tags))
        columns = {"query_id": q_ids.take(pa.array(qi))}
        columns.update((f.name, pa.array(tag, f.type)) for f, tag in zip(fields, tags))
        return pa.table({**columns, "score": pa.array(score)})


def select_types(chunks: DataFrame, types: tuple[str, ...] | list[str]) -> DataFrame:
    """Chunks of the given content types (a bag union of per-type loads)."""
    return chunks.filter(F.col("content_type").isin(*types))


def ensure_index(indexes: DataFrame, name: str) -> DataFrame:
    """Rows to append so that index ``name`` exists: one, or none if it is there already."""
    wanted = indexes.sparkSession.range(1).select(F.lit(name).alias("index_name"))
    return wanted.join(indexes.select("index_name"), "index_name", "left_anti")


def add_members(ids: DataFrame, chunks: DataFrame, indexes: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """New (index_name, chunk_id) rows for ``ids``: known chunks not yet in an existing index."""
    known = ids.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    there = members.filter(F.col("index_name") == name).select("chunk_id")
    fresh = known.join(there, "chunk_id", "left_anti").withColumn("index_name", F.lit(name))
    index = indexes.filter(F.col("index_name") == name).select("index_name").limit(1)  # one row or none
    return fresh.join(F.broadcast(index), "index_name", "left_semi").select("index_name", "chunk_id")


def counts(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks loaded per index and content type."""
    typed = members.join(chunks.select("chunk_id", "content_type"), "chunk_id")
    return typed.groupBy("index_name", "content_type").agg(F.count("*").alias("n_chunks"))
