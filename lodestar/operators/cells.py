"""Exact cosine top-k for query tables too large to ship: vectors in cells, queries as rows, whole cells skipped.

Vectors are keyed by the nearest of a few pivots and by their angle to it, which gives blocks of bounded bytes with known
least and largest angles.  By the triangle inequality of angles, a query at angle ``a`` to a pivot is at least
``max(0, a - largest, least - a)`` away from every vector of the block, so a block whose best possible cosine is below the
k-th best score found so far holds no answer.  The pivots only decide how much is skipped, never what is found.

Queries travel as rows of a table, once, in groups of neighbours of bounded bytes.  The blocks that a group visits
stream past it in one sorted stream, and each query meets those of its own list.  A task holds one group with its
winners so far, so no more than ``k`` rows of a query leave it, however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.vectors import _BestK, _unit_rows
from lodestar.plans.staging import staged

# Bytes of vectors in a block at most; tables of fewer blocks than tasks have smaller ones.
BLOCK_BYTES = 64 << 20
# Pivots are vectors of a sample by id, so many and of so many bytes at most.
PIVOTS = 256
PIVOT_BYTES = 16 << 20
RINGS = 64
# A query first visits its nearest blocks with a sixteenth of all vectors (and k at least): their k-th best score is to beat.
FIRST_SHARE = 16
# Far above the noise of the angles, which is about 1e-8.
SLACK = 1e-6
PLANNED_AT_ONCE = 200
# Bytes of a group of queries with its winners, and winners of the queries that meet a tile: few queries have wide tiles, of
# which the k best are a small share.
GROUP_BYTES = 256 << 20
HELD_BYTES = 64
CUT_AT_ONCE = 64_000
ASKED_AT_ONCE = 2_000
MAX_TASKS = 20_000


@dataclass
class Directory:
    """Runs of rings of one cell: their blocks, rows and angles.  At most ``(PIVOTS + 1) * RINGS`` of them."""

    pivots: np.ndarray
    cell: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    @property
    def blocks(self) -> int:
        return int(self.parts.sum())

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """The best cosine that each query can reach in each run."""
        angle = np.arccos(np.clip(rows @ self.pivots.T, -1, 1))[:, self.cell]
        away = np.maximum(np.maximum(angle - self.largest, self.least - angle), 0)
        # vectors of length zero (cell -1) have a cosine of 0 with everything and no angle
        return np.where(self.cell < 0, 1.0, np.cos(away))

    def nearest(self, rows: np.ndarray, least_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The runs that a query visits first, as a mask, and its home, the run that can be nearest.

        Queries of one home visit the same runs, those nearest to its pivot, so that a group asks for few blocks.
        """
        home, of = np.unique(np.where(self.cell < 0, -2.0, self.bounds(rows)).argmax(axis=1), return_inverse=True)
        reach = self.bounds(self.pivots[self.cell[home]])
        reach[np.arange(len(home)), home] = np.inf
        order = np.argsort(-reach, axis=1, kind="stable")
        size = self.rows[order]
        mask = np.zeros(order.shape, bool)
        np.put_along_axis(mask, order, np.cumsum(size, axis=1) - size < least_rows, axis=1)
        return mask[of], home[of]

    def visited(self, mask: np.ndarray, home: np.ndarray | None = None) -> pa.ListArray:
        """The blocks of the marked runs of each query, those of its ``home`` first."""
        at, run = np.nonzero(mask)
        if home is not None:
            run = run[np.lexsort((run, run != home[at], at))]
        parts = self.parts[run]
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        each = np.bincount(at, weights=parts, minlength=len(mask)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, (np.repeat(self.first[run], parts) + within).astype(np.int32))


def search(queries: DataFrame, vectors: DataFrame, k: int, schema: str, block_rows: int | None = None) -> DataFrame:
    """The ``k`` best vectors of every query, unranked: the columns of ``schema``, which ends in the score.

    ``queries(query_id, embedding)`` and ``vectors(embedding, chunk_id, ...)``, vectors of one type.  Rows without a
    vector are left out.  Nothing but pivots and directories of blocks and groups, all bounded, is in the driver.  Vectors
    are stored once beside their cell and shuffled once for each group of queries that visits them, first for the scores
    to beat and then for the answers; queries are shuffled twice.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter(F.col("embedding").isNotNull())
    n, width = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    tasks = 2 * spark.sparkContext.defaultParallelism
    block_rows = block_rows or max(1, min(BLOCK_BYTES // (8 * max(width, 1)), -(-n // tasks)))
    placed, directory = build(vectors, n, width, block_rows)
    planned = first_visits(queries.filter(F.col("embedding").isNotNull()), directory, max(k, n // FIRST_SHARE))
    started = planned.withColumn("floor", F.lit(float("-inf")))
    # Of the first visits only the k-th scores are kept, one a query: the second round meets these blocks again.
    kth = staged(_meet(placed, started, directory, k, schema, last=True).select("query_id", "score"))
    later = later_visits(planned, kth, directory, 1)
    whole = staged(later.select("query_id", "embedding", "floor", F.concat("seen", "blocks").alias("blocks")))
    return _meet(placed, whole, directory, k, schema)


def build(vectors: DataFrame, n: int, width: int, block_rows: int) -> tuple[DataFrame, Directory]:
    """Vectors with their ``block``, and the directory of the blocks."""
    pivots = _pivots(vectors, min(PIVOTS, max(1, PIVOT_BYTES // (16 * max(width, 1))), -(-n // block_rows)))
    shipped = vectors.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = _unit_rows(batch.column("embedding"), [])
            cosine = rows @ shipped.value.T
            cell = cosine.argmax(axis=1).astype(np.int32)
            angle = np.arccos(np.clip(cosine[np.arange(len(rows)), cell], -1, 1))
            cell[~rows.any(axis=1)] = -1
            ring = np.minimum(angle * (RINGS / np.pi), RINGS - 1).astype(np.int32)
            names = [*batch.schema.names, "cell", "ring", "angle"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(ring), pa.array(angle)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    # Stored, since a repeated product of matrices may differ in its last digit and so in the cell.
    placed = staged(vectors.mapInArrow(place, f"{schema}, cell int, ring int, angle double"))
    counted = placed.groupBy("cell", "ring").agg(
        F.count("*").alias("rows"), F.min("angle").alias("least"), F.max("angle").alias("largest")
    )
    runs: list[list] = []
    where = []
    first = 0
    for cell, ring, rows, least, largest in sorted(tuple(r) for r in counted.collect()):
        if runs and runs[-1][0] == cell and runs[-1][3] + rows <= block_rows:
            runs[-1][3] += rows
            runs[-1][5] = largest
        else:
            runs.append([cell, first, -(-rows // block_rows), rows, least, largest])
            first += runs[-1][2]
        where.append((cell, ring, runs[-1][1], runs[-1][2]))
    spread = vectors.sparkSession.createDataFrame(where, "cell int, ring int, first int, parts int")
    block = (F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).cast("int")
    blocked = placed.join(F.broadcast(spread), ["cell", "ring"]).withColumn("block", block)
    return blocked.drop("cell", "ring", "angle", "first", "parts"), Directory(pivots, *map(np.array, zip(*runs)))


def _pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """Up to ``count`` different vectors of a sample of twice as many by id."""
    sample = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(2 * count).select("embedding").toArrow()
    rows, _ = _unit_rows(sample.column("embedding"), [])
    different = rows[np.sort(np.unique(rows, axis=0, return_index=True)[1])]
    some = different[different.any(axis=1)][:count]
    return some if len(some) else np.zeros((1, rows.shape[1]))


def first_visits(queries: DataFrame, directory: Directory, least_rows: int) -> DataFrame:
    """Queries with the ``blocks`` that they visit first, stored."""
    shipped = queries.sparkSession.sparkContext.broadcast(directory)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, PLANNED_AT_ONCE):
            rows, _ = _unit_rows(part.column("embedding"), [])
            blocks = shipped.value.visited(*shipped.value.nearest(rows, least_rows))
            yield pa.RecordBatch.from_arrays([*part.columns, blocks], names=[*part.schema.names, "blocks"])

    kind = queries.schema["query_id"].dataType.simpleString()
    vector = queries.schema["embedding"].dataType.simpleString()
    return staged(queries.select("query_id", "embedding").mapInArrow(plan, f"query_id {kind}, embedding {vector}, blocks array<int>"))


def later_visits(planned: DataFrame, near: DataFrame, directory: Directory, k: int) -> DataFrame:
    """Queries with the score to beat, ``floor``, the k-th best of ``near``, and the further ``blocks`` that can hold such a
    score, beside those ``seen``."""
    place = W.partitionBy("query_id").orderBy(F.desc("score"))
    ranked = near.select("query_id", "score").withColumn("place", F.row_number().over(place))
    floors = ranked.filter(F.col("place") == k).select("query_id", F.col("score").alias("floor"))
    asked = planned.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    shipped = planned.sparkSession.sparkContext.broadcast(directory)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shipped.value
        for part in _slices(batches, PLANNED_AT_ONCE):
            rows, _ = _unit_rows(part.column("embedding"), [])
            mask = d.bounds(rows) + SLACK >= part.column("floor").to_numpy()[:, None]
            seen = part.column("blocks")
            asking = np.repeat(np.arange(len(rows)), seen.value_lengths().to_numpy())
            mask[asking, np.searchsorted(d.first, seen.flatten().to_numpy(), "right") - 1] = False
            columns = [part.column("query_id"), part.column("embedding"), seen, d.visited(mask), part.column("floor")]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "embedding", "seen", "blocks", "floor"])

    kind = planned.schema["query_id"].dataType.simpleString()
    vector = planned.schema["embedding"].dataType.simpleString()
    columns = asked.select("query_id", "embedding", "blocks", "floor")
    made = f"query_id {kind}, embedding {vector}, seen array<int>, blocks array<int>, floor double"
    return columns.mapInArrow(plan, made)


def _grouped(asked: DataFrame, directory: Directory, k: int, width: int) -> tuple[DataFrame, int]:
    """Queries with their ``group``, and how many there are: neighbours by the first block of their list, so many that a
    group with its winners has bounded bytes.  Every group meets nearly all vectors where nothing can be skipped, so there
    are no more than that and one for each core."""
    home = F.get("blocks", F.lit(0))
    counted = sorted(tuple(r) for r in asked.groupBy(home.alias("home")).agg(F.count("*").alias("rows")).collect())
    total = sum(rows for _, rows in counted)
    bounded = GROUP_BYTES // (8 * max(width, 1) + HELD_BYTES * k + directory.blocks)
    most = max(1, min(bounded, -(-total // asked.sparkSession.sparkContext.defaultParallelism)))
    # Queries stand in the order of their homes, inside a home at a place by hash, and are cut into groups by place.
    where, before = [], 0
    for block, rows in counted:
        where.append((block, before, rows))
        before += rows
    spread = asked.sparkSession.createDataFrame(where, "home int, before long, rows long")
    place = F.col("before") + F.pmod(F.xxhash64("query_id", "embedding"), F.col("rows"))
    dealt = asked.withColumn("home", home).join(F.broadcast(spread), "home")
    dealt = dealt.withColumn("group", F.floor(place / most).cast("int"))
    return dealt.select("group", "query_id", "embedding", "floor", "blocks"), max(1, -(-total // most))


def _meet(placed: DataFrame, asked: DataFrame, directory: Directory, k: int, schema: str, last: bool = False) -> DataFrame:
    """The best ``k`` vectors of each query in the blocks of its list, at or above its floor; or just the ``last`` of them,
    which a query with fewer does not have."""
    width = directory.pivots.shape[1]
    dealt, groups = _grouped(asked, directory, k, width)
    needs = dealt.select("group", F.explode("blocks").alias("block")).distinct()
    needs = needs.groupBy("block").agg(F.collect_list("group").alias("groups"))
    streams = placed.join(F.broadcast(needs), "block").withColumn("group", F.explode("groups")).drop("groups")
    tags = [c for c in placed.columns if c not in ("embedding", "block")]
    # Queries of a group come before the vectors, which come by block.
    both = dealt.withColumn("block", F.lit(-1)).unionByName(streams, allowMissingColumns=True)
    columns = ["group", "block", "query_id", "floor", "blocks", "embedding", *tags]
    tasks = min(groups, MAX_TASKS)
    # Groups are dealt by their number, since hashes of so few put several into one task.
    parts = both.select(*columns).repartitionById(tasks, F.col("group") % tasks)
    stream = parts.sortWithinPartitions("group", "block")
    n_blocks = directory.blocks
    rows_at_once = max(1, min(ASKED_AT_ONCE, CUT_AT_ONCE // k))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, fields = None, [], []
        for batch in batches:
            group = batch.column("group").to_numpy()
            block = batch.column("block").to_numpy()
            fields = [batch.schema.field(c) for c in tags]
            changes = np.flatnonzero((np.diff(group) != 0) | (np.diff(block) != 0)) + 1
            edges = [0, *changes, len(group)]
            for at, end in zip(edges, edges[1:]):
                if group[at] != current:
                    yield from answers(held, fields)
                    current, held = group[at], []
                part = batch.slice(at, end - at)
                if block[at] < 0:
                    held.extend(_Asking(few, k, n_blocks) for few in _slices([part], rows_at_once))
                    continue
                vectors, kept = _unit_rows(part.column("embedding"), [part.column(c) for c in tags])
                for some in held:
                    some.offer(vectors, kept, block[at])
        yield from answers(held, fields)

    def answers(held: list[_Asking], fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
        while held:
            some = held.pop(0)
            if some.best.parts:
                found = some.best.table(some.ids, fields, last)
                yield from found.to_batches(max_chunksize=100_000)

    return stream.mapInArrow(scan, schema)


class _Asking:
    """Some queries of a group with their blocks and winners."""

    def __init__(self, part: pa.RecordBatch, k: int, n_blocks: int):
        self.rows, _ = _unit_rows(part.column("embedding"), [])
        self.ids = part.column("query_id")
        self.best = _BestK(part.column("floor").to_numpy(), k)
        blocks = part.column("blocks")
        self.visits = np.zeros((n_blocks, len(self.rows)), bool)
        asking = np.repeat(np.arange(len(self.rows)), blocks.value_lengths().to_numpy())
        self.visits[blocks.flatten().to_numpy(), asking] = True

    def offer(self, vectors: np.ndarray, tags: list[np.ndarray], block: int) -> None:
        here = self.visits[block]
        self.best.offer_all(self.rows, vectors, tags, None if here.all() else np.flatnonzero(here))


def _slices(batches, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
