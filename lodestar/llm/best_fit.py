"""Best-fit packing of documents into token sequences, certified by lower bounds.

Only documents longer than a sequence are cut, into full sequences; the rest at their front is packed like a whole
document.  Each block of documents is packed best-fit decreasing inside its task, without a shuffle.  Dual-feasible
functions of the lengths give the least number of sequences that any packing needs.  Sequences with a gap are exchanged
between blocks, as lengths alone, and packed again, until the number of sequences is certified or stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.joined import ByteLevelEncoder
from lodestar.llm.text_arrays import as_bytes, slices
from lodestar.plans.staging import staged

#: Tokens of a sequence, and the id that ends each document.
CAPACITY = 1024
END_ID = 2
#: Tokens that a task packs at once, and pieces that an exchange brings together.
BLOCK_TOKENS = 1 << 22
POOL_PIECES = 1 << 20
#: Exchanges at most; each stops earlier where the number of sequences is certified or no longer falls.
ROUNDS = 6

PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, gap int, key long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each piece its bin and place there, and for each bin the capacity left."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set where a bin has room for r
    left: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            of_room = by_room[room]
            chosen = of_room.pop()
            if not of_room:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = chosen, capacity - room
        left[chosen] = rest = room - n
        if rest:
            by_room.setdefault(rest, []).append(chosen)
            rooms |= 1 << rest
    return bins, offsets, np.array(left, np.int64)


def fewest_bins(counts: np.ndarray) -> int:
    """A lower bound for the bins of capacity ``len(counts) - 1`` that ``counts[n]`` pieces of each length n need.

    A dual-feasible function maps lengths that fit a bin to numbers that fit one, so the sum over all pieces bounds the
    bins from below.  Taken are the identity, the functions that raise lengths above 1 - e and drop those below e, the
    step functions of 1/k, and their composition, as exact fractions.
    """
    capacity = len(counts) - 1
    held = np.flatnonzero(counts)
    if not len(held):
        return 0
    small = int(counts.sum()) < 2**62 // (18 * capacity) // capacity
    n = counts[held] if small else counts[held].astype(object)  # sums of any size
    edges = np.unique(np.concatenate([[0], held[held <= capacity // 2]]))
    shaped = np.where(held > capacity - edges[:, None], capacity, np.where(held < edges[:, None], 0, held))
    best = 0
    for k in range(0, 17):
        if k:
            values = np.where((k + 1) * shaped % capacity == 0, shaped * k, (k + 1) * shaped // capacity * capacity)
        else:
            values = shaped
        unit = capacity * max(k, 1)
        largest = int(((values if small else values.astype(object)) @ n).max())
        best = max(best, -(-largest // unit))
    return best


def piece_bounds(total: int, capacity: int) -> list[int]:
    """Where the pieces of a document begin, and its end: the first may be shorter, all others are full."""
    if total <= capacity:
        return [0, total]
    return [*([0] if total % capacity else []), *range(total % capacity, total + 1, capacity)]


#: The tokenizer of this worker process.
_MADE: dict[int, ByteLevelEncoder] = {}


def _pack(batches: Iterator[pa.RecordBatch], model, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    if hash(model.value) not in _MADE:
        _MADE.clear()
        _MADE[hash(model.value)] = ByteLevelEncoder(model.value)
    made = _MADE[hash(model.value)]
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    full: list[tuple] = []
    short: list[tuple] = []
    held = sequences = keys = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, sequences, keys
        bins, offsets, left = best_fit(np.array([len(p[3]) for p in short], np.int64), capacity)
        placed = [(*p, b + len(full), o, g) for p, b, o, g in zip(short, bins.tolist(), offsets.tolist(), left[bins].tolist())]
        placed += [(*p, k, 0, 0) for k, p in enumerate(full)]
        rows = [
            (doc, piece, start, len(ids), ids.tobytes(), part << 36 | sequences + b, offset, gap, part << 36 | keys + k)
            for k, (doc, piece, start, ids, b, offset, gap) in enumerate(placed)
        ]
        sequences += len(full) + len(left)
        keys += len(rows)
        held = 0
        full.clear()
        short.clear()
        for first in range(0, len(rows), 4000):
            columns = zip(*rows[first : first + 4000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for some in slices(batch, "text"):
            ids, begins = made.encode(*as_bytes(some.column("text")))
            for doc, a, b in zip(some.column("doc_id").to_pylist(), begins[:-1], begins[1:], strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                bounds = piece_bounds(len(own), capacity)
                for piece, (start, stop) in enumerate(zip(bounds, bounds[1:])):
                    (full if stop - start == capacity else short).append((doc, piece, start, own[start:stop]))
                held += len(own)
                if held >= BLOCK_TOKENS:
                    yield from flush()
    yield from flush()


def _again(part: pa.Table, capacity: int) -> pa.Table:
    """Pack a pool's pieces anew, unless their sequences are certified as fewest; they stay if that takes no fewer."""
    names = np.unique(part.column("sequence_id").to_numpy())
    lengths = part.column("length").to_numpy()
    if len(names) <= fewest_bins(np.bincount(lengths, minlength=capacity + 1)):
        return part.drop_columns(["pool"])
    order = np.argsort(part.column("key").to_numpy())
    bins, offsets, left = best_fit(lengths[order], capacity)
    if len(left) >= len(names):
        return part.drop_columns(["pool"])
    columns = {
        "key": part.column("key").take(pa.array(order)),
        "length": part.column("length").take(pa.array(order)),
        "sequence_id": pa.array(names[bins]),  # the first of the old numbers are used again
        "offset": pa.array(offsets),
        "gap": pa.array(left[bins], pa.int32()),
    }
    return pa.table(columns)


def _counts(pieces: DataFrame, capacity: int) -> tuple[int, np.ndarray]:
    """Sequences, and pieces of each length: one number per possible length."""
    rows = pieces.groupBy("length").agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for length, n, _ in rows:
        counts[length] = n
    return sum(r[2] for r in rows), counts


def packed_best_fit(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, pool_pieces: int = POOL_PIECES
) -> DataFrame:
    """Pack every row's text into as few sequences of ``capacity`` tokens as the method finds; one row per piece.

    ``tokenizer`` is the path of a byte-level tokenizer file, read on the driver.  A piece has its document, its number
    ``piece`` there, the ids of the document before it, its ``length``, its ``ids`` (little-endian unsigned 32-bit), and
    its place: ``sequence_id``, ``offset``.  A document has its ids and ``end_id``; one longer than a sequence is cut so
    that all its pieces but the first are full.  A null text counts as empty and gives the end id alone; repeated rows
    and rows without id are packed each for itself; other columns are ignored; an empty table gives no row.

    A block of a task, of ``BLOCK_TOKENS``, is packed first.  While there are more sequences than ``fewest_bins`` of all
    lengths asks for, those with a gap are dealt into pools of about ``pool_pieces`` pieces, anew each time, and a pool
    that needs fewer sequences is packed again.  Only keys and lengths are exchanged; of the ids just those of pieces in
    sequences that had a gap at first are shuffled, once, at the end.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def pack(batches):
        return _pack(batches, model, end_id, capacity)

    def again(part):
        return _again(part, capacity)

    first = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, PIECES))
    small = ["key", "length", "sequence_id", "offset", "gap"]
    sequences, counts = _counts(first, capacity)
    least = fewest_bins(counts)
    moved, pending = [], first.where("gap > 0").select(*small)
    n_pending = pending.count()
    for turn in range(ROUNDS):
        if sequences <= least or not n_pending:
            break
        pools = -(-n_pending // pool_pieces)
        pool = F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(pools))
        packed = pending.withColumn("pool", pool).groupBy("pool").applyInArrow(again, ", ".join(
            f"{c} {pending.schema[c].dataType.simpleString()}" for c in small
        ))
        packed = staged(packed)
        before, sequences = sequences, sequences - pending.where("offset = 0").count() + packed.where("offset = 0").count()
        moved.append(packed.where("gap = 0"))
        pending = packed.where("gap > 0")
        n_pending = pending.count()
        if pools == 1 or sequences == before:
            break
    if not moved:
        return first.drop("gap", "key")
    places = pending
    for done in moved:
        places = places.unionByName(done)
    settled = first.where("gap = 0").drop("gap", "key")
    again_placed = first.where("gap > 0").drop("sequence_id", "offset", "gap").join(
        places.select("key", "sequence_id", "offset"), "key"
    )
    return settled.unionByName(again_placed.drop("key"))
