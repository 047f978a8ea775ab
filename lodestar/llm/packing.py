"""Hierarchical multi-length packing of documents into token sequences.

Each task packs the documents of its partition: no shuffle.  A document's ids are cut into full windows of the longest
context; what is left is routed to the smallest context size (tier) that holds it.  Tier after tier, from the longest,
each remainder opens a window, the gap is filled with the largest fitting pieces of shorter tiers, and the last gap by
cutting one more piece, so windows are full.  Pieces that find no window wait for the next block of documents.  The
finished windows of a block are dealt into training steps of equal token counts, long and short documents mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm.pieces import encoder
from lodestar.llm.text_arrays import as_bytes, slices

#: Context sizes, powers of two, longest first.
TIERS = (1024, 512, 256, 128, 64)
#: Ends each document.
END_ID = 0
#: Tokens that are packed together, and tokens of a training step.
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step long"
)


class Pieces:
    """Waiting pieces by length: (ids, document, start, document's tokens)."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.lengths = 0  # bit n is set where pieces of length n wait

    def add(self, ids, doc, start, total):
        n = len(ids)
        if n:
            self.by_length.setdefault(n, []).append((ids, doc, start, total))
            self.lengths |= 1 << n

    def take(self, n):
        waiting = self.by_length[n]
        piece = waiting.pop()
        if not waiting:
            self.lengths &= ~(1 << n)
        return piece

    def largest(self, most: int) -> int:
        return (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1

    def smallest(self, least: int) -> int:
        above = self.lengths >> least
        return least + (above & -above).bit_length() - 1 if above else 0

    def cut(self, n: int, size: int):
        """The first ``size`` ids of a piece of length ``n``; the rest waits on."""
        ids, doc, start, total = self.take(n)
        self.add(ids[size:], doc, start + size, total)
        return ids[:size], doc, start, total


def fill(waiting: Pieces, tier: int, opener: int) -> list | None:
    """A full window of ``tier`` ids that begins with a piece of length ``opener``; None if too few ids wait."""
    window, gap = [waiting.take(opener)], tier - opener
    while gap:
        n = waiting.largest(min(gap, max(tier // 2, 1)))
        if n < 1:
            n = waiting.smallest(gap)
            if not n:
                for piece in window:
                    waiting.add(*piece)
                return None
            window.append(waiting.cut(n, gap))
            break
        window.append(waiting.take(n))
        gap -= n
    return window


def pack_block(waiting: Pieces, tiers: tuple[int, ...], last: bool) -> Iterator[tuple[int, list]]:
    """Take full windows, with their tier; if ``last`` also what then remains, as one window that is not full."""
    for k, tier in enumerate(tiers):
        least = tiers[k + 1] + 1 if k + 1 < len(tiers) else 1
        while (n := waiting.largest(tier)) >= least:
            window = fill(waiting, tier, n)
            if window is None:
                break
            yield tier, window
    if last:
        rest = sum(n * len(p) for n, p in waiting.by_length.items())
        for tier in tiers:
            while rest >= tier:
                window, gap = [], tier
                while gap:
                    n = waiting.largest(gap)
                    window.append(waiting.take(n) if n > 0 else waiting.cut(waiting.smallest(gap), gap))
                    gap -= len(window[-1][0])
                rest -= tier
                yield tier, window
        if rest:
            yield tiers[0], [waiting.take(n) for n in sorted(waiting.by_length, reverse=True) for _ in range(len(waiting.by_length[n]))]


def steps(windows: list[tuple[int, list]], first: int, step_tokens: int) -> list[int]:
    """A step for each window: windows of one tier in steps of equal size, dealt to and fro by attention cost."""
    out = [0] * len(windows)
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda i: (-sum(len(p[0]) ** 2 for p in windows[i][1]), i))
        n = -(-len(own) * tier // step_tokens)
        for k, i in enumerate(own):
            turn, place = divmod(k, n)
            out[i] = first + (place if turn % 2 == 0 else n - 1 - place)
        first += n
    return out


def _pack(batches: Iterator[pa.RecordBatch], model, tiers, end_id, step_tokens) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    made = encoder(f"json {hash(model.value)}", lambda: _tokenizer(model.value))
    waiting, count, step, longest = Pieces(), 0, 0, tiers[0]
    full: list[tuple[int, list]] = []

    def emit(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal count, step
        windows = full + list(pack_block(waiting, tiers, last))
        full.clear()
        of_step = steps(windows, step, step_tokens)
        step = max(of_step, default=step - 1) + 1
        rows = []
        for (tier, window), k in zip(windows, of_step, strict=True):
            offset = 0
            for ids, doc, start, total in window:
                rows.append((doc, start, len(ids), ids.tobytes(), total, part << 36 | count, offset, tier, part << 36 | k))
                offset += len(ids)
            count += 1
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for first in range(0, len(rows), 20_000):
            columns = zip(*rows[first : first + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    held = 0
    for batch in batches:
        for part_of in slices(batch, "text"):
            ids, begins = made.encode(*as_bytes(part_of.column("text")))
            for doc, a, b in zip(part_of.column("doc_id").to_pylist(), begins[:-1], begins[1:], strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                whole = len(own) // longest * longest
                for start in range(0, whole, longest):
                    full.append((longest, [(own[start : start + longest], doc, start, len(own))]))
                waiting.add(own[whole:], doc, whole, len(own))
                held += len(own)
                if held >= BLOCK_TOKENS:
                    yield from emit(False)
                    held = 0
    yield from emit(True)


def _tokenizer(model: str) -> Tokenizer:
    made = Tokenizer.from_str(model)
    made.encode_special_tokens = True
    made.no_truncation()
    made.no_padding()
    return made


def packed_sequences(
    docs: DataFrame,
    tokenizer: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """Pack every row's text; one row per piece.

    ``tokenizer`` is the path of a byte-level tokenizer file, read on the driver.  A piece has its document, the ids of
    the document before it, its ``length``, its ``ids`` (little-endian unsigned 32-bit), the document's token count with
    the end id, and its place: ``sequence_id``, ``offset``, the sequence's ``tier`` and training ``step``.  Every
    sequence is full but at most one per partition.  A null text counts as empty and gives the end id alone; repeated
    rows and rows without id are packed each for itself; other columns are ignored; an empty table gives no row.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    tiers = tuple(sorted(tiers, reverse=True))

    def pack(batches):
        return _pack(batches, model, tiers, end_id, step_tokens)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, SCHEMA)
