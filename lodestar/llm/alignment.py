"""Alignment of two tokenizers' tokens over the same text, by pointer jumping.

Tokens of both sequences are nodes, joined where their byte ranges overlap.  Every token points to the farthest-right
token that overlaps it; successors are doubled, for all tokens of a batch at once, until every token points to the last
token of its component.  That terminal token labels the component: a group of tokens of both sequences that cover the
same bytes.  An A and a B token that end together are linked; how often the corpus links two ids scores a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.joined import ByteLevelEncoder, PieceEncoder
from lodestar.llm.text_arrays import as_bytes, packed, slices, small_binary
from lodestar.plans.staging import staged

#: An id pair is one number: the B id above, the A id in the lowest bits.
A_BITS = 24
#: Bytes of text that are aligned at once.
AT_A_TIME = 2 << 20
#: Different id pairs, counted by document, of a slot: the documents whose counts are looked up together.
SLOT_PAIRS = 4_000_000

ALIGNED = "doc_id long, a_ids binary, b_ids binary, a_groups binary, b_groups binary"
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A and each B token the number of its component's terminal token, a B token.

    Both sequences cover the same bytes without gaps; ``a_ends`` and ``b_ends`` are where their tokens end.
    """
    n = len(a_ends)
    # the token of the other sequence that has a token's last byte reaches farthest right of all that overlap it
    over_a = n + np.searchsorted(b_ends, a_ends)
    over_b = np.searchsorted(a_ends, b_ends)
    own = n + np.arange(len(b_ends))
    together = a_ends[over_b] == b_ends if n else np.zeros(0, bool)
    to = np.concatenate([over_a, np.where(together, own, over_b)])
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            return to[:n] - n, to[n:] - n
        to = farther


def _ends(ids: np.ndarray, table: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, and where each ends."""
    if not len(ids):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    found = table.take(pa.array(ids))
    ends = np.frombuffer(found.buffers()[1], np.int64)[1 : len(ids) + 1]
    return np.frombuffer(found.buffers()[2], np.uint8)[: ends[-1]], ends


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that are not empty with a space before each."""
    full = np.diff(offsets) > 0
    put = np.insert(data, offsets[:-1][full], 32)
    return put, offsets + np.concatenate([[0], np.cumsum(full)])


class Both:
    """Both tokenizers of a worker."""

    def __init__(self, json: str, pieces: bytes):
        self.a = ByteLevelEncoder(json)
        self.b = PieceEncoder(pieces)

    def tokens(self, data: np.ndarray, offsets: np.ndarray):
        """Ids and ends of the tokens of both, only of texts whose tokens' bytes are the text; and where each begins."""
        data, offsets = _spaced(data, offsets)
        out, right = [], np.ones(len(offsets) - 1, bool)
        for made, table in ((self.a, self.a.bytes_of), (self.b, self.b.bytes_of)):
            ids, begins = made.encode(data, offsets)
            ids = ids[: begins[-1]]
            joined, ends = _ends(ids, table)
            places = np.concatenate([[0], ends])[begins]
            if len(joined) != len(data) or not np.array_equal(joined, data):
                for k in range(len(right)):
                    own = joined[places[k] : places[k + 1]], data[offsets[k] : offsets[k + 1]]
                    right[k] &= np.array_equal(*own)
            out.append((ids, begins, ends))
        if right.all():
            return out
        kept = []
        for ids, begins, ends in out:
            sizes = np.diff(begins) * right
            keep = np.repeat(right, np.diff(begins))
            widths = np.diff(ends, prepend=0)[keep]
            kept.append((ids[keep], np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(widths)))
        return kept


#: The tokenizers of this worker process.
_MADE: dict[int, Both] = {}


def _align(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    key = hash(model.value)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Both(*model.value)
    made = _MADE[key]
    for batch in batches:
        for part in slices(batch, "text", AT_A_TIME):
            (a, a_begins, a_ends), (b, b_begins, b_ends) = made.tokens(*as_bytes(part.column("text")))
            last_a, last_b = terminals(a_ends, b_ends)
            terminal = last_b == np.arange(len(b))
            before = np.concatenate([[0], np.cumsum(terminal)])  # groups that end before a B token
            first = before[b_begins[:-1]]  # and before a text
            groups_a = before[last_a] - np.repeat(first, np.diff(a_begins))
            groups_b = before[last_b] - np.repeat(first, np.diff(b_begins))
            columns = [
                packed(np.ascontiguousarray(x, "<u4"), begins)
                for x, begins in ((a, a_begins), (b, b_begins), (groups_a, a_begins), (groups_b, b_begins))
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(small_binary, columns)], ["doc_id", "a_ids", "b_ids", "a_groups", "b_groups"]
            )


def _shipped(docs: DataFrame, tokenizer: str, pieces: str):
    with open(tokenizer, encoding="utf-8") as f, open(pieces, "rb") as g:
        return docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))


def aligned(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """Align the tokens of a space and the text by a byte-level tokenizer file (A) with those of the text by a
    sentencepiece model (B), which adds the space: ``doc_id``, ``a_ids``, ``b_ids``, ``a_groups``, ``b_groups``.

    All are little-endian unsigned 32-bit numbers; a group is numbered from 0 within its document.  Special tokens'
    strings are plain text.  Texts that are null or empty, or whose tokens' bytes joined are not the space and the text
    (B reads U+2581 as a space), have no tokens.  Repeated rows and rows without id are aligned each for itself; other
    columns are ignored; an empty table gives no row.  Both files are read on the driver.
    """
    model = _shipped(docs, tokenizer, pieces)

    def align(batches):
        return _align(batches, model)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, ALIGNED)


def _columns(part: pa.RecordBatch) -> tuple:
    """The arrays of some aligned documents, and where each document begins in A's and in B's."""
    arrays, begins = [], []
    for name in ("a_ids", "b_ids", "a_groups", "b_groups"):
        data, offsets = as_bytes(part.column(name))
        arrays.append(np.frombuffer(data.tobytes(), "<u4").astype(np.int64))
        begins.append(offsets // 4)
    return *arrays, begins[0], begins[1]


def _last_of_groups(groups: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Marks the last token of each group."""
    last = np.ones(len(groups), bool)
    last[:-1] = groups[1:] != groups[:-1]
    last[begins[1:][begins[1:] > 0] - 1] = True
    return last


_NUMBERS = [pa.array([], pa.large_binary())]


def _numbers(most: int) -> pa.Array:
    """``1,`` ``1|`` ``1;`` for every number up to ``most`` at least."""
    if len(_NUMBERS[0]) <= 3 * most:
        some = range(1 << most.bit_length())
        _NUMBERS[0] = pa.array([f"{i}{mark}".encode() for i in some for mark in ",|;"], pa.large_binary())
    return _NUMBERS[0]


def _shown(a, b, groups_a, groups_b, a_begins, b_begins, last_a, last_b) -> list[str]:
    """SHA-256 of the written groups of each document: A's ids, B's ids, group by group."""
    n_a, n_b, ends = np.diff(a_begins), np.diff(b_begins), np.cumsum(last_b)
    first = np.concatenate([[0], ends])[b_begins[:-1]]
    of_a, of_b = np.repeat(first, n_a) + groups_a, np.repeat(first, n_b) + groups_b
    b_before = np.concatenate([[0], np.cumsum(np.bincount(of_b, minlength=1))])
    a_until = np.cumsum(np.bincount(of_a, minlength=1))
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + b_before[of_a]] = 3 * a + last_a
    order[np.arange(len(b)) + a_until[of_b]] = 3 * b + 2 * last_b
    text = _numbers(int(max(a.max(initial=0), b.max(initial=0)))).take(pa.array(order))
    places = np.frombuffer(text.buffers()[1], np.int64)[: len(order) + 1] if len(order) else np.zeros(1, np.int64)
    whole = memoryview(text.buffers()[2]) if len(order) else b""
    cuts = places[a_begins + b_begins].tolist()
    return [hashlib.sha256(whole[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of each document and its different linked id pairs, sorted, as differences, with how often each is."""
    task = TaskContext.get().partitionId()
    slot, held = 0, 0
    for batch in batches:
        for part in slices(batch, "b_ids", AT_A_TIME):
            a, b, groups_a, groups_b, a_begins, b_begins = _columns(part)
            last_a, last_b = _last_of_groups(groups_a, a_begins), _last_of_groups(groups_b, b_begins)
            sha = _shown(a, b, groups_a, groups_b, a_begins, b_begins, last_a, last_b)
            n_groups = np.diff(np.concatenate([[0], np.cumsum(last_b)])[b_begins])
            links = b[last_b] << A_BITS | a[last_a]
            of = np.repeat(np.arange(part.num_rows), n_groups)
            order = np.lexsort((links, of))
            links, of = links[order], of[order]
            new = np.ones(len(links), bool)
            new[1:] = (links[1:] != links[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(links)))
            n_pairs = np.bincount(of[at], minlength=part.num_rows)
            begins = np.concatenate([[0], np.cumsum(n_pairs)])
            codes = np.diff(links[at], prepend=0)
            codes[begins[:-1][n_pairs > 0]] = links[at][begins[:-1][n_pairs > 0]]
            slots = []
            for n in n_pairs.tolist():
                if held and held + n > SLOT_PAIRS:
                    slot, held = slot + 1, 0
                held += n
                slots.append(task << 32 | slot)
            columns = {
                "doc_id": part.column("doc_id"),
                "n_a": np.diff(a_begins),
                "n_b": np.diff(b_begins),
                "n_groups": n_groups,
                "n_links": n_groups,
                "groups_sha256": sha,
                "slot": slots,
                "codes": small_binary(packed(np.ascontiguousarray(codes, "<i8"), begins)),
                "times": small_binary(packed(np.ascontiguousarray(times, "<u4"), begins)),
            }
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _pairs(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id pairs of all documents, how often each is in its document, and where each document's begin."""
    data, offsets = as_bytes(table.column("codes"))
    steps, begins = np.frombuffer(data.tobytes(), "<i8"), offsets // 8
    run = np.cumsum(steps)
    before = np.concatenate([[0], run])[begins[:-1]]
    data, _ = as_bytes(table.column("times"))
    return run - np.repeat(before, np.diff(begins)), np.frombuffer(data.tobytes(), "<u4").astype(np.int64), begins


def _summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(codes, return_inverse=True)
    return found, np.bincount(place, times, len(found)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each id pair of a slot; a slot that comes in parts may give several rows for a pair."""
    now, codes, times = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows():
        slots = pa.array(np.full(len(codes), now if now is not None else 0, np.int64))
        return pa.RecordBatch.from_arrays([slots, pa.array(codes), pa.array(times)], ["slot", "code", "n"])

    for batch in batches:
        of = batch.column("slot").to_numpy()
        edges = np.flatnonzero(np.diff(of)) + 1
        for first, last in zip([0, *edges], [*edges, len(of)]):
            if first == last:
                continue
            if of[first] != now:
                if now is not None:
                    yield rows()
                now, codes, times = of[first], np.zeros(0, np.int64), np.zeros(0, np.int64)
            more, n, _ = _pairs(batch.slice(int(first), int(last - first)))
            codes, times = _summed(np.concatenate([codes, more]), np.concatenate([times, n]))
    yield rows()


def _score(docs: pa.Table, counted: pa.Table) -> pa.Table:
    codes, times, begins = _pairs(docs)
    known = counted.sort_by("code")
    at = np.searchsorted(known.column("code").to_numpy(), codes)
    count = known.column("count").to_numpy()[at] * times
    best = known.column("best").to_numpy(zero_copy_only=False)[at] * times
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[begins]).astype(np.int64)
    kept = docs.drop_columns(["slot", "codes", "times"])
    return kept.append_column("n_best", pa.array(total(best))).append_column("count_sum", pa.array(total(count)))


def linked(docs: DataFrame, tokenizer: str, pieces: str) -> DataFrame:
    """Align as ``aligned`` does, and give each document's figures: tokens, groups, links, and what the corpus's counts
    say of its links.

    A link is an A and a B token that end together; its ``count`` is the number of links in all documents between the
    same two ids.  ``n_best`` are a document's links whose count is the highest of their B id, ``count_sum`` is the sum
    of counts over its links; ``groups_sha256`` is the digest of the groups written as ``a1,a2|b1;a3|b2`` (empty without
    tokens).

    Documents are put in slots of bounded size.  A slot counts its own pairs first, so a pair has one row per slot and
    not one per document, however common it is; the counts return to the slots, where documents look them up.
    """
    model = _shipped(docs, tokenizer, pieces)

    def digest(batches):
        return _digest(_align(batches, model))  # in one worker: the ids need not leave it

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    docs = staged(texts.mapInArrow(digest, f"{DIGESTS}, slot long, codes binary, times binary"))
    pairs = docs.select("slot", "codes", "times").mapInArrow(_count, "slot long, code long, n long")
    counted = staged(pairs.withColumn("count", F.sum("n").over(Window.partitionBy("code"))).drop("n"))
    b = F.shiftright("code", A_BITS)
    highest = counted.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))  # a row per B id: bounded
    known = counted.join(F.broadcast(highest), b == F.col("b")).select(
        "slot", "code", "count", (F.col("count") == F.col("highest")).alias("best")
    )
    return (
        docs.groupBy("slot").cogroup(known.groupBy("slot")).applyInArrow(_score, f"{DIGESTS}, n_best long, count_sum long")
    )
