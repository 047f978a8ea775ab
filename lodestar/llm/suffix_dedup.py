"""Removal of byte passages that repeat across documents, by suffix arrays.

Removed is each byte covered by a string of ``WINDOW`` bytes that also starts in a document with a smaller id.

Comparing all suffixes of all shards would move the corpus many times over, so shards first agree on where copies can
be.  Documents are dealt into shards of bounded size.  A window's minimizer, the smallest hash of the ``GRAM``-byte
grams inside it, depends on its bytes alone, so equal windows have equal minimizers; they are about one in eighteen
positions.  So short a gram is common in a large corpus.  What a window is known by is therefore its key: the hash of its
minimizer with the bytes beside it, twice as many in all, before it or after it, whichever side the window has.  Each
shard sends its distinct keys, as packed numbers in a few rows, to buckets by value; a bucket answers which of them
occur in several documents.  Only runs of windows with such a key go on: each shard sends its distinct runs, with the
smallest document that has them, to the bucket of their minimizer.

A bucket's runs are the shards of the suffix sort: blocks of bounded size get a suffix array each by Larsson-Sadakane
refinement and common prefixes with the neighbour in Kasai's order, in numpy.  Windows that agree share the smallest
document, and blocks are merged by binary search in each other's sorted windows.  The answer, one bit per window, goes
back to the shards, which cut their texts.  Strings are compared by their bytes; hashes only route.

Documents are shuffled once; all steps are one plan that reads this shuffle again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lodestar.llm.common import LAST_ID, entries_of_maps, fresh, maps_of_entries, quoted
from lodestar.llm.text_arrays import as_bytes, binary_array, mix

WINDOW = 50
GRAM = 16
#: Bits of a minimizer's hash: 40 keep false candidates rare.
HASH_BITS = 40
#: A shard has a 4096th of all text, but at least and at most so many bytes.
SHARD_BYTES = (8 << 20, 128 << 20)
#: At least so many buckets, so that a hash fits 32 bits inside its bucket; one for so many bytes of text.
LEAST_BUCKETS = 256
BUCKET_BYTES = 256 << 20
#: Bytes that are hashed together, and bytes of a block of the suffix sort.
STEP_BYTES = 64 << 10
BLOCK_BYTES = 1 << 20

_U64 = np.uint64


# ---- text of a shard


class Shard:
    """The texts of a shard in the order of their ids, and their runs of windows with equal minimizers and keys."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        data, offsets = as_bytes(table.column("text"))
        ids = table.column("doc_id").to_numpy().astype(np.int64)
        order = sorted(range(len(ids)), key=lambda i: (ids[i], data[offsets[i] : offsets[i + 1]].tobytes()))
        self.rows = np.array(order, np.int64)
        lengths = np.diff(offsets)[self.rows]
        self.ids = ids[self.rows]
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.data = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in order]) if order else data
        # runs: minimizer, key, row, first window, number of windows
        self.value, self.key, self.first, self.count = _runs(self.data, self.offsets, window)
        self.row = np.searchsorted(self.offsets, self.first, "right") - 1

    def take(self, chosen: np.ndarray) -> None:
        self.value, self.key, self.first, self.count, self.row = (
            x[chosen] for x in (self.value, self.key, self.first, self.count, self.row)
        )

    def join(self) -> None:
        """Make one run of neighbours in a text with the same minimizer, whatever their keys."""
        head = ~_goes_on(self.row, self.first, self.count, self.value)
        at = np.flatnonzero(head)
        count = np.add.reduceat(self.count, at) if len(at) else self.count
        self.take(at)
        self.count = count


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number in their order."""
    view = np.ndarray((max(len(data) - 7, 0),), ">u8", np.ascontiguousarray(data).data if len(data) else b"", 0, (1,))
    return view.astype(_U64)


def _goes_on(row: np.ndarray, first: np.ndarray, count: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Whether a run follows its predecessor in the same text without a gap and is equal to it in ``same``."""
    out = np.zeros(len(first), bool)
    out[1:] = (row[1:] == row[:-1]) & (first[:-1] + count[:-1] == first[1:])
    for x in same:
        out[1:] &= x[1:] == x[:-1]
    return out


def _runs(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of neighbouring windows of one text with the same minimizer and key: minimizer, key, first window,
    number of windows."""
    span = window - GRAM + 1
    half = span // 2  # a window has so many bytes before its minimizer, or else so many after it
    place = _U64(64 - HASH_BITS)
    values, keys, firsts, counts = [], [], [], []
    lengths = np.diff(offsets)
    for start in range(0, max(len(data) - window + 1, 0), STEP_BYTES):
        piece = data[start : start + STEP_BYTES + window - 1]
        n = len(piece) - window + 1
        word = _eight(piece)
        gram = mix(word[: len(word) - GRAM + 8] * _U64(0x9E3779B97F4A7C15) + word[GRAM - 8 :]) >> place
        gram = (gram << place) | np.arange(len(gram), dtype=_U64)  # of equal hashes the first
        low, width = gram, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:n], low[span - width : span - width + n])
        # windows that lie inside one text
        a, b = np.searchsorted(offsets, [start, start + n], "right")
        inside = np.zeros(n + 1, np.int32)
        for k in range(a - 1, min(b, len(lengths))):
            if lengths[k] >= window:
                inside[max(offsets[k] - start, 0)] += 1
                inside[min(max(offsets[k + 1] - window + 1 - start, 0), n)] -= 1
        inside = np.cumsum(inside[:-1]) > 0
        new = inside.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
        begins = offsets[a - 1 : b] - start
        begins = begins[(begins >= 0) & (begins < n)]
        new[begins] = inside[begins]
        at = np.flatnonzero(new)
        total = np.concatenate([[0], np.cumsum(inside)])
        # a run ends where the next begins or its text has no more windows, and turns where its windows change sides
        last = at + np.diff(total[np.append(at, n)])
        turn = (low[at] & _U64((1 << (64 - HASH_BITS)) - 1)).astype(np.int64) - half + 1
        at = np.sort(np.concatenate([at, turn[(turn > at) & (turn < last)]]))
        count = np.diff(total[np.append(at, n)])
        where = (low[at] & _U64((1 << (64 - HASH_BITS)) - 1)).astype(np.int64)
        where -= np.where(where - at >= half, half, 0)
        key = np.zeros(len(at), _U64)
        for k in [*range(0, GRAM + half - 8, 8), GRAM + half - 8]:
            key = mix((key + word[where + k]) * _U64(0x9E3779B97F4A7C15))
        key >>= place
        value = low[at] >> place
        row = np.searchsorted(offsets, at + start, "right")
        head = np.flatnonzero(~_goes_on(row, at, count, value, key))  # a minimizer may stand in a window several times
        values.append(value[head])
        keys.append(key[head])
        firsts.append(at[head] + start)
        counts.append(np.add.reduceat(count, head) if len(head) else count)
    if not values:
        return np.zeros(0, _U64), np.zeros(0, _U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value, key, first, count = map(np.concatenate, (values, keys, firsts, counts))
    value = mix(value) >> place  # smallest hashes are small: scrambled, they fill the buckets evenly
    # join what the step borders have cut
    row = np.searchsorted(offsets, first, "right")
    head = np.flatnonzero(~_goes_on(row, first, count, value, key))
    return value[head], key[head], first[head], np.add.reduceat(count, head) if len(head) else count


def _buckets(value: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash: equal ranges of values, so sorted hashes are in the order of their buckets."""
    return (value * _U64(n)) >> _U64(HASH_BITS)


def _floor(bucket: int, n: int) -> int:
    """The smallest hash of a bucket."""
    return -(-(bucket << HASH_BITS) // n)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The sections of equal numbers in a sorted array."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.concatenate([[0], edges]), np.append(edges, len(bucket)), strict=True):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def _squeezed(data: bytes) -> bytes:
    """Compressed, after its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _packed_hashes(hashes: np.ndarray) -> bytes:
    """Ascending hashes of a bucket, counted from its floor, as their differences: all first bytes, all second ones, ..."""
    steps = np.diff(hashes, prepend=hashes.dtype.type(0)).astype("<u4")
    return _squeezed(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked_hashes(data: bytes) -> np.ndarray:
    steps = np.frombuffer(_unsqueezed(data), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype="<u4")


# ---- step 1 and 2: keys that several documents have


def _announce(table: pa.Table, window: int, buckets: int) -> pa.Table:
    """Distinct keys of a shard, by bucket: their distance from its floor, and whether several ids have them."""
    shard = Shard(table, window)
    owner = shard.ids[shard.row]
    order = np.argsort(shard.key, kind="stable")  # owners ascend with the rows
    key, owner = shard.key[order], owner[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(key)) - 1
    several = owner[head] != owner[tail] if len(head) else np.zeros(0, bool)
    key = key[head]
    number = table.column("shard")[0].as_py() if table.num_rows else 0
    out = [
        (b, number, _packed_hashes(key[s] - _U64(_floor(b, buckets))), np.packbits(several[s]).tobytes())
        for b, s in _parts(_buckets(key, buckets))
    ]
    return _table(out, ["bucket", "shard", "hashes", "several"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _agree(table: pa.Table) -> pa.Table:
    """What each shard has of the keys that occur in several documents."""
    lists = [_unpacked_hashes(x) for x in table.column("hashes").to_pylist()]
    flags = [
        np.unpackbits(np.frombuffer(x, np.uint8))[: len(h)].astype(bool)
        for x, h in zip(table.column("several").to_pylist(), lists, strict=True)
    ]
    every, first = np.unique(np.concatenate(lists), return_inverse=True)
    seen = np.bincount(first, minlength=len(every))
    shared = (seen > 1) | (np.bincount(first, np.concatenate(flags), len(every)) > 0)
    mine = np.split(shared[first], np.cumsum([len(x) for x in lists])[:-1])
    bucket = table.column("bucket")[0].as_py()
    out = [
        (number, bucket, _packed_hashes(h[keep]), 0)
        for number, h, keep in zip(table.column("shard").to_pylist(), lists, mine, strict=True)
        if keep.any()
    ]
    return _table(out, ["shard", "bucket", "payload", "kind"], [pa.int64(), pa.int64(), pa.binary(), pa.int32()])


# ---- step 3: runs that may repeat


def _suspects(shard: Shard, answers: pa.Table, buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Keep a shard's runs with shared keys, joined where they meet in a minimizer; their distinct strings in bucket
    order, each one's bucket and smallest document, and the string of each run."""
    known = [
        _unpacked_hashes(p).astype(_U64) + _U64(_floor(b, buckets))
        for b, p in sorted(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))
    ]
    shared = np.concatenate(known) if known else np.zeros(0, _U64)
    place = np.minimum(np.searchsorted(shared, shard.key), max(len(shared) - 1, 0))
    shard.take(np.flatnonzero(shared[place] == shard.key) if len(shared) else np.zeros(0, np.int64))
    shard.join()
    order = np.argsort(shard.value, kind="stable")
    shard.take(order)
    whole, ends = shard.data.tobytes(), shard.first + shard.count + shard.window - 1
    runs = [whole[a:b] for a, b in zip(shard.first.tolist(), ends.tolist(), strict=True)]
    coded = pa.array(runs, pa.large_binary()).dictionary_encode()
    del runs, whole
    index = coded.indices.to_numpy()
    strings = coded.dictionary
    lowest = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(lowest, index, shard.ids[shard.row])
    bucket = np.zeros(len(strings), np.int64)
    bucket[index] = _buckets(shard.value, buckets).astype(np.int64)
    return strings, bucket, lowest, index


def _send(table: pa.Table, answers: pa.Table, window: int, buckets: int) -> pa.Table:
    """The distinct suspect strings of a shard, by bucket."""
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["bucket", "shard", "strings", "sizes", "lowest"]
    if not table.num_rows or not answers.num_rows:
        return _table([], names, types)
    strings, bucket, lowest, _ = _suspects(Shard(table, window), answers, buckets)
    data, begins = as_bytes(strings)
    number = table.column("shard")[0].as_py()
    out = [
        (b, number, _squeezed(data[begins[s.start] : begins[s.stop]].tobytes()),
         _squeezed(np.diff(begins[s.start : s.stop + 1]).astype("<u4").tobytes()), _squeezed(lowest[s].astype("<i8").tobytes()))
        for b, s in _parts(bucket)
    ]
    return _table(out, names, types)


# ---- step 4: suffix arrays of a bucket


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` bytes, by Larsson-Sadakane refinement.

    Sorted by eight bytes at first; then the members of each group that is not yet settled are sorted by the group of
    the suffix that follows after the depth sorted so far, which doubles it.  Groups of one are never touched again.
    """
    n = len(data)
    key = _eight(np.concatenate([data, np.zeros(7, np.uint8)]))
    order = np.argsort(key, kind="stable")
    group = np.zeros(n + 1, np.int64)  # the last entry stands for the end, before all others
    head = np.append(True, key[order][1:] != key[order][:-1])
    group[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    sorted_depth = 8
    while sorted_depth < depth:
        edges = np.flatnonzero(np.append(head, True))
        big = np.repeat(np.diff(edges) > 1, np.diff(edges))
        open_ = np.flatnonzero(big)
        if not len(open_):
            break
        at = order[open_]
        follow = group[np.minimum(at + sorted_depth, n)]
        own = group[at]
        again = np.lexsort((follow, own))
        at, follow, own = at[again], follow[again], own[again]
        order[open_] = at
        new = np.append(True, (own[1:] != own[:-1]) | (follow[1:] != follow[:-1]))
        head[open_] = new
        group[at] = np.maximum.accumulate(np.where(new, open_, 0)) + 1
        sorted_depth *= 2
    return order


def common_prefix_reaches(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares ``length`` bytes with its predecessor in ``order``.

    Kasai's array, cut off at ``length``: every suffix is compared to its predecessor, eight bytes at a time and only
    while they agree.
    """
    word = _eight(np.concatenate([data, np.zeros(length + 8, np.uint8)]))
    same = np.zeros(len(order), bool)
    at = np.arange(1, len(order))
    for k in [*range(0, length - 7, 8), length - 8]:
        at = at[word[order[at] + k] == word[order[at - 1] + k]]
    same[at] = True
    return same


def _window_owners(data: np.ndarray, begins: np.ndarray, lowest: np.ndarray, window: int):
    """Windows of a block in sorted order: their positions, the number of each one's group, and each group's lowest id."""
    usable = np.zeros(len(data) + 1, np.int32)
    usable[begins[:-1]] += 1
    np.add.at(usable, np.maximum(begins[1:] - window + 1, begins[:-1]), -1)
    usable = np.cumsum(usable[:-1]) > 0
    order = suffix_array(data, window)
    order = order[usable[order]]
    owner = lowest[np.searchsorted(begins, order, "right") - 1]
    same = common_prefix_reaches(data, order, window)
    group = np.cumsum(~same) - 1
    low = np.minimum.reduceat(owner, np.flatnonzero(~same)) if len(order) else owner
    return order, group, low


def _windows_at(data: np.ndarray, positions: np.ndarray, window: int) -> np.ndarray:
    view = np.ndarray((len(data) - window + 1,), f"S{window}", np.ascontiguousarray(data).data, 0, (1,))
    return view[positions]


def _smallest_owner(data: np.ndarray, begins: np.ndarray, lowest: np.ndarray, window: int, block_bytes: int) -> np.ndarray:
    """For every position where a window begins, the smallest document with that window (elsewhere the largest id).

    Strings go to blocks in the order of their minimizers, so only blocks that meet in a minimizer can share windows.
    """
    value, _, first, _ = _runs(data, begins, window)
    value = value[np.searchsorted(first, begins[:-1])]  # the windows of a string have one minimizer
    order = np.argsort(value, kind="stable")
    size = np.diff(begins)[order]
    value, lowest = value[order], lowest[order]
    ends = np.concatenate([[0], np.cumsum(size)])
    back = begins[:-1][order] - ends[:-1]  # from the place among the ordered strings to the one in ``data``
    whole = data.tobytes()
    ordered = np.frombuffer(b"".join(whole[begins[k] : begins[k + 1]] for k in order), np.uint8)
    del whole
    blocks, first = [], 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + block_bytes, "right")) - 1)
        part = ordered[ends[first] : ends[last]]
        at, group, low = _window_owners(part, ends[first : last + 1] - ends[first], lowest[first:last], window)
        distinct = _windows_at(part, at[np.flatnonzero(np.diff(group, prepend=-1))], window)
        blocks.append((ends[first] + at, group, low, distinct, value[first], value[last - 1]))
        first = last
    out = np.full(len(data), np.iinfo(np.int64).max)
    for i, (at, group, low, mine, least, most) in enumerate(blocks):
        low = low.copy()
        for j, (_, _, other_low, other, other_least, other_most) in enumerate(blocks):
            if i != j and other_least <= most and least <= other_most:
                place = np.searchsorted(mine, other)
                hit = np.flatnonzero(mine[np.minimum(place, len(mine) - 1)] == other)
                low[place[hit]] = np.minimum(low[place[hit]], other_low[hit])
        out[at + back[np.searchsorted(ends, at, "right") - 1]] = low[group]
    return out


def _judge(table: pa.Table, window: int, block_bytes: int) -> pa.Table:
    """For each shard of a bucket, a bit for every window of its strings: some smaller document has it too."""
    names, types = ["shard", "bucket", "payload", "kind"], [pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    sizes = [np.frombuffer(_unsqueezed(x), "<u4").astype(np.int64) for x in table.column("sizes").to_pylist()]
    size = np.concatenate(sizes)
    lowest = np.concatenate([np.frombuffer(_unsqueezed(x), "<i8") for x in table.column("lowest").to_pylist()])
    data = np.frombuffer(b"".join(map(_unsqueezed, table.column("strings").to_pylist())), np.uint8)
    coded = binary_array(data, np.concatenate([[0], np.cumsum(size)])).dictionary_encode()
    index = coded.indices.to_numpy()
    low = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(low, index, lowest)
    distinct, begins = as_bytes(coded.dictionary)
    owner = _smallest_owner(distinct, begins, low, window, block_bytes)
    windows = size - window + 1
    ends = np.concatenate([[0], np.cumsum(windows)])
    bits = owner[np.repeat(begins[index] - ends[:-1], windows) + np.arange(ends[-1])] < np.repeat(lowest, windows)
    out, k, bucket = [], 0, table.column("bucket")[0].as_py()
    for number, own in zip(table.column("shard").to_pylist(), sizes, strict=True):
        part = bits[ends[k] : ends[k + len(own)]]
        k += len(own)
        out.append((number, bucket, np.packbits(part).tobytes(), 1))
    return _table(out, names, types)


# ---- step 5: cutting


def _cut(table: pa.Table, side: pa.Table, window: int, buckets: int, extra: list[str], as_text: bool) -> pa.Table:
    """Remove from the texts of a shard what smaller documents have; ``side`` has the answers of both kinds."""
    shard = Shard(table, window)
    gone = np.zeros(len(shard.data) + 1, np.int32)
    kinds = side.column("kind").to_numpy() if side.num_rows else np.zeros(0)
    answers = side.filter(pa.array(kinds == 0))
    if answers.num_rows:
        strings, bucket, lowest, index = _suspects(shard, answers, buckets)
        _, begins = as_bytes(strings)
        windows = np.diff(begins) - window + 1
        ends = np.concatenate([[0], np.cumsum(windows)])
        bits = np.zeros(ends[-1], bool)
        verdicts = side.filter(pa.array(kinds == 1))
        verdicts = dict(zip(verdicts.column("bucket").to_pylist(), verdicts.column("payload").to_pylist(), strict=True))
        for b, s in _parts(bucket):
            n = ends[s.stop] - ends[s.start]
            bits[ends[s.start] : ends[s.stop]] = np.unpackbits(np.frombuffer(verdicts[b], np.uint8))[:n]
        later = shard.ids[shard.row] > lowest[index]  # this shard itself has the string in a smaller document
        at = np.repeat(ends[index] - np.concatenate([[0], np.cumsum(shard.count)])[:-1], shard.count) + np.arange(shard.count.sum())
        hit = bits[at] | np.repeat(later, shard.count)
        where = np.repeat(shard.first - np.concatenate([[0], np.cumsum(shard.count)])[:-1], shard.count) + np.arange(shard.count.sum())
        where = where[hit]
        np.add.at(gone, where, 1)
        np.add.at(gone, where + window, -1)
    gone = np.cumsum(gone[:-1]) > 0
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    starts = shard.offsets[:-1][shard.offsets[:-1] < len(gone)]
    edge[starts] = gone[starts]
    stays = np.concatenate([[0], np.cumsum(~gone)])
    n_edges = np.concatenate([[0], np.cumsum(edge)])
    kept = binary_array(shard.data[~gone], stays[shard.offsets]).cast(pa.binary())
    if as_text:
        kept = pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())
    first = np.flatnonzero(edge)
    stop = np.flatnonzero(gone & np.append(~gone[1:], True)) + 1 if len(gone) else first
    # spans never go on into the next text
    borders = shard.offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(gone))]
    borders = borders[gone[borders - 1] & gone[borders]] if len(borders) else borders
    stop = np.unique(np.concatenate([stop, borders]))
    begin = shard.offsets[np.searchsorted(shard.offsets, first, "right") - 1] if len(first) else first
    spans = pa.ListArray.from_arrays(
        pa.array(n_edges[shard.offsets], pa.int32()),
        pa.StructArray.from_arrays([pa.array(first - begin), pa.array(stop - first)], ["start", "length"]),
    )
    n = np.diff(shard.offsets)
    back = table.take(pa.array(shard.rows))
    return pa.table(
        [back.column(c) for c in extra]
        + [pa.array(n), pa.array(n - np.diff(stays[shard.offsets])), spans, pa.chunked_array([kept])],
        [*extra, "n_bytes", "n_removed", "spans", "kept"],
    )


def without_repeats(
    docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, as_text: bool = False
) -> DataFrame:
    """Cut repeated passages: every row with all its columns but ``text``, and ``n_bytes``, ``n_removed``, ``spans``
    (start and length of each removed run, in bytes) and ``kept`` (the remaining bytes; ``as_text`` a string, in which
    characters that a cut has split are left out).

    Texts are taken as UTF-8 bytes, a null text as empty; texts shorter than a window stay whole.  Rows with the same
    ``doc_id`` do not count as repeats of each other; a missing id counts as the largest.  Strings are judged on the
    input.  An empty table gives no rows.  Columns of the input named like the new ones are left out.
    """
    new = {"text", "n_bytes", "n_removed", "spans", "kept"}
    extra = [f for f in docs.schema.fields if f.name.lower() not in new]
    names = [f"c{k}" for k in range(len(extra))]
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    shard_bytes = min(max(total // 4096, SHARD_BYTES[0]), SHARD_BYTES[1])
    shards, buckets = -(-total // shard_bytes), max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"),
        order.alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *(entries_of_maps(quoted(f.name), f.dataType).alias(n) for f, n in zip(extra, names, strict=True)),
    )
    by_shard = dealt.groupBy("shard")

    def announce(table: pa.Table) -> pa.Table:
        return _announce(table, window, buckets)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _send(table, answers, window, buckets)

    def judge(table: pa.Table) -> pa.Table:
        return _judge(table, window, block_bytes)

    def cut(table: pa.Table, side: pa.Table) -> pa.Table:
        return _cut(table, side, window, buckets, names, as_text)

    side = "shard long, bucket long, payload binary, kind int"
    heard = by_shard.applyInArrow(announce, "bucket long, shard long, hashes binary, several binary")
    shared = heard.groupBy("bucket").applyInArrow(_agree, side)
    sent = by_shard.cogroup(shared.groupBy("shard")).applyInArrow(
        send, "bucket long, shard long, strings binary, sizes binary, lowest binary"
    )
    judged = sent.groupBy("bucket").applyInArrow(judge, side)
    spans = ArrayType(StructType().add("start", "long").add("length", "long"))
    schema = StructType([dealt.schema[n] for n in names]).add("n_bytes", "long").add("n_removed", "long")
    schema = schema.add("spans", spans).add("kept", "string" if as_text else "binary")
    done = by_shard.cogroup(shared.unionByName(judged).groupBy("shard")).applyInArrow(cut, schema)
    back = (maps_of_entries(F.col(n), f.dataType).alias(f.name) for f, n in zip(extra, names, strict=True))
    return done.select(*back, "n_bytes", "n_removed", "spans", "kept")


def cut_texts(docs: DataFrame) -> DataFrame:
    """The same rows and columns with what ``without_repeats`` leaves as ``text`` (and ``n_chars`` counted anew)."""
    taken = {"n_bytes", "n_removed", "spans", "kept"}
    own = {c: fresh(docs, f"_{c}") if c.lower() in taken else c for c in docs.columns}
    cut = without_repeats(docs.select(*(quoted(c).alias(name) for c, name in own.items())), as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*(new.get(c, quoted(name)).alias(c) for c, name in own.items()))
