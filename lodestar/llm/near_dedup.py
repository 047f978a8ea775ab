"""MinHash near-duplicate groups with odd sketches.

A document is the set of its distinct word shingles.  MinHash samples of the set give band keys, and are folded into a
parity bitmap (odd sketch): each sample flips one bit, so the XOR of two bitmaps has few bits where the sets are alike,
and its population count estimates high similarities well.  Documents that share a band key are candidates; the bitmaps
sort out those far below the threshold and the full sets decide.

Nothing is paired within a group at large.  Equal sets are one node.  In a first round each member of a band key is
compared to one leader of that key: the member that shares most keys with others, which in a group of near copies is
their common origin.  The confirmed links give components.  In a second round only those keys are looked at again that
still hold several components: their members outside the largest one are compared to all other members, in tiles of
bounded size inside tasks, and only links that join components come out.  Two members of one key are then in one
component, or their sets have been compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LAST_ID, first_place, rows_of, text_digest
from lodestar.llm.components import components
from lodestar.llm.text_arrays import as_bytes, lower_words, mix, packed, slices, small_binary
from lodestar.plans.staging import staged

SHINGLE_WORDS = 5
#: Linked are sets with PERCENT * union <= 100 * intersection.
PERCENT = 80
#: A pair at the threshold shares no band with probability (1 - 0.8**5)**32, 3 in a million; pairs above it rarer.
BANDS = 32
BAND_SAMPLES = 5
SKETCH_BITS = 1024
#: Bitmaps that estimate less than this are no candidates: over six standard deviations below the threshold.
LEAST_ESTIMATE = 0.6
#: Members on either side of a tile of the second round.
TILE = 512

_U32, _U64 = np.uint32, np.uint64
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 2**32, BANDS * BAND_SAMPLES, dtype=_U32) | _U32(1)
_TERMS = _RANDOM.integers(0, 2**32, BANDS * BAND_SAMPLES, dtype=_U32)


def shingle_sets(texts: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after the other, and where each set begins."""
    words, first = lower_words(*as_bytes(texts))
    coded = words.dictionary_encode()
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), _U64, len(coded.dictionary))
    h = mix(hashed + _U64(0x9E3779B97F4A7C15))[coded.indices.to_numpy()] if len(words) else np.zeros(0, _U64)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    # a shingle begins at each word that has enough words after it; a shorter text is one shingle of all its words
    begins = np.flatnonzero(np.arange(len(h)) - first[doc] <= np.maximum(n[doc] - size, 0))
    full = np.minimum(n[doc[begins]], size)
    value = np.zeros(len(begins), _U64)
    for k in range(size):
        has = full > k
        value[has] = mix(value[has] * _U64(3) + h[begins[has] + k] + _U64(k))
    owner = doc[begins]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def samples(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """MinHash samples of non-empty sets: one row each."""
    out = np.empty((len(begins) - 1, len(_FACTORS)), _U32)
    short = (values >> _U64(32)).astype(_U32)
    first = 0
    while first < len(begins) - 1:  # as many sets at a time as fit the processor's cache
        last = max(first + 1, int(np.searchsorted(begins, begins[first] + 32768, "right")) - 1)
        part, starts = short[begins[first] : begins[last]], begins[first:last] - begins[first]
        for k, (a, b) in enumerate(zip(_FACTORS, _TERMS, strict=True)):
            out[first:last, k] = np.minimum.reduceat(part * a + b, starts)
        first = last
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(BANDS, dtype=_U64), (len(found), 1))
    for k in range(BAND_SAMPLES):
        keys = mix(keys * _U64(0x9E3779B97F4A7C15) + found[:, k::BAND_SAMPLES].astype(_U64) + _U64(1))
    return keys.view(np.int64)


def odd_sketches(found: np.ndarray) -> np.ndarray:
    """Parity bitmaps as rows of 64-bit numbers."""
    n, k = found.shape
    bit = mix(found.astype(_U64) + (np.arange(k, dtype=_U64) << _U64(32))) % _U64(SKETCH_BITS)
    flat = (np.arange(n)[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel()
    parity = (np.bincount(flat, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return np.packbits(parity, axis=1).view(np.int64)


def most_bits(estimate: float = LEAST_ESTIMATE) -> int:
    """The population count of the XOR that corresponds to a similarity: n/2 (1 - (1 - 2/n) ** (2k (1 - J)))."""
    flips = 2 * BANDS * BAND_SAMPLES * (1 - estimate)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips))


def _describe(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "row", "digest", "n_shingles", "key", "bands", "sketch"]
    for batch in batches:
        for part in slices(batch, "text"):
            values, begins = shingle_sets(part.column("text"), words)
            n = np.diff(begins)
            some = np.flatnonzero(n)
            found = samples(values, np.append(begins[some], begins[-1]))
            keys, sketches = band_keys(found), odd_sketches(found)
            full = np.zeros(len(n), np.int64)
            full[some] = 1
            at = np.concatenate([[0], np.cumsum(full)])
            digests = [
                hashlib.md5(values[a:b].tobytes()).digest() if b > a else None
                for a, b in zip(begins[:-1], begins[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row"),
                    part.column("digest"),
                    pa.array(n.astype(np.int64)),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at * keys.shape[1], pa.int32()), pa.array(keys.ravel())),
                    pa.ListArray.from_arrays(pa.array(at * sketches.shape[1], pa.int32()), pa.array(sketches.ravel())),
                ],
                names,
            )


def described(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id``, ``row``, ``digest`` (of the text), ``n_shingles``, ``key`` (a digest of the set), ``bands`` and ``sketch`` of every row."""

    def describe(batches):
        return _describe(batches, words)

    return docs.select(
        F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), text_digest().alias("digest"), "text"
    ).mapInArrow(
        describe,
        "doc_id long, row long, digest string, n_shingles long, key binary, bands array<long>, sketch array<long>",
    )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            values, begins = shingle_sets(part.column("text"), words)
            sets = small_binary(packed(values, begins))
            right = [
                hashlib.md5(values[a:b].tobytes()).digest() == k
                for a, b, k in zip(begins[:-1], begins[1:], part.column("key").to_pylist(), strict=True)
            ]
            out = pa.RecordBatch.from_arrays([part.column("node"), sets], ["node", "items"])
            yield out.filter(pa.array(right, pa.bool_()))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = np.frombuffer(a, _U64), np.frombuffer(b, _U64)
            place = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
            both = int((y[place] == x).sum()) if len(y) else 0
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _alike(n: Column, m: Column, s: Column, t: Column) -> Column:
    """Sizes allow the similarity and the bitmaps do not speak against it."""
    bits = F.aggregate(F.zip_with(s, t, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (bits <= most_bits())


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node`` and its full set (``items``) for the wanted nodes, stored."""

    def sets_of(batches):
        return _sets(batches, words)

    keyed = nodes.select("doc_id", "node", "key").join(wanted, "node")
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), "text")
    found = text.join(keyed, "doc_id").select("node", "key", "text").mapInArrow(sets_of, "node long, items binary")
    return staged(found.dropDuplicates(["node"]))


def _confirmed(nodes: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (u, v) of nodes whose bitmaps and then full sets are similar enough, stored."""
    u, v = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "uv")
    likely = staged(
        pairs.join(u, "u").join(v, "v").where(_alike(*map(F.col, ("n_u", "n_v", "s_u", "s_v")))).select("u", "v")
    )
    full = likely.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v"
    )
    return staged(full.select("u", "v", "a", "b").mapInArrow(_confirm, "u long, v long"))


def _band_members(nodes: DataFrame) -> DataFrame:
    """Members of every band key that has several: ``band``, ``node``, ``n`` members; stored."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    sizes = staged(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return staged(rows.join(sizes, "band").select("band", "node", "n"))


def _stars(members: DataFrame) -> DataFrame:
    """Each member of a band key with the key's leader, the member with most companions over all its keys."""
    companions = staged(members.groupBy("node").agg(F.sum("n").alias("companions")))
    leaders = staged(
        members.join(companions, "node")
        .groupBy("band")
        .agg(F.max_by("node", F.struct("companions", -F.col("node"))).alias("leader"))
    )
    led = members.join(leaders, "band").where("node <> leader")
    return led.select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()


def _tile(table: pa.Table) -> pa.Table:
    """Links from a tile's seeking members to its other members: one to each component that they reach.

    The other members' sets are inverted once; a seeking set then finds its intersections with all of them at a time.
    """
    node, component = (table.column(c).to_numpy() for c in ("node", "component"))
    seeking = table.column("seeking").to_numpy(zero_copy_only=False)
    data, offsets = as_bytes(table.column("items"))
    items, begins = np.frombuffer(data.tobytes(), _U64), offsets // 8
    size = np.diff(begins)
    others, seekers = np.flatnonzero(~seeking), np.flatnonzero(seeking)
    us, vs = [], []
    if len(others):
        owner = np.repeat(np.arange(len(others)), size[others])
        held = np.concatenate([items[begins[k] : begins[k + 1]] for k in others])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        for k in seekers:
            own = items[begins[k] : begins[k + 1]]
            first, last = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
            n = last - first
            at = np.repeat(first - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(others))
            linked = np.flatnonzero(
                (100 * both >= PERCENT * (size[others] + size[k] - both)) & (component[others] != component[k])
            )
            _, one = np.unique(component[others][linked], return_index=True)
            found = node[others[linked[one]]]
            us.append(np.maximum(found, node[k]))
            vs.append(np.minimum(found, node[k]))
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    return pa.table([pa.array(u), pa.array(v)], ["u", "v"])


def _left_over(members: DataFrame, sets: DataFrame, linked: DataFrame) -> DataFrame:
    """Confirmed links between different components that share a band key of three or more members.

    Keys with the same largest component are taken together, so members meet once and not once per key.
    """
    many = members.where("n > 2").select("band", "node")
    labelled = staged(
        many.join(linked, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    )
    parts = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = staged(
        parts.groupBy("band")
        .agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"), F.count(F.lit(1)).alias("k"))
        .where("k > 1")
        .select("band", "main")
    )
    around = staged(labelled.join(mixed, "band").select("main", "node", "component").distinct())
    sizes = staged(
        around.groupBy("main").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("component") != F.col("main")).alias("n_seeking"))
    )
    rows = around.join(sizes, "main")
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    blocks = F.ceil(F.col("n_seeking") / TILE).cast("int")
    at = lambda k: F.pmod(F.xxhash64("node"), k).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    shared = ["main", "node", "component"]
    looked_at = rows.select(*shared, at(chunks).alias("j"), all_of(blocks).alias("i"), F.lit(False).alias("seeking"))
    seeking = rows.where("component <> main").select(
        *shared, at(blocks).alias("i"), all_of(chunks).alias("j"), F.lit(True).alias("seeking")
    )
    tiles = looked_at.unionByName(seeking).join(sets, "node")
    return tiles.groupBy("main", "i", "j").applyInArrow(_tile, "u long, v long").distinct()


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Group near-duplicates: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and ``digest`` for every row.

    Words are runs without white space, A-Z in lower case; a text with fewer words than a shingle is one shingle.

    A null or blank text has no shingles and is linked with nothing.  ``component_id`` is the smallest id reachable;
    ``kept`` marks the row with that id (of repeated rows one).  Rows without id are told apart but come last, and
    their component has a null id if no row in it has one.  Other columns are ignored; an empty table gives none.
    """
    rows = staged(described(docs, words))
    ids = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), "row")
    keyed = rows.where("n_shingles > 0").select("doc_id", "row", "key", ids.alias("place"))
    classes = staged(first_place(keyed, ["key"], "place", "first").select("doc_id", "row", F.col("first.row").alias("node"), "first"))
    nodes = staged(
        rows.where("n_shingles > 0").join(classes.where("row = node").select("row", "node"), "row").select(
            F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "node", "key", F.col("n_shingles").alias("n"), "bands", "sketch"
        )
    )
    members = _band_members(nodes)
    sets = _sets_of(docs, nodes, members.select("node").distinct(), words)
    links = _confirmed(nodes, sets, _stars(members))
    linked = staged(components(links))
    more = staged(_left_over(members, sets, linked))
    if more.take(1):
        linked = staged(components(links.union(more)))
    joined = classes.join(linked, "node", "left").withColumn("top", F.coalesce("component", "node"))
    places = nodes.select(F.col("node").alias("member"), "doc_id").join(
        linked.select(F.col("node").alias("member"), "component"), "member"
    )
    tops = staged(
        places.groupBy("component").agg(F.min(F.struct(F.col("doc_id").alias("doc"), F.col("member").alias("row"))).alias("lowest"))
    )
    tops = tops.withColumnRenamed("component", "top")
    grouped = joined.join(tops, "top", "left").select("row", F.coalesce("lowest", "first").alias("lowest"))
    return (
        rows.select("doc_id", "row", "n_shingles", "digest")
        .join(grouped, "row", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("lowest").isNull(), F.col("doc_id"))
            .when(F.col("lowest.doc") != LAST_ID, F.col("lowest.doc"))
            .alias("component_id"),
            F.coalesce(F.col("lowest.row") == F.col("row"), F.lit(True)).alias("kept"),
            "digest",
        )
    )


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows that ``near_groups`` keeps, with all their columns; of rows alike in id and text one stays."""
    return rows_of(docs, near_groups(docs, words).where("kept"), text_digest())
