"""The trie of conversation prefixes, by ROLLUP over positional columns of turn ids.

A conversation becomes rows of ``COLUMNS`` turn ids, one row per block of turns.  One ROLLUP over these columns groups
by every prefix of a block at once, and grouping_id tells the depth.  Long conversations go on in further blocks, keyed
by the node in which the block before ended.  What a subtree holds is a sum over the conversations through its top, so a
second ROLLUP over the shared part of the trie gives the subtree figures, without walking from node to node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import HOT_KEYS, missing_as_empty, partitions
from lodestar.plans.staging import staged

#: Turns of a block.
COLUMNS = 8
#: Blocks of a conversation that one window task adds up.
RUN = 4096
#: Bytes of written ids that are handed on as one row.
CHUNK = 8192

KEY = ["depth", "k1", "k2"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Each turn's digest and size, numbered within its conversation from 0: (conv_id, pos, turn: id and size).

    Turns are taken by number, null first, those with the same number by role and digest; null roles and texts count as
    empty, rows without ``conv_id`` are left out.  The numbering sorts digests, not texts, by range; places are counted
    per range, so one conversation may hold any share of the rows.
    """
    role = missing_as_empty("role")
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, missing_as_empty("text"))
    rows = staged(
        conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long"),
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("id"),
            F.octet_length(missing_as_empty("text")).cast("long").alias("size"),
        )
    )
    order = ["conv_id", "turn", "role", "id"]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order)
    ranged = staged(ranged.withColumn("part", F.spark_partition_id()))
    here = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "role", "id")) - 1
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    spans = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = ranged.withColumn("here", here).join(spans, ["conv_id", "part"])
    return placed.select("conv_id", "part", (F.col("before") + F.col("here")).alias("pos"), F.struct("id", "size").alias("turn"))


def regrown(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: each conversation c begins with the first h turns of c - c % ``family`` (all
    if fewer, none if absent) and goes on with its own turns after its first h; h is crc32(c) % ``most``.

    -> (conv_id, pos, turn) and the ids of all conversations, also of those left without turns.
    """
    turns = staged(turns)
    h = lambda c: F.crc32(c.cast("string")) % most
    base = lambda c: c - c % family
    own = F.col("conv_id")
    parts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    bases = sizes.select(own.alias("base"), F.col("n").alias("n_base"))
    shifts = sizes.withColumn("base", base(own)).join(bases, "base", "left")
    shift = F.least(h(own), F.coalesce("n_base", F.lit(0)))
    shifts = shifts.select("conv_id", shift.alias("shift"))
    late = turns.where(F.col("pos") >= h(own)).join(parts.join(shifts, "conv_id").drop("n"), ["conv_id", "part"])
    late = late.select("conv_id", (F.col("pos") - h(own) + F.col("shift")).alias("pos"), "turn")
    near = F.sequence(own - (family - 1), own + (family - 1))
    early = turns.where((F.col("pos") < most - 1) & (base(own) == own)).withColumn("heir", F.explode(near))
    early = early.where((base(F.col("heir")) == own) & (F.col("pos") < h(F.col("heir"))))
    early = early.select(F.col("heir").alias("conv_id"), "pos", "turn").join(sizes, "conv_id", "left_semi")
    return late.unionByName(early), sizes.select("conv_id")


def _digest(*columns: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def _turns(n: int) -> list[Column]:
    return [F.col(f"t{i}") for i in range(1, n + 1)]


def block_rows(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per conversation and block: ``n`` turns t1 ..., whether ``more`` follow, the key of the node before the
    block, and the bytes before it.

    A node's key are two 64-bit digests of its turns, block by block, joined by XOR: they are known from the rows of one
    conversation alone, and sums over runs of blocks put together give them for conversations of any length.  (A pair of
    different prefixes has the same key with a probability of 2**-128.)  Conversations without turns have one empty row.
    """
    block, slot = F.floor(F.col("pos") / COLUMNS), F.col("pos") % COLUMNS
    rows = turns.groupBy("conv_id", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct(slot.alias("slot"), F.col("turn").alias("turn")))).alias("turns")
    )
    rows = rows.select(
        "conv_id", "block", F.size("turns").alias("n"), *(F.get("turns", F.lit(i - 1))["turn"].alias(f"t{i}") for i in range(1, COLUMNS + 1))
    )
    bytes_here = sum((F.coalesce(t["size"], F.lit(0)) for t in _turns(COLUMNS)), F.lit(0))
    d1, d2 = _digest(F.col("block"), *_turns(COLUMNS))
    rows = rows.withColumns({"d1": d1, "d2": d2, "bytes": bytes_here, "run": F.floor(F.col("block") / RUN)})
    rows = staged(rows)
    total = lambda w: [
        F.coalesce(F.bit_xor("d1").over(w), F.lit(0)).alias("x1"),
        F.coalesce(F.bit_xor("d2").over(w), F.lit(0)).alias("x2"),
        F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("before"),
    ]
    runs = rows.groupBy("conv_id", "run").agg(
        F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("bytes").alias("bytes"), F.max("block").alias("top")
    )
    by_run = Window.partitionBy("conv_id").orderBy("run")
    earlier = by_run.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "conv_id",
        "run",
        "top",
        F.lead("run").over(by_run).isNotNull().alias("goes_on"),
        *(c.alias(f"run_{n}") for c, n in zip(total(earlier), ("x1", "x2", "before"))),
    )
    inside = Window.partitionBy("conv_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    keyed = rows.select("*", *total(inside)).join(runs, ["conv_id", "run"])
    keyed = keyed.select(
        "conv_id",
        "block",
        "n",
        (F.col("goes_on") | (F.col("block") < F.col("top"))).cast("int").alias("more"),
        F.col("x1").bitwiseXOR(F.col("run_x1")).alias("p1"),
        F.col("x2").bitwiseXOR(F.col("run_x2")).alias("p2"),
        (F.col("before") + F.col("run_before")).alias("before"),
        *_turns(COLUMNS),
    )
    turn = rows.schema["t1"].dataType.simpleString()
    zero = F.lit(0).cast("long")
    empty = conversations.join(rows.where("block = 0").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id",
        zero.alias("block"),
        F.lit(0).alias("n"),
        F.lit(0).alias("more"),
        *(zero.alias(c) for c in ("p1", "p2", "before")),
        *(F.lit(None).cast(turn).alias(f"t{i}") for i in range(1, COLUMNS + 1)),
    )
    return keyed.unionByName(empty)


def _rolled_up(rows: DataFrame, figures: str) -> DataFrame:
    """Group the blocks by all their prefixes: ``level`` turns of the block are those of the node."""
    turns = ", ".join(f"t{i}" for i in range(1, COLUMNS + 1))
    found = rows.sparkSession.sql(
        f"SELECT block, p1, p2, before, {turns}, {COLUMNS} - bit_count(grouping_id()) AS level, {figures} "
        f"FROM {{rows}} GROUP BY block, p1, p2, before, ROLLUP ({turns})",
        rows=rows,
    )
    last = F.coalesce(*(F.when(F.col("level") == i, F.col(f"t{i}").isNotNull()) for i in range(1, COLUMNS + 1)))
    return found.where(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(last))


def _by_level(of) -> Column:
    out = of(0)
    for i in range(1, COLUMNS + 1):
        out = F.when(F.col("level") == i, of(i)).otherwise(out)
    return out


def _key(which: int, level: int) -> Column:
    """The key of the node that a block's first ``level`` turns lead to."""
    prior = F.col(f"p{which}")
    if not level:
        return prior
    rest = [F.lit(None).cast("struct<id: binary, size: bigint>")] * (COLUMNS - level)
    return prior.bitwiseXOR(_digest(F.col("block"), *_turns(level), *rest)[which - 1])


def _keys() -> list[Column]:
    depth = F.col("block") * COLUMNS + F.col("level")
    return [depth.alias("depth"), *(_by_level(lambda i, w=w: _key(w, i)).alias(f"k{w}") for w in (1, 2))]


def _bytes_before(level: int) -> Column:
    """Bytes of all turns of a node but its last."""
    return sum((t["size"] for t in _turns(max(level - 1, 0))), F.col("before"))


def _nodes(rows: DataFrame) -> DataFrame:
    found = _rolled_up(rows, f"count(*) AS n_convs, min(conv_id) AS conv_id, max(block * {COLUMNS} + n + more) AS longest")
    parent = [_by_level(lambda i, w=w: _key(w, max(i - 1, 0))).alias(f"parent_k{w}") for w in (1, 2)]
    return found.select(*_keys(), *parent, "conv_id", "n_convs", "longest", _by_level(_bytes_before).alias("bytes_before"))


def _owners(nodes: DataFrame) -> DataFrame:
    """Conversations that are the smallest of some node: from which depth on, and how deep their nodes are shared."""
    return nodes.groupBy("conv_id").agg(
        F.min("depth").alias("first"),
        F.min_by(F.struct("parent_k1", "parent_k2", "bytes_before"), "depth").alias("at"),
        F.max(F.when(F.col("n_convs") > 1, F.col("depth"))).alias("shared"),
        (F.max_by("longest", "depth") == F.max("depth")).cast("long").alias("leaf"),
    )


def _subtrees(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Leaves and saved bytes below every node that several conversations share.

    A node belongs to its smallest member, which then has all nodes below it on its path.  So a subtree has as many leaves
    as it has members that end in a leaf of their own, and its saved bytes are, over its members, those of the turns in
    the subtree that belong to someone else.
    """
    bytes_of = lambda level: sum((F.coalesce(t["size"], F.lit(0)) for t in _turns(level)), F.col("before"))
    totals = rows.groupBy("conv_id").agg(F.max(bytes_of(COLUMNS)).alias("total"))
    known = totals.join(owners, "conv_id", "left").select(
        "conv_id",
        F.coalesce("at.bytes_before", "total").alias("others"),  # bytes of the turns that belong to others
        F.when(F.col("first").isNotNull(), F.coalesce("shared", F.col("first") - 1)).alias("shared"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    at = lambda i: F.col("block") * COLUMNS + i
    met = rows.join(known, "conv_id").where(F.coalesce(F.col("shared") > F.col("block") * COLUMNS, F.lit(True)) | (F.col("block") == 0))
    kept = [
        F.when(F.coalesce(F.col("shared") >= at(i), F.lit(True)), F.col(f"t{i}")).alias(f"t{i}")
        for i in range(1, COLUMNS + 1)
    ]
    due = [
        F.greatest(F.col("others") - (bytes_of(max(i - 1, 0))), F.lit(0)).alias(f"due{i}") for i in range(COLUMNS + 1)
    ]
    cut = met.select("block", "p1", "p2", "before", *kept, *due, "leaf")
    sums = ", ".join(f"sum(due{i}) AS due{i}" for i in range(COLUMNS + 1))
    found = _rolled_up(cut, f"sum(leaf) AS n_leaves, {sums}")
    return found.select(*_keys(), "n_leaves", _by_level(lambda i: F.col(f"due{i}")).alias("saved_tokens"))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids as text in chunks, node by node."""
    names = [*KEY, "first", "chunk"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    now, ids, size, rows = None, [], 0, []

    def close():
        if ids:
            rows.append((*now, int(ids[0]), ",".join(ids).encode()))

    def flush():
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for *key, conversation in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now or size >= CHUNK:
                close()
                now, ids, size = key, [], 0
                if len(rows) >= 2000:
                    yield flush()
            ids.append(str(conversation))
            size += len(ids[-1]) + 1
    close()
    yield flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over a node's chunks, which come in order."""
    names, types = [*KEY, "ends_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    now, state, rows = None, None, []

    def flush():
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for *key, _, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if state is not None:
                    rows.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(chunk)
            else:
                state.update(b"," + chunk)
        if len(rows) >= 20_000:
            yield flush()
    if state is not None:
        rows.append((*now, state.hexdigest()))
    yield flush()


def _ends(rows: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end in a node.

    Ids are sorted by range, so the many ids of one node are written by many tasks; SHA-256 has an order of its own, so
    the chunks of a node, a thousandth of its rows, are then streamed through one task that holds a chunk at a time.
    """
    lasts = rows.groupBy("conv_id").agg(F.max("block").alias("block"))
    last = rows.join(lasts, ["conv_id", "block"]).withColumn("level", F.col("n"))
    members = staged(last.select(*_keys(), "conv_id"))
    ranged = members.repartitionByRange(partitions(rows.sparkSession), *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    key = "depth long, k1 long, k2 long"
    chunks = ranged.mapInArrow(_written, f"{key}, first long, chunk binary")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, f"{key}, ends_sha256 string")


def _parents(nodes: DataFrame, owners: DataFrame, children: DataFrame) -> DataFrame:
    """For the first node of each owner its parent's conversation; the nodes with most children are broadcast."""
    asked = owners.where("first > 0").select(
        "conv_id", (F.col("first") - 1).alias("depth"), F.col("at.parent_k1").alias("k1"), F.col("at.parent_k2").alias("k2")
    )
    names = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    hot = children.orderBy(F.desc("n_children"), *KEY).limit(HOT_KEYS).select(*KEY)
    hot = F.broadcast(names.join(F.broadcast(hot), KEY, "left_semi"))  # at most HOT_KEYS rows
    often = asked.join(hot, KEY)
    rarely = asked.join(hot, KEY, "left_anti").join(names, KEY)
    return often.unionByName(rarely).select("conv_id", "parent_conv_id")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every distinct prefix of the conversations, the root (no turn) included: one row per node.

    ``turns(conv_id, pos, turn)`` as from ``turn_rows``, ``conversations(conv_id)`` all ids, also those without turns.  A
    node is named by ``conv_id``, its smallest member, and ``depth``; ``parent_conv_id`` names its parent (null at the
    root), ``n_convs`` counts its members, ``n_children`` the nodes below, ``n_leaves`` the childless nodes of its
    subtree, itself included, ``saved_tokens`` are the bytes that its subtree saves by keeping shared turns once, and
    ``ends_sha256`` is the digest of the ascending ids of the members that end there.  Repeated ids in
    ``conversations`` must not occur; without conversations there is no node.
    """
    rows = staged(block_rows(turns, conversations))
    nodes = staged(_nodes(rows))
    owners = staged(_owners(nodes))
    children = staged(
        nodes.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_k1").alias("k1"), F.col("parent_k2").alias("k2"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    shared = staged(_subtrees(rows, owners).where("n_leaves IS NOT NULL"))
    ends = _ends(rows)
    firsts = owners.select("conv_id", F.col("first").alias("depth")).join(_parents(nodes, owners, children), "conv_id")
    single = F.col("n_convs") == 1
    full = nodes.join(children, KEY, "left").join(shared, KEY, "left").join(ends, KEY, "left")
    return full.join(firsts, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(single, F.lit(1)).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        F.when(single, F.lit(0)).otherwise(F.col("saved_tokens")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
