"""Which texts hold which of very many words: an equi-join on the rarest gram of each word, then verification.

A gram is a run of eight bytes, or a whole word of fewer, as one long.  Runs of words are counted over all texts; a word
is keyed by its rarest one and cannot occur where that is missing.  Texts give the keys they hold, the join gives
candidates, and the texts themselves, shuffled once, decide.  Bitmaps of fixed size keep out runs that no word has; what
they let through by chance finds no partner in the join.

Only the first texts by id count for each word, so texts are taken in rounds of ascending ids, each many times larger than
the one before.  A word that has enough texts is settled: later ids are all larger.  So a word in a third of all texts
makes candidates in the first, small rounds alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.plans.staging import staged

GRAM = 8
# Bits of a bitmap of runs: 8 MB in each task, at most a million rows to the driver.
BITMAP_BITS = 26
# Bytes of text looked at together.
CHUNK = 1 << 20
# Shares of all texts up to which the rounds but the last go; they are set by as many ids, any ids give the same rows.
ROUNDS = (1 / 256, 1 / 16)
SAMPLED_IDS = 4096
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier that spreads runs over the bitmap


def rare_gram_matches(pairs: DataFrame, texts: DataFrame, keep: int) -> DataFrame:
    """``pairs(a, b)`` x ``texts(paragraph_id, content)`` -> (a, b, paragraph_id): the ``keep`` first texts that hold word
    ``a`` (b null), for each word of either column, and those that hold both words of a pair.

    The empty word alone is left out; with another word it counts as held.  A null text holds nothing; both sides are
    taken as they are, case included.
    """
    words = pairs.select(F.explode(F.array("a", "b")).alias("word")).where("word IS NOT NULL AND word <> ''").distinct()
    grams = staged(words.mapInArrow(_of_words, "word string, gram long"))
    keyed = staged(_rarest(grams, _counts(texts, grams)))
    units = staged(_units(pairs, keyed))
    found = None
    for part in _rounds(texts):
        if found is not None:
            enough = found.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).count().where(F.col("count") >= keep)
            units = staged(units.join(enough, (F.col("a") == F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")), "left_anti"))
        first = staged(_verified(part, units, keep))
        found = first if found is None else found.unionByName(first)
    return found


def _rounds(texts: DataFrame) -> list[DataFrame]:
    """``texts`` cut at ids, ascending; null ids come first."""
    some = texts.select("paragraph_id").where("paragraph_id IS NOT NULL").orderBy(F.xxhash64("paragraph_id")).limit(SAMPLED_IDS)
    ids = sorted(r.paragraph_id for r in some.collect())
    at, out, rest = F.col("paragraph_id"), [], F.lit(True)
    for cut in [ids[int(len(ids) * share)] for share in ROUNDS if ids]:
        below = at.isNull() | (at < F.lit(cut))
        out.append(texts.where(rest & below))
        rest = ~below
    return [*out, texts.where(rest)]


def _verified(texts: DataFrame, units: DataFrame, keep: int) -> DataFrame:
    candidates = _held(texts, units).join(units, "gram").select("paragraph_id", "a", "b")
    holds = lambda word: F.col("content").contains(F.col(word))
    found = candidates.join(texts.where("content IS NOT NULL"), "paragraph_id").where(holds("a") & F.coalesce(holds("b"), F.lit(True)))
    first = F.row_number().over(W.partitionBy("a", "b").orderBy("paragraph_id"))
    return found.select("a", "b", "paragraph_id").withColumn("_r", first).where(F.col("_r") <= keep).drop("_r")


def _units(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """What is looked for, (a, b, gram): each word alone and each pair, by the rarer key of its words."""
    alone = keyed.select(F.col("word").alias("a"), F.lit(None).cast("string").alias("b"), "gram")
    side = lambda name: keyed.select(F.col("word").alias(name), F.col("gram").alias(f"_{name}"), F.col("n").alias(f"_n{name}"))
    both = pairs.where("a <> '' OR b <> ''").distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    both = both.where("(a = '' OR _a IS NOT NULL) AND (b = '' OR _b IS NOT NULL)")
    rarer = F.when(F.col("_a").isNull() | (F.col("_nb") < F.col("_na")), F.col("_b")).otherwise(F.col("_a"))
    return alone.unionByName(both.select("a", "b", rarer.alias("gram")))


def _rarest(grams: DataFrame, counted: DataFrame) -> DataFrame:
    """(word, gram, n) of words all of whose runs occur."""
    known = grams.join(counted, "gram", "left").select("word", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("k"))
    return known.groupBy("word").agg(F.min("k").alias("k")).where("k.n > 0").select("word", "k.gram", "k.n")


def _counts(texts: DataFrame, grams: DataFrame) -> DataFrame:
    bitmap, lengths = _bitmap(grams), _lengths(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, runs in _runs(batch.column(0), lengths):
                found, n = np.unique(runs[_known(runs, bitmap.value)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["gram", "n"])

    return texts.select("content").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _held(texts: DataFrame, units: DataFrame) -> DataFrame:
    """(paragraph_id, gram): the keys that each text holds, once each."""
    bitmap, lengths = _bitmap(units), _lengths(units)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, runs in _runs(batch.column(1), lengths):
                known = _known(runs, bitmap.value)
                some, number = np.unique(runs[known], return_inverse=True)
                row, number = np.divmod(np.unique(rows[known] * max(1, len(some)) + number), max(1, len(some)))
                ids = batch.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(some[number])], ["paragraph_id", "gram"])

    kind = texts.schema["paragraph_id"].dataType.simpleString()
    # a text of several chunks may give a key more than once
    return texts.select("paragraph_id", "content").mapInArrow(held, f"paragraph_id {kind}, gram long").distinct()


def _lengths(grams: DataFrame) -> set[int]:
    """The lengths of runs in use, at most eight; a run that ends in zero bytes equals the one without them."""
    used = grams.select(F.ceil(F.length(F.hex("gram")) / 2).alias("n")).distinct()
    return {int(r.n) for r in used.collect()}


def _bitmap(grams: DataFrame):
    """Broadcast bitmap of the runs in ``gram``."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slot(batch.column(0).to_numpy(zero_copy_only=False))
            bits = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(bits)], ["slot", "bits"])

    rows = grams.select("gram").mapInArrow(slots, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return grams.sparkSession.sparkContext.broadcast(bitmap)


def _slot(runs: np.ndarray) -> np.ndarray:
    return (runs.view(np.uint64) * SPREAD) >> np.uint64(64 - BITMAP_BITS)


def _known(runs: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = _slot(runs)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, gram): all runs of eight bytes, or the word itself."""
    for batch in batches:
        words = batch.column(0)
        _, offsets = _bytes(words)
        size = np.diff(offsets)
        for length in range(1, GRAM + 1):
            for rows, runs in _runs(words, {length}):
                own = size[rows] >= GRAM if length == GRAM else size[rows] == length
                yield pa.RecordBatch.from_arrays([words.take(pa.array(rows[own])), pa.array(runs[own])], ["word", "gram"])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _runs(texts: pa.Array, lengths: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, run) of all runs of the given lengths, one chunk and length at a time; a run stays inside its text."""
    if not len(texts):
        return
    data, offsets = _bytes(texts)
    for start in range(0, len(data), CHUNK):
        n = min(CHUNK, len(data) - start)
        part = np.zeros(n + GRAM, np.uint8)
        ahead = data[start : start + n + GRAM]
        part[: len(ahead)] = ahead
        at = np.arange(start, start + n)
        row = np.searchsorted(offsets, at, side="right") - 1
        left = offsets[row + 1] - at
        run = np.zeros(n, np.uint64)
        for k in range(1, GRAM + 1):
            run |= part[k - 1 : k - 1 + n].astype(np.uint64) << np.uint64(8 * (k - 1))
            if k in lengths:
                inside = left >= k
                yield row[inside], run[inside].view(np.int64)
