"""Exact deduplication by deterministic block naming.

A document's normalised text is cut into blocks of a fixed number of characters.  Blocks are sorted and named: the
name of a block is the first place (document, row, block number) that holds it.  Then the names of adjacent blocks
are named as pairs, again and again, until each document has one name.  Names are found by comparing whole keys, so
equal names mean equal texts.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LAST_ID, SPACE, first_place, missing_as_empty, rows_of, with_group_size
from lodestar.plans.staging import staged

#: Code points of a block.  Most documents are one block; the rounds of pair naming grow with the log of the longest.
BLOCK_CHARS = 4096


def normalised(name: str = "text"):
    """Runs of white space become one space; a missing text counts as empty."""
    return F.regexp_replace(missing_as_empty(name), f"[{SPACE}]+", " ")


def block_names(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Name every row's text: ``_row`` (a number of the row), ``doc_id``, ``sha256``, ``rounds``, ``name``."""
    cut = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("_row"), normalised().alias("_text")
    ).select(
        "doc_id",
        "_row",
        F.sha2("_text", 256).alias("sha256"),
        # an empty text is one empty block
        F.when(F.col("_text") == "", F.array(F.lit("")))
        .otherwise(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
        .alias("_blocks"),
    )
    place = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), "_row", "no")
    blocks = cut.select(
        "doc_id", "_row", "sha256", F.size("_blocks").alias("n"), F.posexplode("_blocks").alias("no", "_block")
    ).select(
        "doc_id", "_row", "no", "n", F.when(F.col("no") == 0, F.col("sha256")).alias("sha256"), "_block",
        place.alias("_place"),
    )
    level = staged(first_place(blocks, ["_block"], "_place", "name").drop("_place"))
    done = [level.where("n = 1").select("doc_id", "_row", "sha256", F.lit(0).alias("rounds"), "name")]
    heads = level.where("n > 1 AND no = 0").select("doc_id", "_row", "sha256")
    longest = level.agg(F.max("n")).first()[0] or 1
    level, rounds = level.where("n > 1").drop("sha256"), 0
    while longest > 1:
        rounds += 1
        even = F.col("no") % 2 == 0
        pairs = level.groupBy("doc_id", "_row", F.floor(F.col("no") / 2).cast("int").alias("no")).agg(
            F.ceil(F.first("n") / 2).cast("int").alias("n"),
            F.max(F.when(even, F.col("name"))).alias("_left"),
            F.max(F.when(~even, F.col("name"))).alias("_right"),
        )
        level = staged(
            first_place(pairs.withColumn("_place", place), ["_left", "_right"], "_place", "name").drop("_place")
        )
        named = level.where("n = 1").select("_row", F.lit(rounds).alias("rounds"), "name")
        done.append(heads.join(named, "_row").select("doc_id", "_row", "sha256", "rounds", "name"))
        level, longest = level.where("n > 1"), -(-longest // 2)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Group equal texts: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` for every row.

    Texts are equal when they are identical after replacing each run of white space by one space.  The row with the
    smallest ``doc_id`` stays.  A null text counts as empty.  Of repeated rows with the same id and text one stays; a
    row without id stays only if no row of its group has one.  An empty table gives an empty result; other columns
    are ignored.
    """
    names = block_names(docs, block_chars).withColumn(
        "_place", F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), "_row")
    )
    kept = first_place(names, ["rounds", "name"], "_place", "_first")
    kept = kept.select("doc_id", "_row", "sha256", F.col("_first._row").alias("_kept"), F.col("_first.doc").alias("_doc"))
    return with_group_size(kept, "_kept").select(
        "doc_id",
        F.when(F.col("_doc") != LAST_ID, F.col("_doc")).alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_kept")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows that ``exact_groups`` keeps, with all their columns; one row per kept id and text."""
    kept = exact_groups(docs, block_chars).where("kept").withColumnRenamed("text_sha256", "digest")
    return rows_of(docs, kept, F.sha2(normalised(), 256))
