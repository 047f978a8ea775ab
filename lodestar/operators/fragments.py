"""Judge prompts of any size, as placed fragments.

The prompt of a set is never one cell: its head, each of its pairs and its tail are rows with the place of their first
character.  Joined in the order of ``part`` they are the prompt.  Places come from the sizes of blocks of consecutive
pairs, so a set that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.text import fill
from lodestar.operators.evaluate import ANSWER_JUDGE, DESCRIPTION_JUDGE, WITH_NULLS

# Consecutive pair ids of one block.
BLOCK = 10_000


def answer_fragments(numbered: DataFrame, project: str, block: int = BLOCK) -> DataFrame:
    """The one prompt over ``numbered(pair_id, query, response)``: (part, start, fragment); no pairs, no prompt."""
    pair = F.struct("pair_id", F.col("query").alias("question"), F.col("response").alias("answer"))
    head, tail = (fill(t, project=project) for t in _around(ANSWER_JUDGE, "<qa_pair>"))
    items = numbered.select(F.lit(0).alias("set"), "pair_id", F.to_json(pair, WITH_NULLS).alias("item"))
    heads = items.select("set").limit(1).select("set", head.alias("head"))
    return placed(items, heads, tail, block).drop("set")


def description_fragments(numbered: DataFrame, project: str, block: int = BLOCK) -> DataFrame:
    """One prompt per pull request over ``numbered(pair_id, pr, response)``: (pr_id, part, start, fragment).

    The pull request itself stands in the head, as its row with the smallest pair id has it.  Rows without ``pr.id``
    are one set.
    """
    pair = F.struct("pair_id", F.col("response").alias("description"))
    before, after = _around(DESCRIPTION_JUDGE, "<generated_descriptions>")
    items = numbered.select(F.col("pr.id").alias("set"), "pair_id", F.to_json(pair, WITH_NULLS).alias("item"))
    prs = numbered.groupBy(F.col("pr.id").alias("set")).agg(F.min_by("pr", "pair_id").alias("pr"))
    heads = prs.select("set", fill(before, project=project, pull_request=F.to_json("pr", WITH_NULLS)).alias("head"))
    return placed(items, heads, fill(after, project=project), block).withColumnRenamed("set", "pr_id")


def placed(items: DataFrame, heads: DataFrame, tail: Column, block: int = BLOCK) -> DataFrame:
    """``items(set, pair_id, item)`` and ``heads(set, head)`` -> (set, part, start, fragment).

    Per set: the head, the items by pair id as a bracketed list, and ``tail``.  Pair ids are unique; starts count code
    points.
    """
    own = F.col("set").eqNullSafe(F.col("_set"))
    rows = items.withColumn("block", F.floor(F.col("pair_id") / block))
    sizes = rows.groupBy("set", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("item") + 1).alias("size"))
    earlier = W.partitionBy("set").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sofar = lambda name, window: F.coalesce(F.sum(name).over(window), F.lit(0))
    head = heads.select(F.col("set").alias("_set"), "head", F.length("head").cast("bigint").alias("head_size"))
    blocks = sizes.join(head.drop("head"), own).select(
        F.col("set").alias("_set"),
        F.col("block").alias("_block"),
        sofar("n", earlier).alias("n_before"),
        (F.col("head_size") + sofar("size", earlier)).alias("at"),
        "n",
        "size",
    )
    inside = W.partitionBy("set", "block").orderBy("pair_id")
    numbered = rows.withColumn("no", F.row_number().over(inside)).withColumn(
        "offset", sofar(F.length("item") + 1, inside.rowsBetween(W.unboundedPreceding, -1))
    )
    part = F.col("n_before") + F.col("no")
    middle = numbered.join(blocks, own & (F.col("block") == F.col("_block"))).select(
        "set",
        part.alias("part"),
        (F.col("at") + F.col("offset")).alias("start"),
        F.concat(F.when(part == 1, "[").otherwise(","), "item").alias("fragment"),
    )
    zero = F.lit(0).cast("bigint")
    first = head.select(F.col("_set").alias("set"), zero.alias("part"), zero.alias("start"), F.col("head").alias("fragment"))
    ends = blocks.groupBy(F.col("_set").alias("set")).agg(
        (F.max(F.col("n_before") + F.col("n")) + 1).alias("part"), F.max(F.col("at") + F.col("size")).alias("start")
    )
    last = ends.withColumn("fragment", F.concat(F.lit("]"), tail))
    return first.unionByName(middle).unionByName(last)


def write_fragments(fragments: DataFrame, path: str, *keys: str) -> None:
    """Store fragments in the order of the prompts, many files a set: files by name, then rows, give every prompt."""
    order = [*keys, "part"]
    fragments.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def prompt(fragments: DataFrame) -> Iterator[str]:
    """The fragments of one prompt in order, a partition at a time, for a client that sends it piece by piece."""
    ordered = fragments.select("part", "fragment").repartitionByRange("part").sortWithinPartitions("part")
    for row in ordered.toLocalIterator():
        yield row.fragment


def _around(template: str, mark: str) -> list[str]:
    return template.split(mark)
