"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: White space between words, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"

#: At most so many keys are spread over several tasks; every other key holds under a thousandth of the rows.
HOT_KEYS = 1000

#: Takes the place of a missing id in comparisons, so that a row without id is never preferred.
LAST_ID = 2**63 - 1


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def first_place(df: DataFrame, keys: list[str], place: str, out: str = "first") -> DataFrame:
    """Add ``out``: the smallest ``place`` among the rows whose ``keys`` are equal (null equals null).

    Equal keys are compared in full, hashes only route them.  The ``HOT_KEYS`` most frequent hashes are spread over
    all tasks by place: their rows find a first place per task, and those few are compared in a second step.  So one
    key may hold a third of all rows.  The keys themselves are dropped from the result.
    """
    n = partitions(df.sparkSession)
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    hot = (
        hashed.groupBy("_hash")
        .count()
        .where("count > 1")
        .orderBy(F.desc("count"), "_hash")
        .limit(HOT_KEYS)
        .select("_hash", F.lit(True).alias("_hot"))
    )
    spread = hashed.join(F.broadcast(hot), "_hash", "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(place), F.lit(n)).cast("int")).otherwise(0)
    )
    same = Window.partitionBy("_hash", "_salt", *keys)
    rest = [c for c in df.columns if c not in keys]
    near = spread.withColumn("_near", F.min(place).over(same))
    hot_rows = spread.where(F.col("_hot")).select("_hash", "_salt", place, *keys)
    leaders = hot_rows.withColumn("_near", F.min(place).over(same)).where(F.col(place) == F.col("_near"))
    moved = leaders.select("_near", F.min("_near").over(Window.partitionBy("_hash", *keys)).alias("_far"))
    return (
        near.select(*rest, "_near")
        .join(moved.distinct(), "_near", "left")
        .select(*rest, F.coalesce("_far", "_near").alias(out))
    )


def missing_as_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def entries_of_maps(value: Column, kind: DataType) -> Column:
    """``value`` with every map in it as an array of its entries, which can be ordered and taken from in Arrow."""
    if not _has_map(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: entries_of_maps(x, kind.elementType))
    if isinstance(kind, StructType):
        fields = [entries_of_maps(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    entry = lambda e: F.struct(e["key"].alias("key"), entries_of_maps(e["value"], kind.valueType).alias("value"))
    return F.transform(F.map_entries(value), entry)


def maps_of_entries(value: Column, kind: DataType) -> Column:
    """What ``entries_of_maps`` was given; ``kind`` is the type with maps."""
    if not _has_map(kind):
        return value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: maps_of_entries(x, kind.elementType))
    if isinstance(kind, StructType):
        fields = [maps_of_entries(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    entry = lambda e: F.struct(e["key"].alias("key"), maps_of_entries(e["value"], kind.valueType).alias("value"))
    return F.map_from_entries(F.transform(value, entry))


def with_group_size(df: DataFrame, key: str, out: str = "group_size") -> DataFrame:
    """Add the number of rows that share ``key`` (a non-negative long).

    The sizes of the ``HOT_KEYS`` largest groups are broadcast; their rows get a key of their own in the join with
    all other sizes, so no task receives a large group.
    """
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_size"))
    hot = sizes.orderBy(F.desc("_size"), "_key").limit(HOT_KEYS).select("_key", F.col("_size").alias("_hot_size"))
    own = F.when(F.col("_hot_size").isNull(), F.col(key)).otherwise(-1 - F.monotonically_increasing_id())
    spread = df.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").drop("_key").withColumn("_own", own)
    return (
        spread.join(sizes, F.col("_own") == F.col("_key"), "left")
        .withColumn(out, F.coalesce("_hot_size", "_size"))
        .drop("_key", "_size", "_hot_size", "_own")
    )


def text_digest(name: str = "text") -> Column:
    return F.md5(missing_as_empty(name))


def rows_of(docs: DataFrame, chosen: DataFrame, digest: Column) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` and ``digest`` are in ``chosen``; one row for each id and digest."""
    own, wanted_id, wanted, rank = (fresh(docs, c) for c in ("_own", "_wanted_id", "_wanted", "_rank"))
    chosen = chosen.select(F.col("doc_id").alias(wanted_id), F.col("digest").alias(wanted))
    same = F.col("doc_id").eqNullSafe(F.col(wanted_id)) & (F.col(own) == F.col(wanted))
    once = Window.partitionBy("doc_id", own).orderBy(*(entries_of_maps(quoted(f.name), f.dataType) for f in docs.schema))
    return (
        docs.withColumn(own, digest)
        .join(chosen, same, "left_semi")
        .withColumn(rank, F.row_number().over(once))
        .where(F.col(rank) == 1)
        .drop(own, rank)
    )
