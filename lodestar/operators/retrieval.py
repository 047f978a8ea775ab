"""From chunk hits to ranked sources: roll-up, fixed-k and adaptive-k cuts, late text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the cuts.
QUERY_CHARS = 8000  # longest query text the embedding model is given
FIXED_EXTRA = 20  # chunks fetched beyond k by the fixed cut
ADAPTIVE_FETCH = 500  # chunks fetched by the adaptive cut
ADAPTIVE_BUFFER = 5
# Chunk tables of at most so many rows travel to the hits, which outnumber them by far and stay where they are.
SHIPPED_CHUNKS = 1_000_000
HIGH_CONFIDENCE = 0.6
LOW_CONFIDENCE = 0.3


def truncate_query(queries: DataFrame, query: str = "query", limit: int = QUERY_CHARS) -> DataFrame:
    """Add ``embedding_text`` (at most ``limit`` characters, null stays null) and ``truncated``.

    Only what the embedding model sees is shortened; ``query`` itself is untouched.
    """
    text = F.col(query)
    return queries.withColumn("embedding_text", F.substring(text, 1, limit)).withColumn(
        "truncated", F.coalesce(F.length(text) > limit, F.lit(False))
    )


def attach_sources(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Give every hit its source; hits on unknown chunks vanish.

    ``chunks`` should be a stored table, since it is counted first.
    """
    sources = chunks.select("chunk_id", "source_id")
    return hits.join(F.broadcast(sources) if sources.count() <= SHIPPED_CHUNKS else sources, "chunk_id")


def rollup(hits: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(query_id, source_id, chunk_ids, score): best chunk score per source, never below 0."""
    return hits.groupBy(*by, "source_id").agg(
        F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"),
        F.greatest(F.lit(0.0), F.max("score")).alias("score"),
    )


def _ranked(sources: DataFrame, by: tuple[str, ...]) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc("score"), F.asc("source_id"))
    return sources.withColumn("rank", F.row_number().over(w))


def fixed_k(sources: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The ``k`` best sources per query (fewer if the roll-up left fewer)."""
    return _ranked(sources, by).filter(F.col("rank") <= k)


def _with_optimal_k(sources: DataFrame, by: tuple[str, ...], high: float, low: float) -> DataFrame:
    """Add ``rank``, ``optimal_k`` and the list length ``_n``."""
    by_rank = W.partitionBy(*by).orderBy(F.desc("score"), F.asc("source_id"))
    whole = W.partitionBy(*by)
    score, after = F.col("score"), F.col("_after")
    gapped = (
        sources.withColumn("rank", F.row_number().over(by_rank))
        .withColumn("_after", F.lead("score").over(by_rank))
        .withColumn("_gap", F.when(after.isNotNull() & (score < high) & (score >= low), F.round(score - after, 6)))
    )
    measured = (
        gapped.withColumn("_n", F.count("*").over(whole))
        .withColumn("_widest", F.max("_gap").over(whole))
        .withColumn("_confident", F.count_if((score >= high) & after.isNotNull()).over(whole))
    )
    at_gap = F.when((F.col("_gap") == F.col("_widest")) & (F.col("_widest") > 0), F.col("rank"))
    optimal = F.coalesce(F.min(at_gap).over(whole), F.col("_confident")).cast("int")
    return measured.withColumn("optimal_k", optimal).drop("_after", "_gap", "_widest", "_confident")


def adaptive_k(
    sources: DataFrame,
    k: int,
    by: tuple[str, ...] = ("query_id",),
    buffer: int = ADAPTIVE_BUFFER,
    high: float = HIGH_CONFIDENCE,
    low: float = LOW_CONFIDENCE,
) -> DataFrame:
    """Cut each ranked list at its largest score gap, then keep ``buffer`` more, at most ``k``.

    Sources at or above ``high`` always count as relevant; gaps are looked for only among
    scores in [low, high); the last source never opens a gap; the first largest gap wins.
    """
    measured = _with_optimal_k(sources, by, high, low)
    return measured.filter(F.col("rank") <= F.least(F.col("optimal_k") + buffer, F.lit(k), F.col("_n"))).drop("_n")


# The cuts by name: (chunks to fetch for k sources, cut).
STRATEGIES = {
    "fixed": (lambda k: k + FIXED_EXTRA, fixed_k),
    "adaptive": (lambda k: ADAPTIVE_FETCH, adaptive_k),
}


def retrieve(hits: DataFrame, chunks: DataFrame | None, strategy: str, k: int) -> DataFrame:
    """Roll hits up to sources and cut; hits beyond the strategy's fetch size are ignored.

    Hits that carry their ``source_id`` need no chunk table and stay partitioned by query
    from the search to the cut: no further shuffle.
    """
    fetch, cut = STRATEGIES[strategy]
    near = hits.filter(F.col("rank") <= fetch(k))
    if "source_id" not in near.columns:
        near = attach_sources(near, chunks)
    return cut(rollup(near.select("query_id", "chunk_id", "source_id", "score")), k)


def retrieve_all(hits: DataFrame, groups: list[tuple[str, str, int]]) -> DataFrame:
    """Roll up and cut the same hits under several (group, strategy, k) in one pass.

    ``hits(query_id, chunk_id, source_id, score, rank)`` -> adds ``group`` and ``k``.
    """
    configs = F.array(
        *(
            F.struct(
                F.lit(group).alias("group"),
                F.lit(strategy).alias("strategy"),
                F.lit(k).alias("k"),
                F.lit(STRATEGIES[strategy][0](k)).alias("fetch"),
            )
            for group, strategy, k in groups
        )
    )
    each = hits.select("query_id", "chunk_id", "source_id", "score", "rank", F.explode(configs).alias("_c"))
    near = each.filter(F.col("rank") <= F.col("_c.fetch")).select(
        "query_id", "chunk_id", "source_id", "score", "_c.group", "_c.strategy", "_c.k"
    )
    lists = rollup(near, ("query_id", "group", "strategy", "k"))
    measured = _with_optimal_k(lists, ("query_id", "group"), HIGH_CONFIDENCE, LOW_CONFIDENCE)
    cut = F.when(F.col("strategy") == "fixed", F.col("k")).otherwise(
        F.least(F.col("optimal_k") + ADAPTIVE_BUFFER, F.col("k"), F.col("_n"))
    )
    return measured.filter(F.col("rank") <= cut).select(
        "group", "query_id", "source_id", "chunk_ids", "score", "rank", "k"
    )


def attach_content(retrieved: DataFrame, sources: DataFrame) -> DataFrame:
    """Bring in names and texts after the cut, when only the kept sources are left."""
    return retrieved.join(sources.select("source_id", "source_name", "content"), "source_id")
