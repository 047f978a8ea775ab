"""Line deduplication by frequency on a site.

Per host, the pages that contain a line are divided by the host's pages; lines above a share are boilerplate and are
dropped from every page of the host.  DataFrame functions only.  Lines are told apart by 128-bit digests, so their
texts are not shuffled for counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE, missing_as_empty, text_digest
from lodestar.plans.staging import staged

#: Dropped are lines on more than this share of a host's pages, and on at least so many pages.
MAX_SHARE = 0.02
LEAST_PAGES = 5


def _lines(docs: DataFrame) -> DataFrame:
    """One row per page and distinct line that is not blank."""
    told = F.filter(F.split(missing_as_empty(), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("host"),
        F.unhex(text_digest()).alias("page"),
        F.explode(F.array_distinct(F.transform(told, lambda x: F.unhex(F.md5(x))))).alias("line"),
    )


def boilerplate(docs: DataFrame, max_share: float = MAX_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host`` and ``line`` (a digest) of the lines to drop; per host at most its lines per page / ``max_share``."""
    pages = docs.groupBy(F.coalesce("source", F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    found = _lines(docs).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    return found.join(pages, "host").where(F.col("n") > max_share * F.col("pages")).select("host", "line")


def without_boilerplate(docs: DataFrame, max_share: float = MAX_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Drop each host's boilerplate lines: ``doc_id``, ``source``, ``n_lines``, ``n_dropped`` and the remaining ``text``.

    Hosts are values of ``source`` (null counts as empty), pages are rows; repeated rows count each.  Lines are split at
    line feeds and compared whole; blank lines stay.  A null text counts as empty.  Other columns are ignored; an empty
    table gives no rows.
    """
    drop = staged(boilerplate(docs, max_share, least_pages))
    hits = (
        _lines(docs).join(drop, ["host", "line"])
        .groupBy("doc_id", "host", "page")
        .agg(F.collect_set("line").alias("_drop"))
        .withColumnRenamed("doc_id", "_doc")
    )
    pages = docs.select(
        "doc_id", "source", F.coalesce("source", F.lit("")).alias("_host"), F.unhex(text_digest()).alias("_page"),
        missing_as_empty().alias("_text"),
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_host") == F.col("host")) & (F.col("_page") == F.col("page"))
    )
    joined = pages.join(hits, same, "left").withColumn("_lines", F.split("_text", "\n"))
    stay = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.array_contains("_drop", F.unhex(F.md5(x))))
    )
    return joined.withColumn("_stay", stay).select(
        "doc_id",
        "source",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_stay")).cast("long").alias("n_dropped"),
        F.array_join("_stay", "\n").alias("text"),
    )
