"""Completion times from log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed format of a completion line: time, level, service, operation, milliseconds.
COMPLETION = r"\[([\d\-\s:]+)\]\s+\[(\w+)\]\s+([\w\.]+):\s+(.*?)\s+completed in\s+(\d+)ms"
COMPLETION_MARK = "completed in"


def parse_log(log_lines: DataFrame) -> DataFrame:
    """``log_lines(line)`` -> (timestamp, level, service, operation, duration_ms).

    Lines without a completion are dropped; a time that is none becomes null.
    """
    rows = log_lines.filter(F.col("line").contains(COMPLETION_MARK) & F.col("line").rlike(COMPLETION))
    part = lambda i: F.regexp_extract("line", COMPLETION, i)
    return rows.select(
        F.try_to_timestamp(F.trim(part(1)), F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        part(2).alias("level"),
        part(3).alias("service"),
        part(4).alias("operation"),
        part(5).try_cast("bigint").alias("duration_ms"),
    )


def latency_stats(events: DataFrame, by: tuple[str, ...] = ("service", "operation")) -> DataFrame:
    """count, min, max, mean, median and sample deviation per key, ordered by key."""
    ms = F.col("duration_ms")
    stats = events.groupBy(F.concat_ws(":", *by).alias("operation_key")).agg(
        F.count("*").alias("n"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.round(F.avg(ms), 6).alias("avg_ms"),
        F.round(F.median(ms), 6).alias("median_ms"),
        F.round(F.coalesce(F.stddev_samp(ms), F.lit(0.0)), 6).alias("stdev_ms"),
    )
    return stats.orderBy("operation_key")
