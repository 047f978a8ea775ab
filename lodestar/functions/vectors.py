"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(df, vec: str, out: str):
    """Add ``out``: ``vec`` scaled to unit length; a zero vector stays zero."""
    with_norm = df.withColumn("_norm", norm(F.col(vec)))
    unit = F.when(
        F.col("_norm") > 0, F.transform(F.col(vec), lambda x: x.cast("double") / F.col("_norm"))
    ).otherwise(F.transform(F.col(vec), lambda x: x.cast("double")))
    return with_norm.withColumn(out, unit).drop("_norm")
