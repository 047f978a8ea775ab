"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list[str | Column], items: str | Column, pos: str, item: str) -> DataFrame:
    """One row per array item with its 0-based position.

    The outer form is used and empty arrays are filtered out afterwards: for the inner form
    Catalyst adds a ``size(items) > 0`` filter below the explode, which would compute a
    costly ``items`` expression a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())
