"""Stage tables on the storage that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, as in tests, one beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return folder.rstrip("/")


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to ``path``, or below the shared folder, and read it back.

    What follows starts from stored rows, so a lost executor costs no more than the tasks it ran.  Without a path the
    table is scratch data like a checkpoint and is removed with that folder.
    """
    path = path or f"{shared_folder(df.sparkSession)}/lodestar-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
