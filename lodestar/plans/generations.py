"""Tables that a job replaces as a whole while it reads them: one folder per generation.

A new generation is complete on storage before older ones are removed, and only complete ones are read, so a job that
ends halfway leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.readers import exists

_NAME = "generation="


def _complete(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    numbers = [int(n[len(_NAME) :]) for n in names if n.startswith(_NAME)]
    return sorted(n for n in numbers if exists(spark, f"{path}/{_NAME}{n}/_SUCCESS"))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete generation of a table, None if there is none."""
    found = _complete(spark, path)
    return spark.read.parquet(f"{path}/{_NAME}{found[-1]}") if found else None


def replace(df: DataFrame, path: str) -> DataFrame:
    """Store ``df``, which may read the table's current generation, as the next one; returns it as read back."""
    spark = df.sparkSession
    old = _complete(spark, path)
    new = f"{path}/{_NAME}{old[-1] + 1 if old else 1}"
    df.write.mode("overwrite").parquet(new)
    for n in old:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_NAME}{n}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.read.schema(df.schema).parquet(new)
