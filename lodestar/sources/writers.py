"""Writers: result and audit logs, exports, stage tables and the vector table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.vectors import normalize
from lodestar.sources.readers import exists


def write_log_csv(events: DataFrame, path: str) -> None:
    """Completion events as CSV: timestamp, service, operation, duration_ms."""
    time = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    events.select(time, "service", "operation", "duration_ms").write.option("header", True).csv(path)


def append_results(results: DataFrame, path: str) -> None:
    """Append result rows as JSON lines, one folder per task; earlier rows are not touched."""
    results.write.mode("append").partitionBy("task").json(path)


def append_enrichment_audit(enriched: DataFrame, path: str) -> None:
    """Append what was asked and answered per node; missing texts become ""."""
    text = lambda c: F.coalesce(c, F.lit(""))
    enriched.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "node_id",
        text("prompt").alias("prompt"),
        text("description").alias("description"),
        text("usage").alias("exampleUsage"),
        text("relationship").alias("relationship"),
    ).write.mode("append").json(path)


def save_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a stage table and return it as read back, so later stages start from storage."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_pull_requests(pull_requests: DataFrame, path: str) -> None:
    """Pull requests (id, title, description, hunks) as JSON lines, for ``read_pull_requests(multi_line=False)``."""
    pull_requests.select("id", "title", "description", "hunks").write.mode("overwrite").json(path)


VECTOR_BUCKETS = 64  # parts of an index that are replaced on their own


def _unit_vectors(vectors: DataFrame) -> DataFrame:
    unit = normalize(vectors.select("index_name", "chunk_id", "source_id", "embedding"))
    bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(VECTOR_BUCKETS)).cast("int")
    return unit.withColumn("embedding", F.col("embedding").cast("array<float>")).withColumn("bucket", bucket)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Append ``vectors(index_name, chunk_id, source_id, embedding)`` at unit length, in one pass.

    For ids the table is known to lack; the table is partitioned by index and, inside, by a bucket of the id.
    """
    _unit_vectors(vectors).write.mode("append").partitionBy("index_name", "bucket").parquet(path)


def add_vectors(vectors: DataFrame, path: str) -> None:
    """Add vectors, replacing those whose (index_name, chunk_id) is there already.

    Of repeated ids in ``vectors`` one is taken.  Only the buckets that hold a replaced id are written anew; rows of all
    others are appended.  ``vectors`` should be a stored table, as it is read more than once.
    """
    spark = vectors.sparkSession
    if vectors.isEmpty():
        return
    key, part = ["index_name", "chunk_id"], ["index_name", "bucket"]
    new = _unit_vectors(vectors.dropDuplicates(key))
    if not exists(spark, path):
        return append_vectors(new, path)
    stored = _vector_table(spark, path)
    touched = stored.join(new.select(*key), key, "left_semi").select(*part).distinct()
    kept = stored.join(touched, part, "left_semi").join(new.select(*key), key, "left_anti")
    # The merged buckets are complete on storage before the first old file is replaced.
    stage = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
    merged = save_table(kept.unionByName(new.join(touched, part, "left_semi")), f"{stage}/merged")
    fresh = save_table(new.join(touched, part, "left_anti"), f"{stage}/fresh")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)
    fresh.write.mode("append").partitionBy(*part).parquet(path)
    _delete(spark, stage)


def remove_vectors(ids: DataFrame, path: str) -> None:
    """Remove the vectors of ``ids(index_name, chunk_id)``, a stored table; ids that are not there are left alone.

    Only the buckets that hold such an id are written anew, complete on storage before the old files are replaced.
    """
    spark, key, part = ids.sparkSession, ["index_name", "chunk_id"], ["index_name", "bucket"]
    if not exists(spark, path) or ids.isEmpty():
        return
    stored = _vector_table(spark, path)
    touched = stored.join(ids, key, "left_semi").select(*part).distinct()
    stage = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
    touched = save_table(touched, f"{stage}/touched")
    kept = save_table(stored.join(touched, part, "left_semi").join(ids, key, "left_anti"), f"{stage}/kept")
    emptied = touched.join(kept.select(*part).distinct(), part, "left_anti").collect()  # at most a row per bucket
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)
    for index_name, bucket in emptied:
        _delete(spark, f"{path.rstrip('/')}/index_name={index_name}/bucket={bucket}")
    _delete(spark, stage)


def _vector_table(spark: SparkSession, path: str) -> DataFrame:
    columns = "chunk_id string, source_id string, embedding array<float>, index_name string, bucket int"
    return spark.read.schema(columns).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        files.delete(target, True)


def read_vectors(spark: SparkSession, path: str, index_name: str | None = None) -> DataFrame:
    """The vector table, or one index of it (only its partition is read)."""
    table = _vector_table(spark, path).drop("bucket")
    return table if index_name is None else table.filter(F.col("index_name") == index_name)


def remove_index(spark: SparkSession, path: str, index_name: str) -> None:
    """Drop an index; an absent one is left alone."""
    _delete(spark, f"{path.rstrip('/')}/index_name={index_name}")
