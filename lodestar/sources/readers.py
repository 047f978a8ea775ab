"""Readers for source trees, documents, pull requests, results and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.schemas import PULL_REQUEST, RESULT_FILE

# Kinds by (lower-cased) file extension and the name prefix of each kind.
KINDS = {".md": "markdown", ".adoc": "asciidoc", ".pdf": "pdf"}
PREFIXES = {"java": "cu", "markdown": "markdown", "asciidoc": "asciidoc", "pdf": "pdf"}
SKIPPED_JAVA = "package-info.java"


def source_name(kind: Column, path: Column) -> Column:
    """``prefix::file name``; ``unknown`` stands in for a missing name."""
    name = F.element_at(F.split(path, "/"), -1)
    named = F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown")).otherwise(name)
    prefix = F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))[kind]
    return F.concat_ws("::", F.coalesce(prefix, kind), named)


def document_kind(path: Column) -> Column:
    """Kind by extension, null for files no extractor takes."""
    name = F.lower(path)
    kind = F.lit(None).cast("string")
    for extension, value in KINDS.items():
        kind = F.when(name.endswith(extension), F.lit(value)).otherwise(kind)
    return kind


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, text string")
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_java(spark: SparkSession, root: str) -> DataFrame:
    """Java files below ``root``: (path, source_type, source_name, text); none if it is missing."""
    files = _whole_files(spark, root, "*.java")
    kept = files.filter(F.element_at(F.split("path", "/"), -1) != SKIPPED_JAVA)
    return kept.select(
        "path", F.lit("java").alias("source_type"), source_name(F.lit("java"), F.col("path")).alias("source_name"), "text"
    )


def scan_docs(spark: SparkSession, path: str) -> DataFrame:
    """All files at or below ``path`` with the kind of their extension (null if unsupported)."""
    files = _whole_files(spark, path).withColumn("source_type", document_kind(F.col("path")))
    name = F.when(F.col("source_type").isNotNull(), source_name(F.col("source_type"), F.col("path")))
    return files.select("path", "source_type", name.alias("source_name"), "text")


def route(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files and ``rejects(path, reason)``.

    PDF files are taken as text that was extracted before; encoded ones are rejected.
    """
    encoded = F.lit(False)
    if "text" in files.columns:
        encoded = F.coalesce((F.col("source_type") == "pdf") & F.col("text").startswith("%PDF-"), F.lit(False))
    reason = F.when(F.col("source_type").isNull(), "unsupported file type").when(encoded, "encoded PDF")
    taken, left = files.filter(reason.isNull()), files.filter(reason.isNotNull())
    return taken, left.select("path", reason.alias("reason"))


def read_pull_requests(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Pull requests from JSON; unknown fields are dropped and numeric ids read as text."""
    return spark.read.schema(PULL_REQUEST).option("multiLine", multi_line).json(path)


def read_eval_results(spark: SparkSession, path: str, task: str, multi_line: bool = True) -> DataFrame:
    """Results of one task: (result_no, task, group, item_id, query, pr, response, duration_ms, documents).

    ``input`` is a question or a pull-request object.  Chunk ids are taken from either of
    the two field names in use.  ``result_no`` grows in file order.
    """
    rows = spark.read.schema(RESULT_FILE).option("multiLine", multi_line).json(path).filter(F.col("task") == task)
    pr = F.when(F.ltrim("input").startswith("{"), F.from_json("input", PULL_REQUEST))
    documents = F.transform(
        F.coalesce("documents", F.array()),
        lambda d: F.struct(
            d["source_name"].alias("source_name"),
            F.coalesce(d["chunk_ids"], d["embedding_ids"]).alias("chunk_ids"),
            d["similarity_score"].alias("similarity_score"),
        ),
    )
    return rows.withColumn("pr", pr).select(
        F.monotonically_increasing_id().alias("result_no"),
        "task",
        "group",
        F.coalesce("pr.id", "input").alias("item_id"),
        F.when(F.col("pr").isNull(), F.col("input")).alias("query"),
        "pr",
        "response",
        F.col("duration").alias("duration_ms"),
        documents.alias("documents"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines: (file, line)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their numbers: (file, line_no, line); each file is one row at first."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    split = files.select("file", F.posexplode(F.split("text", r"\r?\n", -1)).alias("line_no", "line"))
    return split.select("file", (F.col("line_no") + 1).alias("line_no"), "line")
