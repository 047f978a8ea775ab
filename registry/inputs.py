"""The given tables shaped as operator inputs.  Always whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import lines


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ vectors


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector is a query."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def chunk_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Four consecutive chunks form a source."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 4).alias("source_id")
    )


def typed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in ("CODE", "ENRICHMENT", "DOCUMENT", "UNDEFINED")))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), kinds[F.col("label") % 4].alias("content_type"), "embedding"
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Ten consecutive vectors are the sub-queries of four requests of sizes 1, 2, 3 and 4."""
    v, at = F.col("vec_id"), F.col("vec_id") % 10
    part = F.when(at < 1, 0).when(at < 3, 1).when(at < 6, 2).otherwise(3)
    first = F.when(at < 1, 0).when(at < 3, 1).when(at < 6, 3).otherwise(6)
    return table(spark, sf, "embeddings").select(
        v.alias("query_id"),
        (F.floor(v / 10) * 4 + part).alias("request_id"),
        (at - first).cast("int").alias("query_no"),
        "embedding",
    )


# ------------------------------------------------------------------ texts


def plain_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.lit("pdf::"), F.col("doc_id").cast("string")).alias("source_name"), "text"
    )


def structured_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines turned into headings, list items, listings and text, by position."""
    shape = lambda line, i: (
        F.when(i % 7 == 1, F.concat(F.lit("== "), line))
        .when(i % 7 == 3, F.concat(F.lit("=== "), line))
        .when(i % 7 == 4, F.concat(F.lit("==== "), line))
        .when(i % 7 == 5, F.concat(F.lit("* "), line))
        .when(i % 7 == 6, F.concat(F.lit("----\n== "), line, F.lit("\n\nx\n----")))
        .otherwise(line)
    )
    body = F.array_join(F.transform(lines(F.col("text")), shape), "\n\n")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("asciidoc::"), F.col("doc_id").cast("string")).alias("source_name"),
        F.concat(F.lit("= Title\n\n"), body).alias("text"),
    )


def java_files(spark: SparkSession, sf: str) -> DataFrame:
    """A Java file per part: a class with a nested enum and record, brackets hidden in text."""
    pascal = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    package = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    text = F.concat(
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("package com."), package, F.lit(";\n\n"))),
        F.lit("/** A { part. */\npublic class "),
        pascal,
        F.lit(' {\n  String type = "class '),
        F.col("p_type"),
        F.lit(' {";\n  enum Size { S'),
        F.col("p_size").cast("string"),
        F.lit(" }\n  record Price(double value) {}\n}\n"),
    )
    return table(spark, sf, "part").select(
        F.concat(F.lit("cu::Part"), F.col("p_partkey").cast("string"), F.lit(".java")).alias("source_name"),
        text.alias("text"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A class node per pair of neighbouring words of each benchmark text; the first word of
    a text also stands alone in the empty package."""
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "")
    pairs = F.transform(
        F.col("w"),
        lambda w, i: F.when(i == 0, F.concat(F.lit("."), w)).otherwise(
            F.concat(F.lit("com."), F.get(F.col("w"), i - 1), F.lit("."), w)
        ),
    )
    rows = table(spark, sf, "benchmark").select("item_id", "text", words.alias("w"))
    return rows.select("item_id", "text", F.posexplode(pairs).alias("at", "signature")).select(
        F.concat_ws("-", F.col("item_id").cast("string"), F.col("at").cast("string")).alias("node_id"),
        "signature",
        F.col("text").alias("content"),
    )


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("paragraph_id"), F.col("text").alias("content"))


def processed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a label are enriched nodes; good ones are processed."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    text = lambda prefix, c: F.when(F.col("toxic") == 0, F.concat(F.lit(prefix), F.col(c)))
    return docs.select(
        F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("source_id"),
        F.col("text").alias("content"),
        F.concat(F.lit("in "), F.col("lang")).alias("description"),
        text("from ", "source").alias("usage"),
        F.col("n_chars").cast("string").alias("relationship"),
        (F.col("quality") == 1).alias("processed"),
    )


def text_sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("source_id"), F.col("text").alias("content")
    )


# ------------------------------------------------------------------ pull requests and diffs


def pull_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn is a pull request: first line described, other lines changed."""
    hunks = F.transform(
        F.slice(F.col("ls"), 2, F.size("ls")),
        lambda line, i: F.struct(
            F.concat(F.lit("src/F"), i.cast("string"), F.lit(".java")).alias("filepath"), line.alias("content")
        ),
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", lines(F.col("text")).alias("ls"))
    return rows.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.col("role").alias("title"),
        F.col("ls")[0].alias("description"),
        hunks.alias("hunks"),
    )


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines as changed files of a diff; every third file is a mere rename."""
    file = lambda line, i: F.concat(
        F.lit("diff --git a/old/f"), i.cast("string"), F.lit(".txt b/new/f"), i.cast("string"), F.lit(".txt\n"),
        F.when(i % 3 == 2, F.lit("similarity index 100%\n")).otherwise(
            F.concat(F.lit("--- a/old\n+++ b/new\n@@ -1 +1 @@\n-x\n+"), line, F.lit("\n"))
        ),
    )
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("pr_id"),
        F.array_join(F.transform(lines(F.col("text")), file), "").alias("diff"),
    )


# ------------------------------------------------------------------ logs, replies, judgements


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.floor(F.col("value") * 100).cast("string")
    line = F.concat(
        F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] [INFO] Svc."), F.col("event_type"),
        F.lit(": Step "), (F.col("user_id") % 3).cast("string"),
        F.when(F.col("user_id") % 3 == 1, F.lit("\x1e\x1f")).otherwise(""),
        F.when(F.col("event_type") == "error", F.lit(" failed after ")).otherwise(F.lit(" completed in ")),
        ms, F.lit("ms"),
    )
    return table(spark, sf, "events").select(line.alias("line"))


def raw_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies in five shapes: plain JSON, other field name, fenced, prose, broken."""
    k = F.get_json_object("props", "$.k")
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"description":"d'), k, F.lit('","usage":"u","relationship":"r"}')))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"description":"d","exampleUsage":"e'), k, F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('```json\n{"description":"'), k, F.lit('","usage":"f","relationship":"r"}\n```')))
        .when(F.col("event_type") == "signup", F.concat(F.lit("no json "), k))
        .otherwise(F.concat(F.lit('{"description":"'), k))
    )
    return table(spark, sf, "events").select("event_id", raw.alias("raw"))


def judge_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as judge replies: a heading at every fifth id, noise where a text is bad and toxic."""
    d = F.col("doc_id")
    heading = F.when(d % 5 == 0, F.concat(F.lit("[judge "), (d % 3).cast("string"), F.lit("]")))
    reply = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit("cannot tell")).otherwise(
        F.concat(d.cast("string"), F.lit("::"), (1 + F.col("quality") * 3 + F.col("toxic")).cast("string"), F.lit("::because :: so"))
    )
    rows = table(spark, sf, "labels").select(
        F.concat(F.lit("replies-"), (d % 2).cast("string")).alias("file"),
        d,
        F.posexplode(F.array(heading, reply)).alias("at", "line"),
    )
    return rows.filter(F.col("line").isNotNull()).select("file", (F.col("doc_id") * 2 + F.col("at")).alias("line_no"), "line")


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as evaluation results, three configurations in turn."""
    groups = F.array(F.lit("adaptive_full"), F.lit("simple_full"), F.lit("adaptive_plain"))
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("result_no"),
        groups[(d % 3).cast("int")].alias("group"),
        F.concat(F.lit("about "), F.col("source")).alias("query"),
        F.when(d % 7 != 3, F.col("text")).alias("response"),
        F.struct(
            F.col("source").alias("id"),
            F.concat(F.lit("title "), F.col("source")).alias("title"),
            F.lit("d").alias("description"),
            F.array(F.struct(F.lit("f").alias("filepath"), F.lit("+x").alias("content"))).alias("hunks"),
        ).alias("pr"),
    )
