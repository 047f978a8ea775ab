"""Extraction and chunking on worked cases and against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import chunking, extract


def packed(spark, value, limit, sep=" "):
    df = spark.createDataFrame([(value,)], "t string").withColumn("l", text.lines(F.col("t")))
    return text.pack(df, "l", "p", limit, sep).first().p


@pytest.mark.parametrize(
    "value, expected",
    [
        ("aaaa\nbbbb\ncccc", ["aaaa bbbb", "cccc"]),
        ("xxxxxxxxxxxxxxx\ny", ["xxxxxxxxxxxxxxx", "y"]),
        ("\n\n", []),
        (" ", [""]),
        ("", [""]),
        ("\n x\t \n", ["x"]),
    ],
)
def test_pack_cases(spark, value, expected):
    assert packed(spark, value, 10) == expected


def test_pack_equals_fold(spark):
    rng = random.Random(1)
    texts = ["\n".join("w" * rng.randint(0, 12) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("l", text.lines(F.col("t")))
    got = {r.i: r.p for r in text.pack(df, "l", "p", 20, " ").select("i", "p").collect()}
    for i, t in enumerate(texts):
        out, held = [], ""
        parts = t.rstrip("\n").split("\n") if t.strip("\n") or not t else []
        for line in parts:
            if held and len(held) + len(line) > 20:
                out.append(held.strip())
                held = ""
            held += line + " "
        assert got[i] == out + ([held.strip()] if held else [])


ADOC = """= Title

intro

== A

a1

[source,java]
----
== not a heading

// kept
x - y
----

// dropped
:attr: dropped

=== A1

x

==== Deep

y

== B

* one

* two
* three

tail
"""


def sections(spark, value, limit=3000):
    df = spark.createDataFrame([("asciidoc::f", value)], "source_name string, text string")
    rows = extract.sections(df, limit).orderBy("section_1", "section_2", "ordinal").collect()
    return [(r.paragraph_name.removeprefix("asciidoc::f::"), r.content) for r in rows]


def test_sections(spark):
    assert sections(spark, ADOC) == [
        ("A::A1::0", "x\n\nDeep\n\ny"),
        ("A::0", "a1\n\n== not a heading\n\n// kept\nx - y"),
        ("B::0", "one\ntwo\nthree\n\n\ntail"),
        ("0", "intro"),
    ]


def test_sections_out_of_sequence(spark):
    assert sections(spark, "=== odd\nx\n== then\n\n==== skip\nz") == [("odd::0", "x"), ("then::skip::0", "z")]


def test_sections_windows_newlines_and_empty(spark):
    assert sections(spark, "== A\r\n\r\nx\r\n\r\ny") == [("A::0", "x\n\ny")]
    assert sections(spark, "") == []


def test_sections_pack(spark):
    assert sections(spark, "aaaa\n\nbbbb\n\ncccc", 10) == [("0", "aaaa\n\nbbbb"), ("1", "cccc")]


def test_section_plan_has_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([("f", ADOC)], "source_name string, text string")
    plan = extract.sections(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


JAVA = '''// license
package a.b;
import x.Y;
/** doc { */
@Ann({1,2})
public class Foo<T> extends Bar {
  String s = "class Fake { ";  char c = '{';
  String tb = """
    class Nope { " }
  """;
  Class<?> k = Foo.class;
  void m() { call(new X() { class Local { } }); record Pt(int x) {} int record = 3; }
  /* interface No {} */
  @interface Skip { int v(); }
  static class Builder { enum E { A { }, B; } }
}
interface I {}
'''


def test_type_declarations(spark):
    files = spark.createDataFrame([("cu::Foo.java", JAVA), ("cu::B.java", "class B { class C { }")], "source_name string, text string")
    rows = extract.type_declarations(files).orderBy("source_name", "pos").collect()
    assert [(r.signature, r.parsed) for r in rows] == [
        (None, False), (".C", False),
        ("a.b.Foo", True), ("a.b.Local", True), ("a.b.Builder", True), ("a.b.I", True), ("a.b.E", True), ("a.b.Pt", True),
    ]
    assert [r.path for r in extract.broken_files(extract.type_declarations(files)).collect()] == ["cu::B.java"]
    code = {r.signature: r.content for r in rows}
    assert code["a.b.Foo"].startswith("/** doc { */\n@Ann({1,2})\npublic class Foo") and code["a.b.Foo"].endswith("} }\n}")
    assert code["a.b.Builder"] == "static class Builder { enum E { A { }, B; } }"
    assert code["a.b.Pt"] == "record Pt(int x) {}"


DIFF = """diff --git a/old.txt b/new.txt
similarity index 100%
diff --git a/p.java b/p.java
--- a/p.java
+++ b/p.java
@@ -1 +1 @@
-a
+b
diff --git a/x b/y b/z
@@ -0,0 +1 @@
+diff --git is only text here
"""


def test_split_diff(spark):
    diffs = spark.createDataFrame([("1", DIFF), ("2", "")], "pr_id string, diff string")
    rows = extract.split_diff(diffs).orderBy("pos").collect()
    assert [(r.pr_id, r.pos, r.filepath, r.content) for r in rows] == [
        ("1", 0, "p.java", "@@ -1 +1 @@\n-a\n+b\n"),
        ("1", 1, "y b/z", "@@ -0,0 +1 @@\n+diff --git is only text here\n"),
    ]
    prs = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert {r.id: len(r.hunks) for r in extract.attach_hunks(prs, diffs).collect()} == {"1": 2, "2": 0, "3": 0}


def test_clean(spark):
    rows = [("a\u0000b\tc\u007f",), ('_serializedATN =\n "x\ny";',), (None,), ("a\r\nb",)]
    df = spark.createDataFrame(rows, "content string")
    assert [r.content for r in chunking.clean_text(df).collect()] == [
        "ab\tc", '_serializedATN = "<ANTLR_SERIALIZED_ATN>";', "", "a\r\nb",
    ]


def test_split_tokens(spark):
    df = spark.createDataFrame([("s", " a b\n c  d e "), ("t", "  "), ("u", " ".join(["w"] * 5000))], "source_id string, content string")
    rows = chunking.split_tokens(df, 2).filter("source_id <> 'u'").orderBy("chunk_no").collect()
    assert [(r.source_id, r.chunk_no, r.content) for r in rows] == [("s", 0, "a b"), ("s", 1, "c  d"), ("s", 2, "e")]
    assert chunking.split_tokens(df, 800).filter("source_id = 'u'").count() == 7


def test_unpivot_takes_processed_nodes_only(spark):
    nodes = spark.createDataFrame(
        [("n1", "code", "d", None, "r", True), ("n2", "code", "d", "u", "r", False)],
        "source_id string, content string, description string, usage string, relationship string, processed boolean",
    )
    paragraphs = spark.createDataFrame([("p1", "text")], "source_id string, content string")
    rows = chunking.chunks(nodes, paragraphs).collect()
    assert {(r.chunk_id, r.content_type, r.content) for r in rows} == {
        ("n1:0:0", "CODE", "code"), ("n1:1:0", "ENRICHMENT", "d"), ("n1:3:0", "ENRICHMENT", "r"), ("p1:0:0", "DOCUMENT", "text"),
    }


def test_wide_token_windows(spark):
    text = "\n ".join(f"t{k}" for k in range(3001)) + "  "
    df = spark.createDataFrame([("s", text), ("b", " \n"), ("n", None)], "source_id string, content string")
    rows = sorted((r.source_id, r.chunk_no, len(r.content.split())) for r in chunking.split_tokens(df, 1500).collect())
    assert rows == [("s", 0, 1500), ("s", 1, 1500), ("s", 2, 1)]


def test_many_small_files_of_one_split_are_dealt_to_tasks(spark):
    digests = F.concat(*(F.sha2(F.concat_ws("-", F.col("id"), F.lit(i)), 512) for i in range(16)))
    text = F.concat(F.lit("/* "), digests, F.lit(" */ class A { enum B {} }"))
    files = spark.range(4_000).coalesce(1).select(F.concat(F.lit("f"), "id").alias("source_name"), text.alias("text"))
    rows = extract.type_declarations(files).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in rows) == 8_000
    assert len(rows) > 1 and max(r["count"] for r in rows) < 8_000
