"""Readers, writers and whole jobs on files."""

import json
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestar.operators import inference
from lodestar.plans import jobs
from lodestar.sources import readers, writers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture
def tree(tmp_path):
    java = tmp_path / "src" / "deep"
    java.mkdir(parents=True)
    (java / "Foo.java").write_text("package a.util;\npublic class Foo { enum Kind { X } }\n")
    (java / "Broken.java").write_text("package a;\nclass Broken { ")
    (java / "package-info.java").write_text("package a;")
    (java / "note.JAVA").write_text("class No {}")
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "guide.ADOC").write_text("= Guide\n\n== Use\n\nFoo is in util.\n\n== Other\n\nnothing here\n")
    (docs / "paper.pdf").write_text("Foo line one\nline two\n")
    (docs / "read.md").write_text("# ignored")
    (docs / "data.bin").write_text("x")
    return tmp_path


def test_scans(spark, tree):
    java = readers.scan_java(spark, str(tree / "src")).collect()
    assert {r.source_name for r in java} == {"cu::Foo.java", "cu::Broken.java"}
    assert readers.scan_java(spark, str(tree / "absent")).count() == 0
    taken, rejects = readers.route(readers.scan_docs(spark, str(tree / "docs")))
    assert {(r.source_type, r.source_name) for r in taken.collect()} == {
        ("asciidoc", "asciidoc::guide.ADOC"), ("pdf", "pdf::paper.pdf"), ("markdown", "markdown::read.md"),
    }
    assert [r.path.split("/")[-1] for r in rejects.collect()] == ["data.bin"]
    assert readers.scan_docs(spark, str(tree / "docs" / "paper.pdf")).first().source_type == "pdf"


def test_pull_requests_and_results(spark, tmp_path):
    prs = [{"id": 12, "html_url": "x", "title": "t", "description": "d", "hunks": [{"filepath": "f", "content": "c"}]}]
    (tmp_path / "prs.json").write_text(json.dumps(prs, indent=2))
    row = readers.read_pull_requests(spark, str(tmp_path / "prs.json")).first()
    assert (row.id, row.hunks[0].filepath) == ("12", "f")
    results = [
        {"task": "query_answer", "group": "g", "input": "why?", "response": "r", "duration": 5,
         "documents": [{"source_name": "s", "embedding_ids": [1], "similarity_score": 0.5}]},
        {"task": "code_interpretation", "group": "g", "input": prs[0], "response": "r", "duration": 5,
         "documents": [{"source_name": "s", "chunk_ids": [2], "similarity_score": 0.5}]},
        {"group": "g", "input": "lost", "response": "r", "duration": 1},
        {"task": "query_answer", "group": "h", "input": "bare", "response": "r", "duration": 6},
    ]
    (tmp_path / "res.json").write_text(json.dumps(results))
    answers = {r.item_id: r for r in readers.read_eval_results(spark, str(tmp_path / "res.json"), "query_answer").collect()}
    assert answers["why?"].documents[0].chunk_ids == ["1"] and answers["bare"].documents == []
    code = readers.read_eval_results(spark, str(tmp_path / "res.json"), "code_interpretation").first()
    assert (code.item_id, code.pr.title, code["query"], code.documents[0].chunk_ids) == ("12", "t", None, ["2"])


def test_equal_file_names_stay_apart(spark, tmp_path):
    code = "package p;\nclass App {{ int x = {}; }}\n"
    for folder, x in (("a", 1), ("b", 1)):
        (tmp_path / "src" / folder / "p").mkdir(parents=True)
        (tmp_path / "docs" / folder).mkdir(parents=True)
        (tmp_path / "src" / folder / "p" / "App.java").write_text(code.format(x))
        (tmp_path / "docs" / folder / "index.adoc").write_text("= T\n\nabout App in p\n")
    (tmp_path / "docs" / "scan.pdf").write_bytes(b"%PDF-1.4 binary")
    def chat(texts):
        return [json.dumps({"description": "d", "usage": "u", "relationship": "r"}) for _ in texts]

    def build():
        return jobs.build_corpus(spark, str(tmp_path / "src"), [str(tmp_path / "docs")], str(tmp_path / "out"), chat, embed)

    def ids(tables):
        count = lambda t, c: (t.count(), t.select(c).distinct().count())
        return {
            "nodes": count(tables["class_nodes"], "node_id"), "paragraphs": count(tables["paragraphs"], "source_id"),
            "chunks": count(tables["chunks"], "chunk_id"), "vectors": count(tables["vectors"], "chunk_id"),
            "enriched": count(tables["enriched"], "node_id"), "bindings": count(tables["bindings"], "node_id"),
        }

    first = ids(build())
    assert first["nodes"] == first["paragraphs"] == (2, 2) and first["chunks"] == first["vectors"] == (10, 10)
    assert ids(build()) == first
    rejects = {r.path.split("/")[-1]: r.reason for r in spark.read.parquet(f"{tmp_path}/out/rejects").collect()}
    assert rejects == {"scan.pdf": "encoded PDF"}
    (tmp_path / "src" / "a" / "p" / "App.java").write_text(code.format(2))
    changed = ids(build())
    assert changed["nodes"] == changed["enriched"] == (2, 2) and changed["bindings"][1] == 2


def test_a_rerun_equals_a_fresh_build(spark, tmp_path):
    """After an edit, an addition and a deletion: all tables as built anew, model calls for new texts only."""
    src, docs = tmp_path / "src", tmp_path / "docs"
    src.mkdir()
    docs.mkdir()
    for name in ("Foo", "Bar", "Old"):
        (src / f"{name}.java").write_text(f"package a.util;\nclass {name} {{ }}\n")
    (docs / "guide.adoc").write_text("= Guide\n\n== Use\n\nFoo is in util.\n\n== Gone\n\nBar lives here\n")
    (docs / "more.adoc").write_text("= More\n\n== Only\n\nnothing of the kind\n")

    def chat(texts):
        return [json.dumps({"description": f"{len(t)} long", "usage": t[-40:], "relationship": "r"}) for t in texts]

    def build(out):
        return jobs.build_corpus(
            spark, str(src), [str(docs)], str(tmp_path / out), chat, embed,
            {"full": ("CODE", "ENRICHMENT", "DOCUMENT"), "plain": ("CODE", "DOCUMENT")},
        )

    build("out")
    (docs / "guide.adoc").write_text("= Guide\n\n== Use\n\nFoo was in util.\n\n== New\n\nBar and Foo in util\n")
    (docs / "late.adoc").write_text("= Late\n\n== Late\n\nutil again, and Late\n")
    (src / "Old.java").unlink()
    (src / "Late.java").write_text("package a.late;\nclass Late { }\n")
    again, fresh = build("out"), build("fresh")
    # vectors are stored in single precision
    rows = lambda t: sorted(str(r) for r in t.select(sorted(t.columns)).collect())
    for name in fresh:
        assert rows(again[name]) == rows(fresh[name]), name
    chunks = {r.chunk_id for r in again["chunks"].collect()}
    assert {r.chunk_id for r in again["vectors"].collect()} == chunks
    asked = {r.node_id for r in spark.read.parquet(f"{tmp_path}/out/enriched_last").collect()}
    assert len(asked) == 3 and spark.read.parquet(f"{tmp_path}/out/embedded_last").count() < len(chunks)
    before = again["vectors"].count()
    (docs / "more.adoc").unlink()
    third = build("out")
    assert spark.read.parquet(f"{tmp_path}/out/enriched_last").count() == 0
    assert spark.read.parquet(f"{tmp_path}/out/embedded_last").count() == 0
    assert third["vectors"].count() == before - 2  # its one paragraph was in both indexes
    assert third["index_members"].count() == third["vectors"].count()


def test_judge_and_pull_request_jobs(spark, tmp_path):
    rows = [
        {"task": "query_answer", "input": f"q{i % 2}", "group": g, "response": None if i == 1 else "r", "documents": [], "duration": 1}
        for i, g in enumerate(("adaptive_full", "simple_full", "adaptive_full"))
    ]
    (tmp_path / "res.json").write_text(json.dumps(rows))
    (tmp_path / "replies.txt").write_text("[J]\n0::4::fine\n1::2::no\n\n2::5::yes\n")
    results = readers.read_eval_results(spark, str(tmp_path / "res.json"), "query_answer")
    made = jobs.judge_prompts(results, "P")
    assert made["answers"].count() == 1 and made["descriptions"].count() == 0
    assert [r.pair_id for r in made["pairs"].orderBy("pair_id").collect()] == [0, 1, 2]
    scores = jobs.judge_report(spark, str(tmp_path / "res.json"), "query_answer", str(tmp_path / "replies.txt"))
    assert {(r.judge, r.group, r.mean_score) for r in scores.collect()} == {("J", "adaptive_full", 4.5), ("J", "simple_full", 2.0)}
    prs = spark.createDataFrame([("1", "t", "d"), ("2", "t", None)], "id string, title string, description string")
    diffs = spark.createDataFrame([("1", "diff --git a/x b/y\n--- a\n+++ b\n@@ -1 +1 @@\n-a\n+b\n")], "pr_id string, diff string")
    jobs.pull_requests_from_diffs(prs, diffs, str(tmp_path / "prs"))
    back = {r.id: [h.filepath for h in r.hunks] for r in readers.read_pull_requests(spark, str(tmp_path / "prs"), False).collect()}
    assert back == {"1": ["y"], "2": []}


def test_result_and_csv_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "a"), ("t2", "b")], "task string, response string")
    for _ in range(2):
        writers.append_results(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    (tmp_path / "app.log").write_text('[2026-01-23 15:36:24] [INFO] S: say "a, b" completed in 7ms\nother\n')
    report = jobs.latency_report(spark, str(tmp_path / "app.log"), str(tmp_path / "csv")).collect()
    assert [(r.operation_key, r.n) for r in report] == [('S:say "a, b"', 1)]
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).first()
    assert (back.timestamp, back.operation, back.duration_ms) == ("2026-01-23 15:36:24", 'say "a, b"', "7")


def test_vector_table(spark, tmp_path):
    path = str(tmp_path / "vectors")
    make = lambda rows: spark.createDataFrame(rows, "index_name string, chunk_id string, source_id string, embedding array<float>")
    writers.add_vectors(make([]), path)
    assert not readers.exists(spark, path)
    writers.add_vectors(make([("full", "a", "s", [3.0, 4.0]), ("plain", "a", "s", [0.0, 0.0])]), path)
    writers.add_vectors(make([("full", "b", "s", [1.0, 0.0])]), path)
    assert {tuple(round(x, 3) for x in r.embedding) for r in writers.read_vectors(spark, path, "full").collect()} == {(0.6, 0.8), (1.0, 0.0)}
    others = {f for f in os.listdir(f"{path}/index_name=full") if "bucket" in f}
    writers.add_vectors(make([("full", "a", "s", [0.0, 2.0]), ("full", "a", "s", [0.0, 2.0])]), path)
    assert others == {f for f in os.listdir(f"{path}/index_name=full") if "bucket" in f}
    assert os.listdir(tmp_path) == ["vectors"]  # nothing staged is left
    got = {(r.index_name, r.chunk_id): [round(x, 3) for x in r.embedding] for r in writers.read_vectors(spark, path).collect()}
    assert got == {("full", "a"): [0.0, 1.0], ("full", "b"): [1.0, 0.0], ("plain", "a"): [0.0, 0.0]}
    writers.remove_index(spark, path, "full")
    writers.remove_index(spark, path, "absent")
    assert {r.index_name for r in writers.read_vectors(spark, path).collect()} == {"plain"}


def letters(texts):
    return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], dtype=float)


def embed(df, text="content", out="embedding"):
    return inference.embed(df, letters, text, out)


def reply(texts):
    return [json.dumps({"description": "about foo", "usage": "use it", "relationship": "none"}) for _ in texts]


def test_build_answer_and_evaluate(spark, tree):
    out = str(tree / "out")
    build = lambda chat: jobs.build_corpus(
        spark, str(tree / "src"), [str(tree / "docs")], out, chat, embed,
        {"full": ("CODE", "ENRICHMENT", "DOCUMENT"), "plain": ("CODE", "DOCUMENT")},
    )
    tables = build(reply)
    assert {r.signature for r in tables["class_nodes"].collect()} == {"a.util.Foo", "a.util.Kind"}
    assert tables["paragraphs"].count() == 3
    rejects = {r.path.split("/")[-1]: r.reason for r in spark.read.parquet(f"{out}/rejects").collect()}
    assert rejects == {"data.bin": "unsupported file type", "Broken.java": "brackets do not match"}
    bindings = spark.read.parquet(f"{out}/bindings").join(tables["class_nodes"], "node_id")
    assert {(r.signature, r.n) for r in bindings.groupBy("signature").agg(F.count("*").alias("n")).collect()} == {
        ("a.util.Foo", 2), ("a.util.Kind", 1),
    }
    first = {name: sorted(map(str, t.collect())) for name, t in tables.items()}
    assert tables["chunks"].filter("content_type = 'ENRICHMENT'").count() == 6
    assert {r.index_name: r["count"] for r in tables["vectors"].groupBy("index_name").count().collect()} == {"full": 11, "plain": 5}

    def no_calls(texts):
        raise AssertionError("already enriched")

    assert {(r.index_name, r.n) for r in tables["index_members"].groupBy("index_name").agg(F.count("*").alias("n")).collect()} == {
        ("full", 11), ("plain", 5),
    }
    assert {r.index_name for r in tables["indexes"].collect()} == {"full", "plain"}
    # each chunk was embedded once, for both indexes
    assert spark.read.parquet(f"{out}/embedded_last").count() == 11
    tables = build(no_calls)
    assert spark.read.parquet(f"{out}/embedded_last").count() == 0
    assert {name: sorted(map(str, t.collect())) for name, t in tables.items()} == first
    assert spark.read.json(f"{out}/enrichment_audit").count() == 2

    questions = spark.createDataFrame([("1", "what is foo in util"), ("2", "nothing")], "request_id string, query string")
    prs = spark.createDataFrame(
        [("9", "t", "d", [("f", "+foo"), ("g", "-x")]), ("8", "t", "d", [])],
        "request_id string, title string, description string, hunks array<struct<filepath:string,content:string>>",
    )
    runs = jobs.run_evaluation(
        {"query_answer": questions, "code_interpretation": prs, "code_review": prs},
        tables["vectors"], tables["sources"], embed, lambda ts: [str(len(t)) for t in ts],
    )
    writers.append_results(runs, f"{out}/results")
    rows = spark.read.json(f"{out}/results").collect()
    assert len(rows) == 18 and all(r.response for r in rows)
    single = [r for r in rows if r.task == "query_answer"]
    assert all(d.rrf_score is None for r in single for d in r.documents)
    fused = [r for r in rows if r.task == "code_review" and r.request_id == "9"]
    assert all(d.rrf_score > 0 for r in fused for d in r.documents)
    read = lambda task: readers.read_eval_results(spark, f"{out}/results", task, multi_line=False)
    results = read("query_answer").unionByName(read("code_review"))
    assert {r.title for r in results.filter("task = 'code_review'").select("pr.title").collect()} == {"t"}
    assert results.filter("item_id = 'nothing' and duration_ms >= 0").count() == 3
    report = jobs.overlap_report(results)
    assert {r.n_groups for r in report["items"].collect()} == {3}
    assert report["jaccard"].filter("missing is null and jaccard is not null").count() == 8
