"""Evaluation and telemetry on worked cases."""

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.operators import evaluate, fragments, prompts, telemetry, vectors
from lodestar.plans.ordering import carry_forward, number_rows

RESULT = "task string, `group` string, item_id string, result_no int, documents array<struct<source_name:string,similarity_score:double>>"


def results(spark, rows):
    return spark.createDataFrame([("t", g, i, n, [(s, 0.5) for s in names]) for g, i, n, names in rows], RESULT)


def test_jaccard_only_in_and_missing(spark):
    r = results(
        spark,
        [
            ("adaptive_full", "a", 0, "abc"), ("simple_full", "a", 1, "xxx"), ("simple_full", "a", 2, "bcdd"),
            ("adaptive_full", "b", 3, ""), ("adaptive_plain", "b", 4, ""), ("adaptive_full", "c", 5, "a"),
        ],
    )
    compared = evaluate.compare_groups(r)
    got = {(x.item_id, x.group_2): (x.n_both, x.n_either, x.jaccard, x.missing) for x in evaluate.jaccard(compared).collect()}
    assert got == {
        ("a", "simple_full"): (2, 4, 0.5, None),
        ("a", "adaptive_plain"): (None, None, None, "adaptive_plain"),
        ("b", "adaptive_plain"): (0, 0, 0.0, None),
        ("b", "simple_full"): (None, None, None, "simple_full"),
    }
    only = {(x.item_id, x.only_in, x.source_name) for x in evaluate.only_in(compared).collect()}
    assert only == {("a", "adaptive_full", "a"), ("a", "simple_full", "d")}
    stats = {x["group"]: (x.n_items, x.n_documents, x.n_unique) for x in evaluate.group_stats(r).collect()}
    assert stats["adaptive_full"] == (3, 4, 3)


def test_judgements_and_scores(spark):
    text = ["5::5::too early", "[J1]", "0::5::reason with :: inside", "noise", "1::3::x", "[J2]", "0::4::y"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no long, line string")
    for block in (1, 2, 100):
        got = {(r.judge, r.pair_id, r.score, r.reason) for r in evaluate.parse_judgements(lines, block).collect()}
        assert got == {(None, 5, 5, "too early"), ("J1", 0, 5, "reason with :: inside"), ("J1", 1, 3, "x"), ("J2", 0, 4, "y")}
    numbered = spark.createDataFrame([(0, "g"), (1, "g")], "pair_id long, `group` string")
    scores = evaluate.judge_scores(evaluate.parse_judgements(lines), numbered).collect()
    assert {(r.judge, r.n_scores, r.mean_score) for r in scores} == {("J1", 2, 4.0), ("J2", 1, 4.0)}


def test_carry_forward_in_one_hot_group(spark):
    df = spark.range(10_000).select(F.lit("g").alias("g"), "id")
    marked = carry_forward(df, "g", "id", F.when(F.col("id") % 997 == 5, F.col("id")), "last", 64)
    wrong = marked.filter(
        ~F.col("last").eqNullSafe(F.when(F.col("id") >= 5, F.floor((F.col("id") - 5) / 997) * 997 + 5))
    )
    assert wrong.count() == 0


def test_number_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    rows = number_rows(df, "k", "n", 64).collect()
    assert [r.k for r in sorted(rows, key=lambda r: r.n)] == sorted(r.k for r in rows)
    assert sorted(r.n for r in rows) == list(range(5000))


def test_log_parse_and_stats(spark):
    text = [
        "[2026-01-23 15:36:24] [INFO] Answers: Retrieval completed in 3168ms",
        "prefix [2026-01-23 15:36:25] [INFO] Answers: Retrieval completed in 3170ms trailing",
        "[2026-01-23 15:36:24] [INFO] Store: Similarity search completed in 1578ms",
        "[2026-01-23 15:36:24] [INFO] Store: started",
        "completed in a hurry",
        "\x1e completed in no time",
        "[2026-01-23 15:36:24] [INFO] Odd: a\x1fb\x1e completed in 5ms",
        "[----] [INFO] Odd: no time completed in 6ms",
    ]
    events = telemetry.parse_log(spark.createDataFrame([(x,) for x in text], "line string"))
    at = lambda s: datetime(2026, 1, 23, 15, 36, s)
    assert {(r.timestamp, r.service, r.operation, r.duration_ms) for r in events.collect()} == {
        (at(24), "Answers", "Retrieval", 3168),
        (at(25), "Answers", "Retrieval", 3170),
        (at(24), "Store", "Similarity search", 1578),
        (at(24), "Odd", "a\x1fb\x1e", 5),
        (None, "Odd", "no time", 6),
    }
    stats = {r.operation_key: r for r in telemetry.latency_stats(events).collect()}
    assert stats["Answers:Retrieval"].median_ms == 3169.0
    assert stats["Store:Similarity search"].stdev_ms == 0.0


def test_index_tables(spark):
    indexes = spark.createDataFrame([("full",)], "index_name string")
    assert vectors.ensure_index(indexes, "full").count() == 0
    assert [r.index_name for r in vectors.ensure_index(indexes, "plain").collect()] == ["plain"]
    chunks = spark.createDataFrame([(1,), (2,), (3,)], "chunk_id long")
    ids = spark.createDataFrame([(1,), (2,), (2,), (9,)], "chunk_id long")
    members = spark.createDataFrame([("full", 1)], "index_name string, chunk_id long")
    assert [r.chunk_id for r in vectors.add_members(ids, chunks, indexes, members, "full").collect()] == [2]
    assert vectors.add_members(ids, chunks, indexes, members, "absent").count() == 0


def test_judge_prompts(spark):
    rows = [(i, "q", "r", ("7", "t", "d", [("f", "+x")])) for i in range(3)]
    df = spark.createDataFrame(
        rows, "pair_id long, query string, response string, pr struct<id:string,title:string,description:string,hunks:array<struct<filepath:string,content:string>>>"
    )
    answers = evaluate.answer_judge_prompts(df, "P", 2).orderBy("batch").collect()
    assert len(answers) == 2
    assert '[{"pair_id":0,"question":"q","answer":"r"},{"pair_id":1,"question":"q","answer":"r"}]' in answers[0].prompt
    described = evaluate.description_judge_prompts(df, "P").collect()
    assert len(described) == 1 and '"hunks":[{"filepath":"f","content":"+x"}]' in described[0].prompt


def test_judge_prompts_hold_all_pairs_and_nulls(spark):
    rows = [(i, "q", "r" if i != 100 else None, ("7", None, "d", [])) for i in (99, 100, 101)]
    df = spark.createDataFrame(
        rows, "pair_id long, query string, response string, pr struct<id:string,title:string,description:string,hunks:array<struct<filepath:string,content:string>>>"
    )
    answers, described = evaluate.answer_judge_prompts(df, "P").collect(), evaluate.description_judge_prompts(df, "P").collect()
    assert len(answers) == len(described) == 1
    assert '{"pair_id":100,"question":"q","answer":null}' in answers[0].prompt
    assert '{"pair_id":100,"description":null},{"pair_id":101,"description":"r"}' in described[0].prompt
    assert '"title":null' in described[0].prompt


def test_judge_prompts_are_joined_from_blocks(spark, monkeypatch):
    """No list of pairs is written as one JSON text: its buffer ended a 6 GB heap at 0.5 GB of documents."""
    monkeypatch.setattr(evaluate, "BLOCK", 7)
    rows = [(i, f"q{i}", None if i % 5 == 0 else 'a "\n\U0001f600,' * i, ("a" if i % 3 else None, f"t{i}")) for i in range(4, 40)]
    rows += [(12, "again", "r", ("a", "x")), (None, "no id", "r", ("a", "y")), (1_000_000, "", "", ("a", "z"))]
    numbered = spark.createDataFrame(rows, "pair_id long, query string, response string, pr struct<id:string,title:string>").repartition(5)
    first = lambda r: (r[0] is not None, r[0] or 0, r[1])
    dump = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    def asked(some):
        pairs = [{"pair_id": i, "question": q, "answer": a} for i, q, a, _ in sorted(some, key=first)]
        return evaluate.ANSWER_JUDGE.replace("<project>", "<p>").replace("<qa_pair>", dump(pairs))

    whole, tens = evaluate.answer_judge_prompts(numbered, "<p>"), evaluate.answer_judge_prompts(numbered, "<p>", 10)
    assert [tuple(r) for r in whole.collect()] == [(0, asked(rows))]
    batch = lambda r: None if r[0] is None else r[0] // 10
    batches = {batch(r) for r in rows}
    assert {r.batch: r.prompt for r in tens.collect()} == {b: asked([r for r in rows if batch(r) == b]) for b in batches}

    # The pull request is that of the smallest pair id, null ids aside; equal pair ids go by their fields.
    described = evaluate.description_judge_prompts(numbered, "<p>")
    expected = {}
    for pr, title in (("a", "t4"), (None, "t6")):
        own = [(i, a) for i, _, a, p in rows if p[0] == pr]
        items = [{"pair_id": i, "description": a} for i, a in sorted(own, key=lambda r: (*first((r[0], 0))[:2], r[1] or ""))]
        text = evaluate.DESCRIPTION_JUDGE.replace("<project>", "<p>").replace("<pull_request>", dump({"id": pr, "title": title}))
        expected[pr] = text.replace("<generated_descriptions>", dump(items))
    assert {r.pr_id: r.prompt for r in described.collect()} == expected
    for made in (whole, tens, described):
        assert "ArrayType(StructType(StructField(pair_id" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    ("template", "length", "digest"),
    [
        (prompts.ANSWER_PROMPT, 358, "053cb9e6c570e61b"),
        (prompts.INTERPRETATION_PROMPT, 954, "6e7e0dec64737643"),
        (prompts.REVIEW_PROMPT, 1009, "9a497ce7de9b08c2"),
        (prompts.ENRICHMENT_PROMPT, 664, "82893698bb950bba"),
        (evaluate.ANSWER_JUDGE, 585, "0549e0298a4abaa4"),
        (evaluate.DESCRIPTION_JUDGE, 1224, "999ac73ca5b92eab"),
    ],
)
def test_templates_are_pinned(template, length, digest):
    assert (len(template), hashlib.sha256(template.encode()).hexdigest()[:16]) == (length, digest)


def test_fragments_are_the_prompts(spark, tmp_path):
    pr = "struct<id:string,title:string>"
    rows = [(i * 3, f"q{i}", None if i % 4 == 0 else 'a "\n\U0001f600' * i, ("hot" if i % 3 else "cold", f"t{i}")) for i in range(40)]
    rows.append((500, "", "", (None, "x")))
    numbered = spark.createDataFrame(rows, f"pair_id long, query string, response string, pr {pr}").repartition(3)
    whole = evaluate.answer_judge_prompts(numbered, "<p>").first().prompt
    placed = fragments.answer_fragments(numbered, "<p>", block=7)
    assert "".join(fragments.prompt(placed)) == whole
    assert all(whole.startswith(r.fragment, r.start) for r in placed.collect())
    of_sets = fragments.description_fragments(numbered, "<p>", block=7)
    fragments.write_fragments(of_sets, str(tmp_path / "f"), "pr_id")
    got = {}
    for r in spark.read.parquet(str(tmp_path / "f")).orderBy("pr_id", "part").collect():
        assert len(got.setdefault(r.pr_id, "")) == r.start
        got[r.pr_id] += r.fragment
    assert got == {r.pr_id: r.prompt for r in evaluate.description_judge_prompts(numbered, "<p>").collect()}


def test_no_pairs_have_no_fragments(spark):
    empty = spark.createDataFrame([], "pair_id long, query string, response string, pr struct<id:string>")
    assert fragments.answer_fragments(empty, "p").count() == 0
    assert fragments.description_fragments(empty, "p").count() == 0
