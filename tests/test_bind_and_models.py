"""Keyword binding, prompts, model seams and reply parsing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import fill
from lodestar.operators import bind, inference, prompts


def bound(spark, nodes, texts, limit, fill="distinct", **limits):
    n = spark.createDataFrame(nodes, "node_id string, signature string")
    p = spark.createDataFrame(texts, "paragraph_id long, content string").repartition(3)
    rows = bind.top_matches(n, p, limit, fill, **limits).orderBy("node_id", "pos").collect()
    out = {}
    for r in rows:
        out.setdefault(r.node_id, []).append(r.paragraph_id)
    return out


@pytest.mark.parametrize(
    "both, one, distinct, repeat",
    [
        ([2], [1], [1, 2], [1, 2]),
        ([1, 3, 5, 7], [], [1, 3, 5], [1, 3, 5]),
        ([4], [1, 2, 6], [4, 1, 2], [4, 1, 2]),
        ([1], [2, 3, 4], [1, 2, 3], [1, 1, 2]),
    ],
)
def test_limit_cases(spark, both, one, distinct, repeat):
    texts = [(i, "the FOO in Pkg") for i in both] + [(i, "only foo") for i in one] + [(50, "neither")]
    node = [("n", "com.pkg.Foo")]
    assert bound(spark, node, texts, 3) == {"n": distinct}
    assert bound(spark, node, texts, 3, "repeat") == {"n": repeat}


def test_empty_package_matches_everything(spark):
    assert bound(spark, [("n", ".Foo")], [(1, "x"), (2, "foo"), (3, None)], 5) == {"n": [1, 2]}
    assert bound(spark, [("n", ".Foo")], [(1, "x"), (2, "foo"), (3, "y")], 1) == {"n": [2]}


def brute(nodes, texts, limit):
    out = {}
    for node, signature in nodes:
        b, a = signature.lower().split(".")[-2:]
        either = sorted(i for i, t in texts if a in t.lower() or b in t.lower())
        both = [i for i, t in texts if a in t.lower() and b in t.lower()]
        if len(either) > limit:
            both = sorted(both)[:limit]
            either = both + [i for i in either if i not in both][: limit - len(both)]
        if either:
            out[node] = either
    return out


@pytest.mark.parametrize("limits", [{}, {"max_shipped": 60}])
def test_binding_equals_brute_force(spark, limits):
    rng = random.Random(5)
    letters = "abc d"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip() or "a"
    nodes = [(f"n{i}", f"x.{word(rng.randint(1, 3))}.{word(rng.randint(1, 4))}") for i in range(60)]
    texts = [(i, word(rng.randint(1, 25)).upper()) for i in range(120)]
    assert bound(spark, nodes, texts, 4, **limits) == brute(nodes, texts, 4)


@pytest.mark.parametrize("limits", [{}, {"max_shipped": 0}])
def test_binding_of_odd_words_equals_brute_force(spark, limits):
    rng = random.Random(11)
    parts = ["builder", "factory", "größe", "\U0001f600", "服务", "a", "zz\0", "util"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))
    nodes = [(f"n{i}", f"x.{word()}.{word()}") for i in range(80)] + [("e", ".util"), ("f", "x.util."), ("g", ".")]
    texts = [(i, rng.choice(["", " ", word(), word().upper() + word(), " ".join(word() for _ in range(40))])) for i in range(150)]
    rng.shuffle(texts)
    assert bound(spark, nodes, texts + [(900, None)], 4, **limits) == brute(nodes, texts, 4)


def test_runs_of_texts_longer_than_a_chunk(spark, monkeypatch):
    import pyarrow as pa

    from lodestar.operators import grams

    monkeypatch.setattr(grams, "CHUNK", 5)
    texts = ["", "abcdefghijklm", "xy", "", "nopqrstuvwxyz012"]
    got = sorted((int(r), int(v).to_bytes(8, "little")) for rows, runs in grams._runs(pa.array(texts), {3, 8}) for r, v in zip(rows, runs.view("u8")))
    want = sorted((i, t[k : k + n].encode().ljust(8, b"\0")) for i, t in enumerate(texts) for n in (3, 8) for k in range(len(t) - n + 1))
    assert got == want


def test_matcher_reopens_settled_words():
    seen = bind._Matcher(["a", "bb", ""], ["bb", "", ""], 2)
    texts = {5: "a bb", 6: "a bb", 7: "bb a", 1: "bb", 2: "a bb", 3: None}
    for ids in ([6, 5], [7, 1], [3, 2]):
        seen.read(ids, [texts[i] for i in ids], at_once=1)
    rows = {}
    for r in seen.table().to_pylist():
        rows.setdefault((r["a"], r["b"]), []).append(r["paragraph_id"])
    assert rows == {("a", None): [2, 5], ("bb", None): [1, 2], ("", None): [1, 2], ("a", "bb"): [2, 5], ("bb", ""): [1, 2], ("", ""): [1, 2]}


def test_hot_keyword_keeps_the_first_paragraphs(spark):
    texts = [(i, "builder text") for i in range(3000)]
    assert bound(spark, [("n", "a.util.Builder")], texts, 10) == {"n": list(range(10))}


def test_counts_and_text(spark):
    nodes = spark.createDataFrame([("n", "a.b.Foo"), ("m", "zz.qq.Bar")], "node_id string, signature string")
    texts = spark.createDataFrame([(2, "b two foo"), (1, "foo one b")], "paragraph_id long, content string")
    matches = bind.top_matches(nodes, texts)
    assert {r.node_id: r.n_paragraphs for r in bind.counts(nodes, matches).collect()} == {"n": 2, "m": 0}
    assert [tuple(r) for r in bind.bound_text(matches, texts).collect()] == [("n", "foo one b\nb two foo")]


def test_fill_does_not_substitute_twice(spark):
    row = spark.range(1).select(fill("<a>-<b>", a=F.lit("<b>"), b=F.lit("$1\\")).alias("x")).first()
    assert row.x == "<b>-$1\\"


def test_hunk_queries(spark):
    df = spark.createDataFrame(
        [("1", "D", [("f.java", "+x"), ("g.java", "-y")]), ("2", "E", [])],
        "request_id string, description string, hunks array<struct<filepath:string,content:string>>",
    )
    assert prompts.queries_interpretation(df).count() == 2
    rows = prompts.queries_review(df).orderBy("request_id", "query_no").collect()
    assert [r["query"] for r in rows] == [
        "D",
        prompts.REVIEW_QUERY + '{"filepath: f.java", "content": "+x"}',
        prompts.REVIEW_QUERY + '{"filepath: g.java", "content": "-y"}',
        "E",
    ]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('{"description":"d","usage":"u","relationship":"r"}', ("d", "u", "r")),
        ('{"description":"d","exampleUsage":"e"}', ("d", "e", None)),
        ('```json\n{"description":"d","usage":"u","relationship":"r"}\n```', ("d", "u", "r")),
        ("not json", ("not json", "null", "null")),
        ("", ("", "null", "null")),
        ("[1]", ("[1]", "null", "null")),
    ],
)
def test_parse_summary(spark, raw, expected):
    row = spark.createDataFrame([(raw,)], "raw string").select(inference.parse_summary(F.col("raw")).alias("s")).first()
    assert tuple(row.s) == expected


def test_failing_prompts_get_an_error_and_spare_the_rest(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("good",), ("bad one",), ("fine",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.response, r.error) for r in inference.generate(df, model).collect()}
    assert got == {"good": ("GOOD", None), "bad one": (None, "RuntimeError: refused"), "fine": ("FINE", None)}


def test_retries_up_to_six_calls(spark):
    def model(texts, calls=[]):
        calls.append(1)
        if len(calls) < 6:
            raise RuntimeError("busy")
        return [str(len(calls))] * len(texts)

    df = spark.createDataFrame([("p",)], "prompt string").coalesce(1)
    assert inference.generate(df, model).first().response == "6"


def test_embed_and_enrich(spark):
    df = spark.createDataFrame([("n", "abc")], "node_id string, prompt string")
    rows = inference.embed(df, lambda ts: np.array([[len(t), 1.0] for t in ts]), "prompt").first()
    assert list(rows.embedding) == [3.0, 1.0]
    done = inference.enrich(df, lambda ts: ['{"description": "d"}'] * len(ts)).first()
    assert (done.description, done.usage, done.processed, done.error) == ("d", None, True, None)


def test_texts_are_matched_in_one_scan_without_a_sort(spark, sf):
    from registry import inputs

    plan = bind.top_matches(inputs.nodes(spark, sf), inputs.paragraphs(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert not [line for line in plan.splitlines() if "Sort" in line and "content" in line]


def test_updated_matches_equal_a_fresh_binding(spark):
    """Random states: nodes and texts that come, go and change their text, several times over."""
    rng = random.Random(3)
    letters = "abc d"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip() or "a"
    node_rows = {f"n{i}": f"x.{word(rng.randint(1, 3))}.{word(rng.randint(1, 4))}" for i in range(40)}
    text_rows = {i: word(rng.randint(1, 12)) for i in range(40)}
    limit, kept, known = 4, None, None
    for step in range(3):
        n = spark.createDataFrame(list(node_rows.items()), "node_id string, signature string")
        p = spark.createDataFrame(list(text_rows.items()), "paragraph_id long, content string")
        right = sorted(map(tuple, bind.top_matches(n, p, limit).collect()))
        if kept is not None:
            old = spark.createDataFrame(kept, "node_id string, paragraph_id long, pos int, matches_all boolean")
            got = sorted(map(tuple, bind.updated_matches(n, p, old, *known, limit).collect()))
            assert got == right
        kept = right
        known = [bind.state(n, "node_id", "signature"), bind.state(p, "paragraph_id", "content")]
        for i in rng.sample(sorted(text_rows), 6):
            del text_rows[i]
        for i in rng.sample(sorted(text_rows), 4):
            text_rows[i] = word(rng.randint(1, 12))
        text_rows.update({rng.randint(-50, 200): word(rng.randint(1, 12)) for _ in range(8 * step + 1)})
        del node_rows[rng.choice(sorted(node_rows))]
        node_rows[f"m{step}"] = f"x.{word(1)}.{word(2)}"
        node_rows[rng.choice(sorted(node_rows))] = f"x.{word(2)}.{word(1)}"
