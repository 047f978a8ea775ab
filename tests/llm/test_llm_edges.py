"""Nulls, blanks, very long texts, repeated rows, rows without id, clashing columns and empty tables."""

import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import brute
from lodestar.llm import (
    byte_bpe,
    chat,
    common,
    components,
    exact_dedup,
    html_extract,
    language,
    line_dedup,
    near_dedup,
    packing,
    quality,
    suffix_dedup,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")

OPERATORS = {
    "exact": exact_dedup.exact_groups,
    "near": near_dedup.near_groups,
    "packing": lambda d: packing.packed_sequences(d, JSON),
    "encode": lambda d: byte_bpe.encoded(d, RANKS, public_tokenizers.PATTERN, with_spans=True),
    "language": lambda d: language.predicted(d, language.learned(d)),
    "lines": line_dedup.without_boilerplate,
    "quality": quality.quality_verdicts,
    "suffix": suffix_dedup.without_repeats,
    "keep_first": exact_dedup.keep_first,
    "keep_one": near_dedup.keep_one,
    "keep_good": quality.keep_good,
    "cut_texts": suffix_dedup.cut_texts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, edge, name):
    assert OPERATORS[name](edge.limit(0)).count() == 0


def test_exact_groups(spark, edge, plain):
    found = exact_dedup.exact_groups(edge, block_chars=64).collect()
    assert len(found) == edge.count()
    rows = [(i, t) for i, t in plain] + [plain[5]]
    right = brute.exact(rows)
    with_id = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found if r.doc_id is not None)
    empty = hashlib.sha256(b"").hexdigest()
    # the row without id and text joins the group of the empty texts
    assert with_id == sorted((i, k, n + (s == empty), s) for i, k, n, s in right)
    without = sorted((r.keep_id or 0, r.group_size, r.kept) for r in found if r.doc_id is None)
    assert without == [(0, 2, False), (0, 2, True), (1, 3, False)]
    assert sum(r.kept for r in found if r.doc_id == 6) == 1


def test_keep_first(spark, edge):
    rows = exact_dedup.keep_first(edge)
    assert rows.columns == edge.columns
    ids = sorted(r.doc_id or 0 for r in rows.collect())
    assert ids == [0, 1, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20]


def test_near_groups(spark, edge, plain):
    found = near_dedup.near_groups(edge, words=2).collect()
    assert len(found) == edge.count()
    right = brute.near(plain, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == right
    assert sum(r.kept for r in found if r.doc_id == 6) == 1
    assert sorted(r.kept for r in found if r.doc_id is None) == [False, True, True]
    kept = near_dedup.keep_one(edge, words=2)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([0, 0, *(i for i, (_, c) in right.items() if i == c)])


def test_second_round_finds_links_that_stars_miss(spark):
    """Chains whose ends differ, many of them in one band key."""
    base = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(40):  # each differs from the next in few words, from the first in many
        docs.append((i, " ".join(base[i * 2 :] + [f"n{k}" for k in range(i * 2)])))
    docs += [(100 + i, " ".join(base[:30] + [f"q{i}x{k}" for k in range(30)])) for i in range(20)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    right = brute.near(docs, 2)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(table, words=2).collect()}
    assert found == right and len({c for _, c in right.values()}) > 1


def test_left_over_links(spark):
    """Members outside the largest component of a key meet all members, in tiles."""
    n = 1300
    members = spark.range(n).select(F.lit(5).cast("long").alias("band"), F.col("id").alias("node"), F.lit(n).alias("n"))
    alike = b"".join(k.to_bytes(8, "little") for k in range(10))
    other = b"".join(k.to_bytes(8, "little") for k in range(20, 30))
    sets = members.select("node", F.when(F.col("node") == n - 1, F.lit(other)).otherwise(F.lit(alike)).alias("items"))
    linked = spark.createDataFrame([(k, 0) for k in range(n - 3)], "node long, component long")
    found = {r.u: r.v for r in near_dedup._left_over(members, sets, linked).where(f"u >= {n - 3} AND v < {n - 3}").collect()}
    assert set(found) == {n - 3, n - 2}
    assert near_dedup._left_over(members, sets, members.select("node", F.lit(0).cast("long").alias("component"))).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 90, 1) if k % 10 != 9] + [(200, 5), (300, 200), (7, 7)]
    links = spark.createDataFrame(chain, "u long, v long")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert found == {k: k // 10 * 10 for k in range(90)} | {200: 0, 300: 0}
    assert components.components(links.limit(0)).count() == 0


def test_first_place_with_hot_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 700).alias("k"))
    found = common.first_place(rows, ["k"], "id", "first").collect()
    first = {}
    for i in range(5000):
        first.setdefault(None if i % 3 == 0 else i % 700, i)
    assert {r.id: r["first"] for r in found} == {i: first[None if i % 3 == 0 else i % 700] for i in range(5000)}
    sizes = common.with_group_size(spark.range(3000).select(F.expr("IF(id < 1000, 1, id)").alias("g")), "g").collect()
    assert {r.g: r.group_size for r in sizes} == {1: 1001 - 1} | {g: 1 for g in range(1000, 3000)}


def test_packing(spark, edge, plain):
    rows = packing.packed_sequences(edge.repartition(3), JSON).collect()
    tokens = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 6:
            tokens.setdefault(r.doc_id, {})[r.start] = r.ids
            assert len(r.ids) == 4 * r.length and r.offset + r.length <= r.tier
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(JSON)
    made.encode_special_tokens = True
    for i, text in plain:
        if i != 6:
            ids = b"".join(tokens[i][k] for k in sorted(tokens[i]))
            right = made.encode(text or "", add_special_tokens=False).ids + [0]
            assert ids == b"".join(x.to_bytes(4, "little") for x in right)


def test_encode_and_decode(spark, edge, plain):
    ids = byte_bpe.encoded(edge, RANKS, public_tokenizers.PATTERN, with_spans=True)
    found = byte_bpe.decoded(ids, RANKS).collect()
    texts = dict(plain) | {None: "no id"}
    assert len(found) == edge.count()
    for r in found:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            assert bytes(r.decoded).decode() == text and r.n_tokens == len(r.first) == len(r.last)
            assert not text or (r.first[0], r.last[-1]) == (0, len(text))


def test_language(spark, edge):
    found = language.predicted(edge, language.learned(edge)).collect()
    assert len(found) == edge.count()
    unknown = {r.doc_id for r in found if r.lang_pred == "und" and r.doc_id is not None}
    assert unknown == {1, 2, 3, 19} and all(r.lang_pred == "en" for r in found if r.doc_id == 8)
    nothing = language.predicted(edge, language.learned(edge.where("lang = 'none'"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == edge.count()


def test_language_with_many_and_long(spark):
    words = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(20))
    rows = [(i, words(i % 40), f"l{i % 40:02}") for i in range(120)] + [(200, "zzq zqz qqz " * 9000, "long")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learned(table)
    assert len(model.languages) == 41 and len(language.learned(table, sample_bytes=1).languages) == 41
    assert {r.doc_id: r.lang_pred for r in language.predicted(table, model).collect()} == {i: name for i, _, name in rows}
    texts = {name: [text.encode()] for _, text, name in rows[:40]}
    data, offsets = np.frombuffer(b"aab zzq kab", np.uint8), np.array([0, 4, 4, 11])
    both = [language.Model(texts, table_bytes=n).lengths(data, offsets) for n in (0, 1 << 30)]
    assert (both[0] == both[1]).all()


def test_quality(spark, edge):
    found = quality.quality_verdicts(edge).collect()
    assert len(found) == edge.count()
    by_id = {r.doc_id: r for r in found}
    for i in (1, 2, 3):
        assert (by_id[i].n_words, by_id[i].base_failed, by_id[i].kept) == (0, True, False)
    assert by_id[20].n_dup_lines == 1  # "line\r" twice; the last line has no \r
    assert (by_id[8].n_words, by_id[8].n_repeat_words) == (90_000, 0)
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.kept}


def test_quality_with_many_languages(spark, monkeypatch):
    monkeypatch.setattr(quality, "LANGUAGES", 1)
    text = " ".join(f"the word{k} of a{k}" for k in range(60))
    rows = [(k, text, "en") for k in range(5)] + [(9, text, "xx"), (10, text, None)]
    found = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == 7 and all(r.kept and r.word_distance == 0 for r in found)


def test_quality_by_the_own_language(spark, monkeypatch):
    monkeypatch.setattr(quality, "LANGUAGES", 1)
    texts = [" ".join(f"a{k} word{j} b{k} more{j}" for j in range(60)) for k in range(30)]
    rows = [(k, text, f"l{k}") for k, text in enumerate(texts)] + [(30 + k, texts[0], "l0") for k in range(30)]
    found = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == 60 and all(r.kept and r.word_distance == 0 for r in found)


def test_repeated_words(spark):
    texts = ["a b c a b c", "a b c d a b c", "x x x x x", "a b", "a b c d e", "p q r p q r s t p q r"]
    right = [6, 6, 5, 0, 0, 9]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert [r.n_repeat_words for r in quality.quality_verdicts(rows).orderBy("doc_id").collect()] == right


def test_lines(spark):
    rows = [(k, f"menu\n\nown {k}\nmenu", "s") for k in range(6)] + [(9, "menu\nx", "t"), (10, None, None), (None, "menu", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit(1))
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.without_boilerplate(table).collect()}
    assert found[0] == (4, 2, "\nown 0") and found[9] == (2, 0, "menu\nx") and found[10] == (1, 0, "") and found[None] == (1, 1, "")


def test_passages(spark, edge, plain):
    found = suffix_dedup.without_repeats(edge).collect()
    assert len(found) == edge.count() and "text" not in suffix_dedup.without_repeats(edge).columns
    docs = plain + [plain[5]] + [(2**63 - 1, "no id")] * 2 + [(2**63 - 1, None)]
    right = sorted((i, n, gone, spans, kept) for i, n, gone, spans, kept in brute.repeats(docs))
    key = lambda r: 2**63 - 1 if r.doc_id is None else r.doc_id
    assert sorted((key(r), r.n_bytes, r.n_removed, len(r.spans), bytes(r["kept"])) for r in found) == right
    cut = suffix_dedup.cut_texts(edge)
    assert cut.columns == edge.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert texts[16] == ("x" * 400, 400) and texts[9] == ("", 0) and texts[1] == ("", 0)


def test_chat(spark):
    turns = [(1, 2, "assistant", "late"), (1, 1, "user", None), (1, 0, None, "first"), (1, 0, None, "first"),
             (2, None, "assistant", "<s>" * 2000), (None, 5, "assistant", "x"), (None, 6, "user", "y"), (3, 0, "system", "")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(0))
    windows = chat.formatted(table, JSON, budget=20, history=1)
    found = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(windows).collect()}
    assert found == {1: (4, 4), 2: (1, 6000), None: (2, 1), 3: (1, 0)}
    assert chat.read_back(chat.formatted(table.limit(0), JSON)).count() == 0


def test_pages(spark):
    page = "<body><nav>menu {0}</nav><main><h1>Title {0}</h1><p>Text   {0} &eacute;</p></main><footer>f</footer>"
    rows = [(k, f"http://H.example/{k}", page.format(k)) for k in range(4)]
    rows += [(9, None, None), (10, "x", ""), (None, "http://h.example", page.format(1)), (11, "http://one.example", "bare words")]
    rows += [(12, "http://copies.example", page.format(1))] * 4
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).repartition(5)
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.main_texts(table).collect())
    text = lambda k: f"Title {k}\nText {k} é"
    right = [(k, text(k), 16) for k in range(4)] + [(0, text(1), 16), (9, "", 0), (10, "", 0), (11, "bare words", 10)]
    assert found == sorted(right + [(12, text(1), 16)] * 4)
    assert html_extract.main_texts(table.limit(0)).count() == 0


def test_deep_and_hostile_pages(spark):
    """Thousands of nested elements, tags that never end, quotes without end: read whole, and in time."""
    deep = lambda n, inner: "<div>" * n + inner + "</div>" * n
    pages = [
        "<body>" + deep(10_000, "<p>deep text</p>") + "</body>",
        "<body>" + deep(600, "<article><p>kept</p><div class=sidebar>gone</div></article>") + "<p>not in the article</p></body>",
        "<body>" + deep(600, "<nav>menu</nav><p>kept</p>") + "</body>",
        "<body><p>first</p>" + '<a "' * 250_000,
        "<body><p>first</p>" + "<p>" * 100_000 + "last",
        "<body><p>a < b, 1 <2 and </ c</p>" + "</" * 100_000 + "<p>end</p>",
        "<body><p>x</p><!--" + "<a '" * 250_000,
    ]
    rows = [(k, f"http://deep.example/{k % 2}", page) for k, page in enumerate(pages)] * 2
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    start = time.monotonic()
    found = {r.page_id: r.text for r in html_extract.main_texts(table).collect()}
    assert time.monotonic() - start < 60
    assert (found[0], found[1], found[2]) == ("deep text", "kept", "kept")
    assert found[3].startswith("first") and found[4].endswith("last") and found[5].endswith("end") and found[6] == "x"


STAGES = {"keep_good": quality.keep_good, "keep_first": exact_dedup.keep_first, "keep_one": near_dedup.keep_one, "cut_texts": suffix_dedup.cut_texts}


@pytest.mark.parametrize("name", STAGES)
def test_stages_carry_columns_of_any_name_and_maps(spark, name):
    words = "we have to see what the house on the hill has in it when all of the people are gone and night comes".split()
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 90)) for _ in range(6)]
    kind = "doc_id long, text string, lang string, `a.b` string, `t``k` int, m map<string,int>, deep struct<`x.y`: int, m: map<string, array<map<int,string>>>>, "
    kind += "kept boolean, spans int, n_bytes string, row int, _rank int"
    rows = [
        (i, t, "en", f"v{i}", i, {"k": i} if i % 2 else None, (i, {"z": [{i: "w"}, None], "n": None}) if i % 3 else None, True, i, "b", i, i)
        for i, t in enumerate([*texts, None])
    ]
    docs = spark.createDataFrame([*rows, rows[1], rows[1]], kind)
    out = STAGES[name](docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    place = docs.columns.index("text")
    rest = lambda r: tuple(v for i, v in enumerate(r) if i != place)
    got = out.collect()
    assert got and {repr(rest(tuple(r))) for r in got} <= {repr(rest(tuple(r))) for r in docs.collect()}
    if name in ("keep_first", "keep_one"):
        assert len({r.doc_id for r in got}) == len(got) == 7
    if name == "cut_texts":
        assert len(got) == docs.count()


def test_the_reference_scans_make_rows_of_words_only_once(spark):
    """Sums of documents come from a scan of their own, without a row for every short word."""
    docs = spark.createDataFrame([(1, "en", "The cat, a DOG"), (2, "en", "the 7 dogs"), (3, None, None)], "doc_id long, lang string, text string")
    found = quality.references(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    got = {r.lang: r for r in found.collect()}
    assert got["en"].words[0] == "the" and got["en"].word_share[0] == 2 / 7 and got[""].words == []
