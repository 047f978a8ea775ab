"""The parts that run inside tasks, against plain versions."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import brute
from lodestar.llm import byte_bpe, chat, html_extract, language, near_dedup, packing, suffix_dedup
from lodestar.llm.pieces import Encoder
from lodestar.llm.text_arrays import as_bytes, lower_words, slices

SYLLABLES = ["a", "b", "A", "é", "ß", "×", " ", "  ", "\n", "\t", "\r\n", "'", "'s", "'ll", "1", ".", ",", "!!", " ",
             " ", "\u0085", "\x1c", "漢", "😀", "‍", "\x00", "<|endoftext|>", "aaaa", "abab", "----", "==", "٣"]


def texts(n, length, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(0, length))) for _ in range(n)]


def encode(encoder, column):
    ids, begins = encoder.encode(*as_bytes(pa.array(column)))
    return [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]


def test_rank_file_ids_equal_tiktoken():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(open(path).read())
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    made = byte_bpe.tokenizer_of(ranks, public_tokenizers.PATTERN)
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = texts(4000, 50, 1) + ["ab" * 30, "a" * 333, " " * 77 + "x", "é" * 51, None, ""]
    assert encode(Encoder(made), some) == [right.encode_ordinary(t or "") for t in some]
    table = byte_bpe.token_bytes(made)
    assert all(table[i].as_py() == token for token, i in ranks.items())


def test_json_tokenizer_ids_equal_whole_encoding():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    some = texts(3000, 50, 2)
    assert encode(Encoder(made), some) == [e.ids for e in made.encode_batch(some, add_special_tokens=False)]


def test_token_spans_cover_characters():
    data = np.frombuffer("aé漢".encode(), np.uint8)
    first, last = byte_bpe.token_spans(data, np.array([2, 1, 1, 2]))  # a+half é, half é, part of 漢, rest
    assert first.tolist() == [0, 1, 2, 2] and last.tolist() == [2, 2, 3, 3]


@given(st.lists(st.text(alphabet="aB \t\né\x0b ", max_size=12), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words(column):
    found, begins = lower_words(*as_bytes(pa.array(column, pa.string())))
    found = found.to_pylist()
    assert [found[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)] == [brute.words(t, True) for t in column]


def test_slices_cover_the_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 30, 1, 1, 0)]), pa.array(range(6))], ["text", "k"])
    parts = list(slices(batch, "text", 6))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(6)) and len(parts) > 2


@given(st.text(alphabet="<|im_start>end\\[/INST]sSY\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible(text):
    safe = chat.escaped(text)
    assert chat.unescaped(safe) == text and not any(c in safe for c in chat.CONTROL)


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|>", "<\\\\s>", "<<SYS>><</SYS>>", "<<s>"])
def test_turns_read_back(text):
    role = f"us\\er\n{text}"
    written = chat.written(role, text)[0] + chat.written("assistant", text)[0]
    assert chat.turns_of(written) == [(role, text), ("assistant", text)]


def test_windows_keep_turns_and_repeat_history():
    window = chat.Window(1, 100, 2)
    rows = []
    for k, (role, n) in enumerate([("system", 10), ("user", 30), ("assistant", 30), ("user", 20), ("assistant", 60), ("user", 400)]):
        rows += window.add((role, f"{k}", 0, 1, n))
    rows.append(window.finish())
    assert [r[2] for r in rows] == ["0123", "034", "05"]  # a long turn stands alone, with what history fits
    assert [r[3] for r in rows] == [0, 2, 1]
    assert [len(r[5]) for r in rows] == [1, 1, 0]


def test_shingles_and_bands():
    column = ["a b a b a", "A  b\na b a", "a", "", None, "a b c d"]
    values, begins = near_dedup.shingle_sets(pa.array(column), 2)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    assert [len(s) for s in sets] == [len(brute.shingles(t, 2)) for t in column]
    assert sets[0] == sets[1] and not sets[2] & sets[0]


def test_odd_sketch_estimates_similarity():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 2000, dtype=np.uint64)
    for share in (0.95, 0.85, 0.8, 0.4):
        n = int(2000 * share)
        other = np.concatenate([base[:n], rnd.integers(0, 2**63, 2000 - n, dtype=np.uint64)])
        similarity = n / (4000 - n)
        found = near_dedup.samples(np.concatenate([base, other]), np.array([0, 2000, 4000]))
        a, b = near_dedup.odd_sketches(found)
        bits = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum()
        k = found.shape[1]
        estimate = 1 + near_dedup.SKETCH_BITS / (4 * k) * np.log(1 - 2 * bits / near_dedup.SKETCH_BITS)
        assert abs(estimate - similarity) < 0.15
        assert (bits <= near_dedup.most_bits()) == (similarity > near_dedup.LEAST_ESTIMATE - 0.1) or similarity < 0.7


def test_tile_links_seeking_members():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 5, 50, 6, 300)]
    table = pa.table({
        "node": [1, 2, 3, 4, 5], "component": [1, 1, 3, 4, 5], "seeking": [False, False, False, True, True],
        "items": pa.array([s.tobytes() for s in sets], pa.binary()),
    })
    assert near_dedup._tile(table).to_pylist() == [{"u": 4, "v": 1}]
    assert near_dedup._tile(table.slice(3)).num_rows == 0


def _pack(lengths, tiers, last=True):
    waiting = packing.Pieces()
    for doc, n in enumerate(lengths):
        waiting.add(np.arange(n, dtype="<u4"), doc, 0, n)
    return list(packing.pack_block(waiting, tiers, last)), waiting


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=80, deadline=None)
def test_windows_are_full_and_lose_nothing(lengths):
    windows, _ = _pack(lengths, (64, 32, 16))
    seen = {doc: np.zeros(n, int) for doc, n in enumerate(lengths)}
    for tier, window in windows:
        for ids, doc, start, total in window:
            assert total == lengths[doc] and ids.tolist() == list(range(start, start + len(ids)))
            seen[doc][start : start + len(ids)] += 1
    assert all((s == 1).all() for s in seen.values())
    full = [sum(len(p[0]) for p in w) == t for t, w in windows]
    assert all(full[:-1])


def test_steps_are_even():
    windows = [(64, [(np.zeros(n, "<u4"), 0, 0, n) for n in sizes]) for sizes in [(64,), (32, 32), (16,) * 4, (64,)] * 4]
    steps = packing.steps(windows, 5, 256)
    assert sorted(np.bincount(steps)[5:].tolist()) == [4, 4, 4, 4]
    cost = np.bincount(steps, [sum(len(p[0]) ** 2 for p in w) for _, w in windows])[5:]
    assert cost.max() - cost.min() <= 64**2 // 2


def _local(docs, shards, block):
    """All steps of the passage removal, without Spark."""
    by = lambda t, k: [t.filter(pc.equal(t.column(k), v)) for v in sorted(set(t.column(k).to_pylist()))]
    of = lambda t, s: t.filter(pc.equal(t.column("shard"), s))
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("place", pa.int64())])
    rows = [(p % shards, i, t or "", p) for p, (i, t) in enumerate(docs)]
    tables = by(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema), "shard")
    heard = pa.concat_tables([suffix_dedup._announce(t, 50, 256) for t in tables])
    empty = suffix_dedup._table([], ["shard", "bucket", "payload", "kind"], [pa.int64(), pa.int64(), pa.binary(), pa.int32()])
    shared = pa.concat_tables([empty, *map(suffix_dedup._agree, by(heard, "bucket"))])
    sent = pa.concat_tables([suffix_dedup._send(t, of(shared, t.column("shard")[0]), 50, 256) for t in tables])
    side = pa.concat_tables([shared, *(suffix_dedup._judge(t, 50, block) for t in by(sent, "bucket"))])
    out = [r for t in tables for r in suffix_dedup._cut(t, of(side, t.column("shard")[0]), 50, 256, ["place"], False).to_pylist()]
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in out)
    return [(r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept"]) for r in sorted(out, key=lambda r: r["place"])]


@pytest.mark.parametrize("seed", range(25))
def test_passage_removal(seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 300)
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(60, 300))) for _ in range(4)]
    docs = []
    for i in range(rnd.randint(1, 14)):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            b = rnd.choice(base)
            a = rnd.randint(0, len(b))
            parts.append(rnd.choice([b, b[a:], b[:a], "q" * rnd.randint(0, 120), "".join(rnd.choices("xyz ", k=70))]))
        docs.append((rnd.choice([i, i // 2]), "".join(parts) if rnd.random() > 0.05 else None))
    right = [r[1:] for r in brute.repeats(docs)]
    assert _local(docs, rnd.choice([1, 2, 3]), rnd.choice([200, 1000, 1 << 22])) == right


def test_passages_of_common_words_are_not_sent(monkeypatch):
    """Grams of sixteen bytes that many documents have don't make their text travel; repeated windows do."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefgh", k=17)) for _ in range(200)]  # every gram is common, two words in a row are rare
    docs = [(i, " ".join(rnd.choices(words, k=40))) for i in range(60)]
    docs += [(60, "x" * 30 + docs[3][1][100:160]), (61, "y" * 30 + docs[9][1][50:99])]
    sent = []
    send = suffix_dedup._send
    monkeypatch.setattr(suffix_dedup, "_send", lambda *a: sent.append(send(*a)) or sent[-1])
    out = _local(docs, 3, 1 << 20)
    assert out == [r[1:] for r in brute.repeats(docs)]
    assert out[60][1] >= 60
    sizes = [s for t in sent for x in t.column("sizes").to_pylist() for s in np.frombuffer(suffix_dedup._unsqueezed(x), "<u4")]
    assert sum(sizes) < 0.4 * sum(len(t) for _, t in docs)


def test_hashes_of_a_bucket_are_packed():
    for hashes in ([], [0], [2**32 - 1], [0, 1, 255, 256, 2**24, 2**32 - 1]):
        numbers = np.array(hashes, np.uint64)
        assert suffix_dedup._unpacked_hashes(suffix_dedup._packed_hashes(numbers)).tolist() == hashes


def test_suffix_array_order():
    rnd = random.Random(9)
    for n in (1, 7, 8, 9, 200, 3000):
        data = bytes(rnd.choice(b"ab\x00\xff") for _ in range(n))
        order = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), 50)
        found = [data[p : p + 50] for p in order]
        assert sorted(order.tolist()) == list(range(n)) and found == sorted(found)


def test_context_costs():
    """Code lengths against a direct walk through the counts."""
    learn = {"x": [b"abcabcabd", b"abd"], "y": [b"bbbbacb"]}
    model = language.Model(learn, order=3, least_seen=1)

    def cost(name, before, byte):
        for k in range(min(3, len(before)), -1, -1):
            context = before[len(before) - k :]
            after = [(b"\0" * 3 + t)[p] for t in learn[name] for p in range(3, len(t) + 3) if (b"\0" * 3 + t)[p - k : p] == context]
            if after or k == 0:
                n, q, c = len(after), len(set(after)), after.count(byte)
                if c:
                    return c / (n + q)
                return q / (n + q) * (cost(name, context[1:], byte) if k else 1 / 256)
        raise AssertionError

    some = [b"abcab", b"bd", b"zzaz", b"", b"aaaa"]
    data, offsets = as_bytes(pa.array(some, pa.binary()))
    found = model.lengths(data, offsets)
    for t, bits in zip(some, found, strict=True):
        padded = b"\0" * 3 + t
        for name, b in zip(model.languages, bits, strict=True):
            right = -sum(np.log2(cost(name, padded[p - 3 : p], padded[p])) for p in range(3, len(padded)))
            assert b == pytest.approx(right, rel=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>t &am</title><script>var x = "</p>";</script></head><body class="has-sidebar">
<header>Site</header><nav><ul><li><a href=/a>{0}</a><li><a href=/b>b</a></ul></nav><div class="ad">{0} buy</div>
<div id="wrap"><div class="post"><h1>{0}&amp;&lt;b&gt;</h1><p><b>First {0}
 line<br><p>Second <i>{0}</i>,   &quot;ok&quot;.<div class="share">Share this</div></div></div>
<section class="comments"><p>nice {0} indeed, a long comment by a reader</p></section>
<form><p>Subscribe {0}</p></form><footer>&copy; {0}</footer>"""


def test_page_blocks_and_region():
    pages = [PAGE.format(x) for x in ("alpha", "beta beta", "gamma")]
    trees = [html_extract.tree_of(list(html_extract.blocks_of(p))) for p in pages]
    whole = trees[0]
    for t in trees[1:]:
        html_extract.align(whole, t)
    whole = html_extract.Node.load(whole.dump())
    constant, region = html_extract.content_paths(whole)
    text = html_extract.main_text(list(html_extract.blocks_of(pages[1])), constant, region)
    assert text == 'beta beta&<b>\nFirst beta beta line\nSecond beta beta, "ok".'


def test_alignment_does_not_depend_on_grouping():
    pages = [PAGE.format(x) + tail for x, tail in zip("abcd", ("", "<p>x", "<div><p>y</div>", "<ul><li>z</ul>"), strict=True)]
    make = lambda p: html_extract.tree_of(list(html_extract.blocks_of(p)))
    one, left, right = make(pages[0]), make(pages[0]), make(pages[2])
    for p in pages[1:]:
        html_extract.align(one, make(p))
    html_extract.align(left, make(pages[1]))
    html_extract.align(right, make(pages[3]))
    html_extract.align(left, right)
    flat = lambda n, p=(): {(*p, n.label): (n.pages, n.chars, n.links, n.value, n.page)} | {
        k: v for c in n.children.values() for k, v in flat(c, (*p, n.label)).items()
    }
    assert flat(one) == flat(left)


@pytest.mark.parametrize("page", ["", "<", "plain &lt; text", "<p", "<a href='x>y", "<p>a<p>b</div></p>c", "<!-- x", "</p>" * 50])
def test_broken_pages_do_not_crash(page):
    assert all(t for _, t, _ in html_extract.blocks_of(page))
