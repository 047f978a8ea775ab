"""The registered queries over the whole small tables, against SQL or plain versions."""

import base64
import hashlib
import html
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import brute
import compare
from lodestar.llm.oracles import ORACLES
from lodestar.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert compare.difference(spark, compare.connect(sf), sf, QUERIES[name], ORACLES[name]) is None


def test_every_query_is_checked():
    tested = {"op1_html_extract", "op3_language_id", "op4_near_dedup", "op5_packing", "op6_chat_format", "op7_byte_bpe",
              "op10_suffix_array_dedup", "op12_best_fit_packing", "op13_token_alignment"}
    assert set(QUERIES) == set(ORACLES) | tested


def test_html_extract(spark, sf):
    found = {r.page_id: r for r in QUERIES["op1_html_extract"](spark, sf).collect()}
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()
    assert len(found) == len(pages)
    for i, url, page in pages:
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        right = "\n".join(x for x in parts if x)
        assert (found[i].url, found[i].text, found[i].n_chars) == (url, right, len(right))


def test_language_id(spark, sf):
    found = QUERIES["op3_language_id"](spark, sf).collect()
    rows = {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, lang, text FROM '{sf}/documents.parquet'").fetchall()}
    assert len(found) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    unseen = [r.lang_pred == rows[r.doc_id][0] for r in found if r.held_out and r.lang_pred != "und"]
    assert len(unseen) > 20 and np.mean(unseen) > 0.98


def test_near_dedup(spark, sf, docs):
    right = brute.near(docs, 2)
    found = QUERIES["op4_near_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == right
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(docs)


def test_packing(spark, sf, docs):
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    ids = {i: np.array(made.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in docs}
    rows = QUERIES["op5_packing"](spark, sf).collect()
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, whole in ids.items():
        assert _gapless(pieces[i]) == len(whole)
    sizes = [_gapless(w) for w in windows.values()]
    assert max(sizes) <= 1024
    assert sum(1024 - n for n in sizes if n & (n - 1)) <= 1024  # one partition: one sequence is padded at most


def _gapless(parts):
    end = 0
    for start, length in sorted(parts):
        assert start == end and length > 0
        end += length
    return end


def test_chat_format(spark, sf):
    rows = duckdb.sql(
        f"SELECT conv_id, turn, coalesce(role, ''), coalesce(text, '') FROM '{sf}/conversations.parquet' ORDER BY ALL"
    ).fetchall()
    said = "</s>[INST] ok [/INST]"
    turns = defaultdict(list, {-7: [("user", said), ("assistant", said)]})
    for c, _, role, text in rows:
        turns[c].append((role, text))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    right = {}
    for c, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        right[c] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss))
    found = QUERIES["op6_chat_format"](spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == right
    assert all(r.formatted_chars > r.loss_chars for r in found)


def test_byte_bpe(spark, sf, docs):
    ranks = {
        base64.b64decode(a): int(b)
        for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))
    }
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in QUERIES["op7_byte_bpe"](spark, sf).collect()}
    for i, text in docs:
        ids = np.array(right.encode_ordinary(text or ""), "<u4")
        r = found[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_suffix_array_dedup(spark, sf, docs):
    found = {r.doc_id: r for r in QUERIES["op10_suffix_array_dedup"](spark, sf).collect()}
    for i, n, gone, spans, kept in brute.repeats(docs):
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, gone, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
