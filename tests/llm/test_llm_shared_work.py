"""The prefix trie, best-fit packing and token alignment against plain versions, with odd input."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import alignment, best_fit, prefix_trie
from lodestar.llm.byte_bpe import byte_characters
from lodestar.llm.joined import ByteLevelEncoder
from lodestar.llm.queries import QUERIES
from lodestar.llm.text_arrays import as_bytes

JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# prefix trie


def plain_trie(rows):
    """Every prefix of the rebuilt conversations, one by one."""
    turn_id = lambda z: hashlib.sha256(f"{len(z[1])}:{z[1]}{z[2]}".encode()).digest()[:16]
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn, role or "", text or ""))
    for own in found.values():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], turn_id(z)))
    built = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = c % 5 if c >= 0 else -(-c % 5)
        built[c] = [z[1:] for z in found.get(c - rest, [])[:h] + own[h:]]
    members, below = defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                below[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[k] for k in below[p])
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]),
                    leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(found):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[c] for c in names) for r in found.collect()), key=str)


def trie_of(table):
    return prefix_trie.trie(*prefix_trie.regrown(prefix_trie.turn_rows(table)))


SCHEMA = "conv_id long, turn long, role string, text string, pos int, level int, size int"


def conversations(spark, seed):
    """Ties, nulls, negative ids, absent bases, long conversations, equal ones and a repeated row."""
    pick = random.Random(seed)
    rows = []
    for c in [*range(-12, 30), 100]:
        for t in range(pick.choice([0, 1, 3, 9, 20, 40])):
            turn = pick.choice([t, None, 3]) if pick.random() < 0.3 else t
            text = pick.choice(["aé", "bb", None, ""]) if pick.random() < 0.6 else "x"
            rows.append((c, turn, pick.choice(["user", None]), text))
    rows += [(50 + k, t, "u", "same") for k in range(20) for t in range(30)] + rows[:1] + [(None, 1, "a", "b")]
    return rows, spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "RUN", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows, table = conversations(spark, seed)
    assert trie_rows(trie_of(table)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert trie_of(table).count() == 0


# best-fit packing


def test_best_fit_packing(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    rows = QUERIES["op12_best_fit_packing"](spark, sf).collect()
    check_packed(rows, docs)
    sizes = np.bincount([r.length for r in rows], minlength=1025)
    n = len({r.sequence_id for r in rows})
    assert n <= best_fit.fewest_bins(sizes) + 1


def check_packed(rows, docs, capacity=1024, crc=lambda r: r.ids_crc32):
    made = Tokenizer.from_file(JSON)
    made.encode_special_tokens = True
    ids = {i: made.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, crc(r)))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        end = 0
        for k, (piece, start, length, digest) in enumerate(sorted(own)):
            assert (piece, start) == (k, end) and (k == 0 or length == capacity)
            assert digest == zlib.crc32(np.array(ids[i][start : start + length], "<u4").tobytes())
            end += length
        assert end == len(ids[i]) and len(own) == -(-end // capacity)


def test_packing_of_odd_input(spark, edge, plain):
    rows = best_fit.packed_best_fit(edge.repartition(5), JSON, capacity=64, pool_pieces=40).collect()
    known = [r for r in rows if r.doc_id is not None and r.doc_id != 6]
    assert sorted(r.length for r in rows if r.doc_id == 6) == [3, 3]  # the repeated row
    assert sorted(r.length for r in rows if r.doc_id is None) == [1, 3, 3]
    made = {r.sequence_id for r in rows}
    assert len(made) == best_fit.fewest_bins(np.bincount([r.length for r in rows], minlength=65))
    whole = defaultdict(list)
    for r in known:
        whole[r.doc_id].append((r.start, bytes(r.ids)))
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    for i, text in plain:
        if i != 6:
            right = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
            assert b"".join(x for _, x in sorted(whole[i])) == right
    assert best_fit.packed_best_fit(edge.limit(0), JSON).count() == 0


def test_exchange_joins_gaps_of_partitions(spark):
    """Tasks with large pieces alone and tasks with small ones alone: only an exchange fills the gaps."""
    rows = [(k, " a" * (599 if k < 40 else 399)) for k in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartitionByRange(4, "doc_id")
    found = best_fit.packed_best_fit(table, JSON, capacity=1000).collect()
    assert len({r.sequence_id for r in found}) == 40
    check_packed(found, rows, 1000, lambda r: zlib.crc32(bytes(r.ids)))


def fewest(lengths, capacity):
    """The least number of bins, by trying all ways."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[k]:
                rest = list(rooms)
                rest.remove(r)
                place(k + 1, [*rest, r - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=8))
def test_bound_never_exceeds_the_optimum(lengths):
    bound = best_fit.fewest_bins(np.bincount(lengths, minlength=21).astype(np.int64))
    bins, offsets, left = best_fit.best_fit(np.array(lengths, np.int64), 20)
    assert bound <= fewest(sorted(lengths, reverse=True), 20) <= len(left)
    assert bound >= -(-sum(lengths) // 20) and bound >= sum(n > 10 for n in lengths)
    assert (np.bincount(bins, lengths, len(left)) + left == 20).all()


def test_piece_bounds():
    for total, capacity in combinations_with_replacement(range(1, 30), 2):
        bounds = best_fit.piece_bounds(capacity, total)
        assert bounds[0] == 0 and bounds[-1] == capacity and all(b - a == total for a, b in zip(bounds[1:], bounds[2:]))
    assert best_fit.fewest_bins(np.array([0, 10**30], object)) == 10**30


# token alignment


def test_joined_pieces_give_the_same_ids():
    made = ByteLevelEncoder(open(JSON, encoding="utf-8").read())
    pick = random.Random(5)
    parts = [" a", " b1", "  ", "\n", " é", " !", " 's", "x", " 漢", "<|endoftext|>", " don't", "1 2", "\t.", " A.B", " \u0301z"]
    texts = ["".join(pick.choice(parts) for _ in range(30)) for _ in range(300)]
    ids, begins = made.encode(*as_bytes(pa.array(texts, pa.large_string())))
    for k, text in enumerate(texts):
        right = made.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[begins[k] : begins[k + 1]].tolist() == right


def plain_alignment(docs):
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    back = {c: k for k, c in enumerate(byte_characters())}
    of_b = lambda i, p: bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
    figures, links, corpus = [], [], Counter()
    for i, text in docs:
        own, row = [], dict(doc_id=i, n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="")
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(back[c] for c in a.id_to_token(k)) for k in ids_a]
            bytes_b = [of_b(k, b.id_to_piece(k)) for k in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
                shared = sorted(set(ends_a) & set(ends_b))
                at_end_a, at_end_b = dict(zip(ends_a, ids_a)), dict(zip(ends_b, ids_b))
                own = [(at_end_a[x], at_end_b[x]) for x in shared]
                groups, before = [], 0
                at_a = at_b = 0
                for end in shared:
                    x, y = [], []
                    while at_a < len(ends_a) and ends_a[at_a] <= end:
                        x.append(str(ids_a[at_a]))
                        at_a += 1
                    while at_b < len(ends_b) and ends_b[at_b] <= end:
                        y.append(str(ids_b[at_b]))
                        at_b += 1
                    groups.append(",".join(x) + "|" + ",".join(y))
                    before = end
                assert before == ends_a[-1]
                sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
                row.update(n_a=len(ids_a), n_b=len(ids_b), n_groups=len(shared), n_links=len(own), groups_sha256=sha)
        corpus.update(own)
        figures.append(row)
        links.append(own)
    highest = defaultdict(int)
    for (_, k), n in corpus.items():
        highest[k] = max(highest[k], n)
    for row, own in zip(figures, links):
        row["n_best"] = sum(corpus[pair] == highest[pair[1]] for pair in own)
        row["count_sum"] = sum(corpus[pair] for pair in own)
    return sorted(figures, key=str)


def test_token_alignment(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    found = [r.asDict() for r in QUERIES["op13_token_alignment"](spark, sf).collect()]
    assert sorted(found, key=str) == sorted(({k: r[k] for k in found[0]} for r in plain_alignment(docs)), key=str)


def test_alignment_of_odd_input(spark, edge, plain, monkeypatch):
    more = ["  a  b ", "a\n b \n", "x▁y", "é漢😀 \x00 <s> <|endoftext|></s>", "▁", "   ", "a ", " ", "<unk><0x0A>", "①ﬁ"]
    docs = [*plain, plain[5], (None, "no id"), (None, "no id"), (None, None)]
    docs += [(100 + k, text) for k, text in enumerate(more)]
    extra = spark.createDataFrame(docs[len(plain) + 4 :], "doc_id long, text string")
    table = edge.unionByName(extra, allowMissingColumns=True).repartition(3)
    found = [r.asDict() for r in alignment.linked(table, JSON, PIECES).collect()]
    assert sorted(found, key=str) == sorted(({k: r[k] for k in found[0]} for r in plain_alignment(docs)), key=str)
    assert alignment.linked(edge.limit(0), JSON, PIECES).count() == 0
    rows = {r.doc_id: r for r in alignment.aligned(table, JSON, PIECES).collect()}
    assert len(rows[8].a_ids) == len(rows[8].a_groups) == 4 * next(r["n_a"] for r in found if r["doc_id"] == 8)
    assert np.frombuffer(rows[4].b_groups, "<u4").tolist() == sorted(np.frombuffer(rows[4].b_groups, "<u4").tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_terminals(widths_a, widths_b):
    a, b = np.cumsum(widths_a), np.cumsum(widths_b)
    if a[-1] < b[-1]:
        a = np.append(a, b[-1])
    elif b[-1] < a[-1]:
        b = np.append(b, a[-1])
    of_a, of_b = alignment.terminals(a, b)
    shared = sorted(set(a.tolist()) & set(b.tolist()))
    right = lambda ends: [b.tolist().index(next(s for s in shared if s >= e)) for e in ends.tolist()]
    assert (of_a.tolist(), of_b.tolist()) == (right(a), right(b))


def test_small_slots(spark, sf, monkeypatch):
    """Counts are those of the corpus, however many slots there are."""
    monkeypatch.setattr(alignment, "SLOT_PAIRS", 200)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).repartition(3)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    found = [r.asDict() for r in alignment.linked(docs, JSON, PIECES).collect()]
    assert sorted(found, key=str) == sorted(({k: r[k] for k in found[0]} for r in plain_alignment(plain)), key=str)
