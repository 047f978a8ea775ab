"""The pipeline against its stages done plainly."""

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import brute
import corpus_pipeline
from lodestar.llm.oracles import ORACLES


def expected(sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op9_quality_rules']}) WHERE kept").fetchall()}
    docs = [r for r in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if r[0] in good]
    first = {i for i, keep, _, _ in brute.exact(docs) if i == keep}
    docs = [r for r in docs if r[0] in first]
    near = brute.near(docs, 5)
    docs = [r for r in docs if near[r[0]][1] == r[0]]
    return [(i, kept.decode("utf-8", "ignore")) for i, _, _, _, kept in brute.repeats(docs)]


def test_pipeline(spark, sf):
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    right = {
        i: np.array(made.encode(text, add_special_tokens=False).ids + [0], "<u4").tobytes() for i, text in expected(sf)
    }
    found = {}
    for r in entry.queries()["pipeline"](spark, sf).collect():
        found.setdefault(r.doc_id, {})[r.start] = r.ids
    assert {i: b"".join(parts[k] for k in sorted(parts)) for i, parts in found.items()} == right


def test_stages_take_rows_with_nulls_and_clashing_columns(spark, edge, sf):
    docs = edge
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == edge.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and corpus_pipeline.ORACLE_SQL is None
