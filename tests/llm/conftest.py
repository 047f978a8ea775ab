import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

LONG = " ".join(f"word{k} stands here" for k in range(30_000))
PASSAGE = "this passage of considerably more than fifty bytes is found in several documents of the table"
NEAR = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 2 + " ".join(
    f"tail{k}" for k in range(40)
)

#: doc_id, text: nulls, blanks, a very long text, copies that differ in white space or case, near copies, passages.
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "Word"), (6, "two words"), (7, "two\n\twords"), (8, LONG),
    (9, LONG), (10, NEAR), (11, NEAR + " more"), (12, NEAR + " more still"), (13, f"first {PASSAGE} end"),
    (14, f"Zweite Ähre é {PASSAGE}é und {PASSAGE}"), (15, PASSAGE[:49]), (16, "x" * 400), (17, "x" * 60 + "y" * 60),
    (18, "|||| #### !!!! 1234 ÀÉÎ 漢字 😀 \x00 <|endoftext|> <|im_end|>"), (19, "no letters"[:0] + "12 34 --"),
    (20, "﻿doc one\r\nline\r\nline\r\nline"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge cases as a table with columns whose names the operators use inside, repeated rows and rows without id."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i != 5 else None, 0) for i, t in EDGE]
    rows += [rows[5], (None, "no id", "en", "src0", 1), (None, "no id", "en", "src0", 1), (None, None, None, None, None)]
    return spark.createDataFrame(
        [(*r, "a", 1, [1], True, "b", 2) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long,"
        " row string, node int, key array<int>, kept boolean, _text string, shard int",
    )


@pytest.fixture(scope="session")
def plain():
    """The rows of ``edge`` with an id, without the repeated one."""
    return EDGE
