"""Text expressions: trimming, line splitting, cleaning, greedy packing, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters up to and including the space are trimmed, as in a JVM ``trim()``.
BLANKS = "".join(chr(i) for i in range(33))

# What the cleaning step removes and the text it leaves behind.
CONTROL_CHARS = r"[\p{Cntrl}&&[^\r\n\t]]"
PARSER_TABLE = r'_serializedATN\s*=\s*"[\s\S]*?";'
PARSER_TABLE_SHORT = '_serializedATN = "<ANTLR_SERIALIZED_ATN>";'


def trim(text: Column) -> Column:
    """Strip every character <= U+0020 from both ends (Spark's own trim strips spaces only)."""
    return F.trim(text, F.lit(BLANKS))


def clean(text: Column) -> Column:
    """Null becomes "", control characters go, serialized parser tables shrink to a marker."""
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL_CHARS, "")
    return F.regexp_replace(stripped, PARSER_TABLE, re.sub(r"([\\$])", r"\\\1", PARSER_TABLE_SHORT))


def lines(text: Column) -> Column:
    """Split at newlines, dropping trailing empty lines; newline-only text has no lines."""
    body = F.rtrim(text, F.lit("\n"))
    return F.when((body == "") & (text != ""), F.array().cast("array<string>")).otherwise(
        F.split(body, "\n", -1)
    )


def pack(df: DataFrame, parts: str, out: str, max_chars: int, sep: str) -> DataFrame:
    """Add ``out``: the strings of array column ``parts`` packed greedily into paragraphs.

    A paragraph closes when the next part would push it over ``max_chars`` and it is not
    empty, so an over-long part stays whole.  Only lengths run through the fold; the text
    is sliced once per paragraph, so work stays linear in the size of the row.
    """
    gap = len(sep)

    def step(s: Column, size: Column) -> Column:
        closes = (s["used"] > 0) & (s["used"] + size > max_chars)
        return F.struct(
            F.when(closes, size + gap).otherwise(s["used"] + size + gap).alias("used"),
            (s["n"] + 1).alias("n"),
            F.when(closes, s["n"]).otherwise(s["start"]).alias("start"),
            F.when(closes, F.concat(s["spans"], F.array(_span(s["start"], s["n"]))))
            .otherwise(s["spans"])
            .alias("spans"),
        )

    zero = F.struct(
        F.lit(0).alias("used"),
        F.lit(0).alias("n"),
        F.lit(0).alias("start"),
        F.array().cast("array<struct<at:int,len:int>>").alias("spans"),
    )
    spans = F.aggregate(
        F.transform(F.col(parts), F.length),
        zero,
        step,
        lambda s: F.when(s["n"] == 0, s["spans"]).otherwise(
            F.concat(s["spans"], F.array(_span(s["start"], s["n"])))
        ),
    )
    text = F.transform(
        spans,
        lambda p: trim(F.concat(F.array_join(F.slice(F.col(parts), p["at"] + 1, p["len"]), sep), F.lit(sep))),
    )
    return df.withColumn(out, text)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("at"), (end - start).alias("len"))


def fill(template: str, **values: Column | str) -> Column:
    """Fill ``<name>`` placeholders by splitting the template once and concatenating.

    Values are never scanned for placeholders, so a text holding ``<context>`` is safe.
    """
    pieces = re.split(r"<(%s)>" % "|".join(map(re.escape, values)), template)
    cols = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            if piece:
                cols.append(F.lit(piece))
        else:
            value = values[piece]
            cols.append(F.lit(value) if isinstance(value, str) else F.coalesce(value, F.lit("")))
    return F.concat(*cols)


def numbered(items: Column) -> Column:
    """``1. first\\n2. second\\n`` from an array of strings."""
    return F.array_join(
        F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), ""
    )
