"""Byte-level BPE encoding and decoding by a rank file.

The tokenizers library merges characters, so each byte stands for a printable character, as in its byte-level models.
Encoding turns texts into ids and can give, per id, the characters it covers; decoding reverses the byte table.  An id
may hold a part of a character: bytes are joined over all ids before they are read as UTF-8.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from lodestar.llm.pieces import encoder
from lodestar.llm.text_arrays import as_bytes, binary_array, packed, slices, small_binary


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [chr(b) if b in printable else "" for b in range(256)]
    spare = iter(range(256, 512))
    return [c or chr(next(spare)) for c in out]


def read_ranks(text: str) -> dict[bytes, int]:
    """The tokens of a rank file: lines of a token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in text.splitlines() if line)}


def tokenizer_of(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """A tokenizers model that joins, as rank files ask, any two neighbours that make a token, lowest rank first."""
    table = byte_characters()
    spelled = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [
        (spelled[token[:k]], spelled[token[k:]])
        for token in sorted(ranks, key=ranks.get)
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    made = Tokenizer(
        models.BPE({spelled[t]: rank for t, rank in ranks.items()}, merges, ignore_merges=True, cache_capacity=0)
    )
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return made


def token_bytes(tokenizer: Tokenizer) -> pa.Array:
    """The bytes of each id, by reversing the byte table; ids that the vocabulary leaves out are empty."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = tokenizer.get_vocab()
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(back[c] for c in token)
    return pa.array(out, pa.large_binary())


def token_spans(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one character of each token, from a text's bytes and the tokens' lengths in bytes.

    A character that several tokens share belongs to each of them.
    """
    character = np.cumsum((data & 0xC0) != 0x80)  # the number of the character that each byte belongs to, from 1
    ends = np.cumsum(lengths)
    if not len(ends):
        return ends, ends
    return character[ends - lengths] - 1, character[ends - 1]


def _encode(batches: Iterator[pa.RecordBatch], model, with_spans: bool) -> Iterator[pa.RecordBatch]:
    made = encoder(f"ranks {hash(model.value)}", lambda: tokenizer_of(read_ranks(model.value[0]), model.value[1]))
    if with_spans and not hasattr(made, "widths"):
        made.widths = np.diff(np.frombuffer(token_bytes(made.tokenizer).buffers()[1], np.int64))
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = as_bytes(part.column("text"))
            ids, begins = made.encode(data, offsets)
            columns = [part.column("doc_id"), pa.array(np.diff(begins)), small_binary(packed(ids[: begins[-1]], begins))]
            names = ["doc_id", "n_tokens", "ids"]
            if with_spans:
                spans = [
                    token_spans(data[offsets[k] : offsets[k + 1]], made.widths[ids[begins[k] : begins[k + 1]]])
                    for k in range(part.num_rows)
                ]
                columns += [pa.array([s[j].tolist() for s in spans], pa.list_(pa.int64())) for j in (0, 1)]
                names += ["first", "last"]
            yield pa.RecordBatch.from_arrays(columns, names)


def encoded(docs: DataFrame, ranks: str, pattern: str, with_spans: bool = False) -> DataFrame:
    """Encode every row's text: ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit).

    ``ranks`` is the path of a rank file, read on the driver; each match of ``pattern`` is encoded apart, and no special
    tokens are added or recognised.  ``with_spans`` adds the arrays ``first`` and ``last``: the characters from first up
    to, not including, last that each id covers.  A null text counts as empty and has no ids; repeated rows and rows
    without id are encoded alike; other columns are ignored; an empty table gives no row.
    """
    with open(ranks, encoding="ascii") as f:
        model = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def encode(batches):
        return _encode(batches, model, with_spans)

    spans = ", first array<long>, last array<long>" if with_spans else ""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        encode, f"doc_id long, n_tokens long, ids binary{spans}"
    )


_TABLES: dict[int, pa.Array] = {}


def _decode(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    key = hash(model.value)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = token_bytes(tokenizer_of(read_ranks(model.value), "."))
    for batch in batches:
        for part in slices(batch, "ids"):
            flat, offsets = as_bytes(part.column("ids"))
            ids = np.frombuffer(flat.tobytes(), "<u4")
            found = _TABLES[key].take(pa.array(ids))
            ends = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
            data = np.frombuffer(found.buffers()[2], np.uint8) if len(ids) else np.zeros(0, np.uint8)
            decoded = small_binary(binary_array(data, ends[offsets // 4]))
            at = part.schema.get_field_index("ids")
            yield part.append_column("decoded", decoded).remove_column(at)


def decoded(rows: DataFrame, ranks: str) -> DataFrame:
    """Turn ``ids`` back into the bytes ``decoded``; the other columns stay.

    The text is ``decode(decoded, 'UTF-8')``: characters that ids split are whole again, because bytes are joined first.
    """
    with open(ranks, encoding="ascii") as f:
        model = rows.sparkSession.sparkContext.broadcast(f.read())
    kept = [f for f in rows.schema.fields if f.name != "ids"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded binary"])

    def decode(batches):
        return _decode(batches, model)

    return rows.mapInArrow(decode, schema)
