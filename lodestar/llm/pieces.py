"""Byte-level BPE over Arrow texts, with each distinct piece of text encoded once.

Texts are cut only where the pre-tokenising pattern of the byte-level tokenizers always ends a match, so encoding the
pieces apart gives the ids of the whole.  Texts repeat their words a lot: the pieces of a batch are made distinct, the
tokenizers library encodes those not seen before in this worker, and the ids are put together again by index.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lodestar.llm.text_arrays import binary_array

#: Distinct pieces that a worker remembers; beyond it starts anew.
REMEMBERED = 400_000
#: Pieces that are handed to the library at once.
AT_ONCE = 4096


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces may begin: at each text, and inside texts where no match of the pattern can go on.

    A match never goes on from a letter to anything but a letter, nor from other characters to white space unless
    they are white space themselves.  The first rule is applied after ASCII letters, the second to spaces and line ends
    after visible ASCII and after the two-byte letters and signs from U+00C0 to U+07FF, none of which is white space.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, here = data[:-1], data[1:]
        lower = here | np.uint8(32)
        ascii_letter_before = ((before | np.uint8(32)) - np.uint8(97)) < 26
        not_letter = (here < 128) & ~((lower - np.uint8(97)) < 26)
        cut[1:-1] = ascii_letter_before & not_letter
        blank = (here == 32) | (here == 10)
        visible = (before > 32) & (before < 127)
        if len(data) > 2:
            lead = data[:-2]
            visible[1:] |= (before[1:] >= 128) & (lead >= 0xC3) & (lead <= 0xDF)
        cut[1:-1] |= blank & visible
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts by a byte-level tokenizer; keep one per worker."""

    def __init__(self, tokenizer: Tokenizer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        self.tokenizer = tokenizer
        self.known: dict[bytes, bytes] = {}

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [p for p in pieces if p not in known]
        for first in range(0, len(new), AT_ONCE):
            some = new[first : first + AT_ONCE]
            found = self.tokenizer.encode_batch_fast(
                [p.decode("utf-8", "replace") for p in some], add_special_tokens=False
            )
            known.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(some, found, strict=True))
        return [known[p] for p in pieces]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's ids begin."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        cuts = cut_points(data, offsets)
        coded = binary_array(data, cuts).dictionary_encode()
        ids = pa.array(self._ids_of(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        begins = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
        flat = np.frombuffer(ids.buffers()[2], "<u4")
        return flat, begins[np.searchsorted(cuts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(key: str, make) -> Encoder:
    """The encoder of this worker process for ``key``; ``make`` builds its tokenizer."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(make())
    return _ENCODERS[key]
