"""Tokenizing texts of many different words: distinct pieces as Arrow arrays, new ones encoded as joined texts.

Texts are cut only where tokens never go on, so each distinct piece is encoded once.  Pieces that may stand one after the
other without changing each other's ids are handed to the library thousands at a time, as one text; the widths of the ids
in bytes tell which belong to which piece.  Known pieces and their ids are two Arrow arrays.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from tokenizers import Tokenizer

from lodestar.llm.byte_bpe import token_bytes
from lodestar.llm.pieces import cut_points
from lodestar.llm.text_arrays import as_bytes, binary_array, packed

#: Distinct pieces that a worker remembers; beyond it starts anew.
REMEMBERED = 400_000
#: Pieces that are encoded as one text.
JOINED = 1024


class JoinedEncoder:
    """A tokenizer of a worker; ``bytes_of`` are the bytes of each id."""

    bytes_of: pa.Array

    def __init__(self):
        none = pa.array([], pa.large_binary())
        self.known, self.ids = none, none
        self.widths = np.diff(np.frombuffer(self.bytes_of.buffers()[1], np.int64))

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin, each text's end included."""
        raise NotImplementedError

    def joinable(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether pieces with these first and last bytes may be followed by others of this kind."""
        raise NotImplementedError

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's ids begin."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        cuts = self.cuts(data, offsets)
        coded = binary_array(data, cuts).dictionary_encode()
        flat, begins = as_bytes(self._found(coded.dictionary).take(coded.indices))
        begins = begins // 4
        return flat.view("<u4"), begins[np.searchsorted(cuts, offsets)]

    def _found(self, pieces: pa.Array) -> pa.Array:
        at = pc.index_in(pieces, value_set=self.known)
        if not at.null_count:
            return self.ids.take(at)
        missing = at.is_null().to_numpy(zero_copy_only=False)
        places = at.fill_null(0).to_numpy().copy()
        if len(self.known) + missing.sum() > REMEMBERED:
            self.known, self.ids = self.known[:0], self.ids[:0]
            missing[:] = True
        new = pieces.filter(pa.array(missing))
        places[missing] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.ids = pa.concat_arrays([self.ids, self._encoded(new)])
        return self.ids.take(pa.array(places))

    def _encoded(self, pieces: pa.Array) -> pa.Array:
        data, offsets = as_bytes(pieces)
        together = self.joinable(data[offsets[:-1]], data[offsets[1:] - 1])
        order, alone, parts, sizes = [], np.flatnonzero(~together), [], []
        chosen = np.flatnonzero(together)
        groups = [chosen[k : k + JOINED] for k in range(0, len(chosen), JOINED)]
        texts = [b"".join(pieces.take(pa.array(g)).to_pylist()).decode("utf-8", "replace") for g in groups]
        for group, found in zip(groups, self.ids_of(texts), strict=True):
            ids = np.array(found, "<u4")
            ends, wanted = np.cumsum(self.widths[ids]), np.cumsum(offsets[group + 1] - offsets[group])
            at = np.searchsorted(ends, wanted)
            if not len(ends) or ends[-1] != wanted[-1] or not np.array_equal(ends[at], wanted):
                alone = np.concatenate([alone, group])  # characters that the tokenizer changes: one by one
                continue
            order.append(group)
            parts.append(ids)
            sizes.append(np.diff(at, prepend=-1))
        single = [p.decode("utf-8", "replace") for p in pieces.take(pa.array(alone)).to_pylist()]
        singles = [np.array(found, "<u4") for found in self.ids_of(single)]
        flat = np.concatenate([np.zeros(0, "<u4"), *parts, *singles])
        lengths = np.concatenate([np.zeros(0, np.int64), *sizes, [len(x) for x in singles]]).astype(np.int64)
        order = np.concatenate([np.zeros(0, np.int64), *order, alone])
        ids = packed(flat, np.concatenate([[0], np.cumsum(lengths)]))
        return ids.take(pa.array(np.argsort(order)))


class ByteLevelEncoder(JoinedEncoder):
    """Byte-level BPE by the content of a tokenizers file; special tokens' strings are plain text."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes_of = token_bytes(self.tokenizer)
        super().__init__()

    def cuts(self, data, offsets):
        return cut_points(data, offsets)

    def joinable(self, first, last):
        return (first == 32) & (last > 32) & (last < 127)

    def ids_of(self, texts):
        return [made.ids for made in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceEncoder(JoinedEncoder):
    """A sentencepiece model for texts that begin with a space, which the model puts there itself.

    No piece goes on from another character to a space, so texts are cut before each space that follows one.
    """

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(a != "▁" and b == "▁" for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError("models with pieces that go on to a space are not supported")
        self.bytes_of = pa.array(
            [
                bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in enumerate(pieces)
            ],
            pa.large_binary(),
        )
        super().__init__()

    def cuts(self, data, offsets):
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        cut[offsets] = True
        return np.flatnonzero(cut)

    def joinable(self, first, last):
        return last != 32

    def ids_of(self, texts):
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids or [self.model.piece_to_id("▁")] for ids in found]
