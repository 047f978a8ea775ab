"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of orders 0 to ``ORDER`` holds how often each byte followed.  A byte costs
its code length in the longest context; where the context has not seen it, the escape (as often as the context has
distinct followers) and the shorter context's cost are added.  The statistics are frozen after learning, so a text's
code length is a sum of fixed costs, exact and in any order.  The last bytes give a context node, node and byte give the
costs.  Counts are kept sparse, so memory grows with what was seen; while the table of all costs is small it is compiled
once, otherwise the costs of the places that a batch has are worked out, a few languages at a time.  Both give the same
costs.  The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.text_arrays import as_bytes, slices

ORDER = 3
#: A context of the longest order is a node of its own if all languages together saw it so often.
LEAST_SEEN = 3
#: The sample that is learned from: rows per language, and bytes, of which each language has an equal share.  Whole rows
#: are taken until the share is reached, at least one per language.
SAMPLE_ROWS = 300
SAMPLE_BYTES = 1 << 28
#: The table of all costs is compiled up to so many bytes; languages that are worked out together.
TABLE_BYTES = 1 << 28
TOGETHER = 8

UNKNOWN = "und"


class Model:
    """Costs in bits: ``symbol`` of a byte, ``node`` of the last symbols, ``costs`` of keys ``node * symbols + symbol``.

    ``seen[language][order]`` has the sorted contexts with their totals and distinct followers, and the sorted
    ``context * symbols + symbol`` with their counts.
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, least_seen: int = LEAST_SEEN, table_bytes: int = TABLE_BYTES):
        self.languages, self.order = sorted(texts), order
        total = sum(np.bincount(np.frombuffer(x, np.uint8), minlength=256) for t in texts.values() for x in t)
        seen = np.flatnonzero(total)
        # symbol 0 stands before a text, 1 for bytes never seen
        self.symbol = np.ones(256, np.int64)
        self.symbol[seen] = np.arange(len(seen)) + 2
        a = self.symbols = len(seen) + 2
        self.seen = [self.counted(self.stream(texts[name])) for name in self.languages]
        if order <= 1:
            nodes = np.arange(a**order)
        else:  # of the longest order only contexts that were seen, by all languages together
            found, place = np.unique(np.concatenate([c[order][0] for c in self.seen]), return_inverse=True)
            n = np.bincount(place, np.concatenate([c[order][1] for c in self.seen]), minlength=len(found))
            nodes = found[n >= least_seen]
        # nodes: all contexts of the last order but one, then the seen ones of the last
        self.base, self.nodes = a ** (order - 1), nodes
        self.node = np.arange(a**order) % self.base
        self.node[nodes] = self.base + np.arange(len(nodes))
        self.node = self.node.astype(np.int32)
        keys, n = (self.base + len(nodes)) * a, len(self.languages)
        self.cost = np.empty((keys, n), np.float32) if 4 * keys * n <= table_bytes else None
        for start in range(0, 0 if self.cost is None else keys, 1 << 20):
            some = np.arange(start, min(start + (1 << 20), keys))
            self.cost[some[0] : some[-1] + 1] = self.costs(some, 0, n)

    def counted(self, stream: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Of each order: contexts, their totals and distinct followers; contexts with a symbol, their counts."""
        out, here = [], stream[self.order :]
        for k in range(self.order + 1):
            codes = (self.contexts(stream, k) * self.symbols + here)[here > 0]
            codes, count = np.unique(codes, return_counts=True)
            contexts, first, distinct = np.unique(codes // self.symbols, return_index=True, return_counts=True)
            total = np.add.reduceat(count, first) if len(first) else count
            out.append((contexts, total, distinct, codes, count))
        return out

    def costs(self, keys: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Bits of the keys under the languages from ``start`` to ``stop``."""
        a, out = self.symbols, np.empty((len(keys), stop - start), np.float32)
        node, symbol = keys // a, keys % a
        longest = node >= self.base
        context = node.copy()
        context[longest] = self.nodes[node[longest] - self.base]

        def find(values, wanted):
            place = np.minimum(np.searchsorted(values, wanted), max(len(values) - 1, 0))
            return place, values[place] == wanted if len(values) else np.zeros(len(wanted), bool)

        for j in range(start, stop):
            cost = np.full(len(keys), 1 / 256)
            for k, (contexts, total, distinct, codes, count) in enumerate(self.seen[j]):
                last = context % a**k
                at, known = find(contexts, last)
                if k == self.order:
                    known &= longest
                at, last, of = at[known], last[known], symbol[known]
                place, hit = find(codes, last * a + of)
                own = distinct[at] * cost[known]
                own[hit] = count[place[hit]]
                cost[known] = own / (total[at] + distinct[at])
            out[:, j - start] = -np.log2(cost)
        return out

    def stream(self, texts: list[bytes]) -> np.ndarray:
        pad = np.zeros(self.order, np.int64)
        return np.concatenate([x for t in texts for x in (pad, self.symbol[np.frombuffer(t, np.uint8)])] or [pad])

    def contexts(self, stream: np.ndarray, order: int) -> np.ndarray:
        """The number of the ``order`` symbols before each place from ``self.order`` on."""
        out = np.zeros(max(len(stream) - self.order, 0), np.int64)
        for k in range(order, 0, -1):
            out = out * self.symbols + stream[self.order - k : len(stream) - k]
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language, in bits."""
        n = len(offsets) - 1
        at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * self.order, np.diff(offsets))
        stream = np.zeros(len(data) + n * self.order, np.int64)
        stream[at] = self.symbol[data]
        node = self.node[self.contexts(stream, self.order)]
        here = at - self.order
        keys = node[here] * np.int64(self.symbols) + stream[at]
        out = np.zeros((n, len(self.languages)))
        some = np.flatnonzero(np.diff(offsets))
        if not len(some):
            return out
        if self.cost is None:
            used, keys = np.unique(keys, return_inverse=True)
        for start in range(0, len(self.languages), TOGETHER):
            stop = min(start + TOGETHER, len(self.languages))
            cost = self.costs(used, start, stop) if self.cost is None else self.cost[:, start:stop]
            out[some, start:stop] = np.add.reduceat(cost[keys], offsets[some], axis=0, dtype=np.float64)
        return out


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learn every language from a bounded sample of rows with ``lang`` and ``text``: those with the smallest hashes.

    A language has at most ``sample_rows`` rows; beyond its first one they end where its share of ``sample_bytes`` is
    reached.  The sample is the only thing that comes to the driver.
    """
    usable = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    languages = usable.agg(F.count_distinct("lang")).first()[0]
    if not languages:
        return None
    by_hash = Window.partitionBy("lang").orderBy("hash", "doc_id", "digest")
    # repeated ids are told apart by their texts
    hashed = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"), F.xxhash64("text").alias("digest"), F.octet_length("text").alias("bytes"), "text")
    picked = (
        hashed.drop("text")
        .withColumn("place", F.row_number().over(by_hash))
        .where(F.col("place") <= sample_rows)
        .withColumn("sum", F.sum(F.col("bytes").cast("long")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("place") == 1) | (F.col("sum") <= sample_bytes // languages))
        .groupBy("doc_id", "lang", "digest")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    sample = (
        hashed.join(F.broadcast(picked), ["doc_id", "lang", "digest"])
        .groupBy("lang", "doc_id", "digest")
        .agg(F.first("text").alias("text"), F.first("times").alias("times"))
    )
    texts: dict[str, list[bytes]] = {}
    for row in sample.select("lang", "text", "times").collect():
        texts.setdefault(row.lang, []).extend([row.text.encode()] * row.times)
    return Model(texts)


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Model | None = model.value
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            letters = part.column("letters").to_numpy(zero_copy_only=False)
            names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            if m is not None:
                bits = m.lengths(*as_bytes(part.column("text")))
                best = bits.argmin(axis=1)
                with np.errstate(under="ignore"):
                    share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                names = [m.languages[b] if known else UNKNOWN for b, known in zip(best, letters, strict=True)]
                scores = np.where(letters, share, 0.0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """Predict every row's language from its text alone: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    ``score`` is the share of the best language when each is weighed by two to the minus its code length.  A text that
    is null or has no letter, or any text if nothing was learned, gives ``und`` with score 0.  Repeated rows are
    predicted alike; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        return _predict(batches, shared)

    return docs.select(
        F.col("doc_id").cast("long"),
        held_out().alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        "text",
    ).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
