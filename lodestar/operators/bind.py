"""Binding class nodes to the paragraphs that mention them.

A node has two keywords, its class name and the last part of its package; a paragraph matches
a keyword when it contains it, ignoring case.  A node keeps at most ``limit`` paragraphs:
all matches if they fit, otherwise those holding both keywords first.

Paragraph texts are read once, in place.  Each task walks its texts with one automaton over
all distinct keywords and keeps, per keyword and per keyword pair, only the ``limit + 1``
smallest paragraph ids; what is shuffled is that short list, never a text and never the
full set of matches.  That is enough to rebuild the exact answer.  Keywords that are too many
to ship are joined with the texts by their rarest grams, see ``grams``.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.grams import rare_gram_matches
from lodestar.plans.staging import staged

PARAGRAPHS_PER_NODE = 10  # fixed value
# Keyword characters shipped to every task at most; beyond that, the join on rare grams.
MAX_SHIPPED_CHARS = 2_000_000


def keywords(nodes: DataFrame) -> DataFrame:
    """Add ``class_name`` and ``package_name``, the last two dotted parts of ``signature``."""
    parts = F.split("signature", r"\.")
    return nodes.withColumn("class_name", F.element_at(parts, -1)).withColumn("package_name", F.element_at(parts, -2))


def unprocessed(nodes: DataFrame, enriched: DataFrame) -> DataFrame:
    """Nodes not enriched yet."""
    return nodes.join(enriched.select("node_id"), "node_id", "left_anti")


def top_matches(
    nodes: DataFrame,
    paragraphs: DataFrame,
    limit: int = PARAGRAPHS_PER_NODE,
    fill: str = "distinct",
    max_shipped: int = MAX_SHIPPED_CHARS,
) -> DataFrame:
    """``nodes(node_id, signature)`` x ``paragraphs(paragraph_id, content)`` ->
    (node_id, paragraph_id, pos, matches_all), paragraphs in id order.

    If more than ``limit`` paragraphs match, those matching both keywords come first and
    the rest is filled up with those matching one; ``fill="repeat"`` fills from all matches
    instead, so a paragraph may then appear twice.
    """
    keyed = keywords(nodes).select(
        "node_id", F.lower("class_name").alias("a"), F.lower("package_name").alias("b")
    )
    pairs = keyed.select("a", "b").distinct()
    first = _first_matches(pairs, paragraphs, limit, max_shipped)
    chosen = _choose(pairs, first, limit, fill)
    return keyed.join(chosen, ["a", "b"]).select("node_id", "paragraph_id", "pos", "matches_all")


def state(rows: DataFrame, key: str, text: str) -> DataFrame:
    """What ``updated_matches`` must know of an earlier state's nodes or paragraphs: (key, digest)."""
    return rows.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))


def updated_matches(
    nodes: DataFrame,
    paragraphs: DataFrame,
    kept: DataFrame,
    known_nodes: DataFrame,
    known_paragraphs: DataFrame,
    limit: int = PARAGRAPHS_PER_NODE,
    max_shipped: int = MAX_SHIPPED_CHARS,
) -> DataFrame:
    """The rows of ``top_matches(nodes, paragraphs, limit)``, from those of an earlier state and what has changed since.

    ``kept`` are the earlier rows, ``known_nodes`` and ``known_paragraphs`` the earlier ``state`` of both sides; a row
    with another digest is a new one in the place of one that is gone.  New nodes meet all paragraphs, the other nodes
    only new ones.  Links of what is gone go; a node that loses one of ``limit`` links may have had more matches than it
    kept, so it is bound anew.  ``kept`` and the states should be stored tables.
    """
    now_n, now_p = state(nodes, "node_id", "signature"), state(paragraphs, "paragraph_id", "content")
    same_n = now_n.join(known_nodes, ["node_id", "digest"], "left_semi").select("node_id")
    told = now_p.join(known_paragraphs.withColumn("held", F.lit(True)), ["paragraph_id", "digest"], "left")
    told = staged(told.select("paragraph_id", "held"))
    # texts meet the ids of new ones, few in a usual update, and not those of all others
    new_p = told.where("held IS NULL").select("paragraph_id")
    held = staged(kept.join(told.where("held"), "paragraph_id", "left"))
    short = held.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.count("held").alias("n_held"))
    short = short.where((F.col("n") >= limit) & (F.col("n_held") < F.col("n")))
    settled = staged(same_n.join(short, "node_id", "left_anti"))
    anew = top_matches(nodes.join(settled, "node_id", "left_anti"), paragraphs, limit, max_shipped=max_shipped)
    more = top_matches(
        nodes.join(settled, "node_id", "left_semi"), paragraphs.join(new_p, "paragraph_id", "left_semi"), limit, max_shipped=max_shipped
    )
    old = held.where("held").drop("held").join(settled, "node_id", "left_semi").withColumn("_new", F.lit(False))
    return _merged(old.unionByName(more.withColumn("_new", F.lit(True))), limit).unionByName(anew)


def _merged(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of kept and new links of each node, at most ``2 * limit`` rows a node."""
    node = W.partitionBy("node_id")
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(node)).withColumn("_n_new", F.count_if("_new").over(node))
    # links of one kind alone have their order; others go by id if all fit, else those with both keywords come first
    tier = (
        F.when((F.col("_n_new") == F.col("_n")) | (F.col("_n") >= limit) & (F.col("_n_new") == 0), F.col("pos"))
        .when((F.col("_n") <= limit) | F.col("matches_all"), 0)
        .otherwise(1)
    )
    place = F.row_number().over(node.orderBy("_tier", "paragraph_id")) - 1
    ranked = counted.withColumn("_tier", tier).withColumn("pos", place)
    return ranked.where(F.col("pos") < limit).select("node_id", "paragraph_id", "pos", "matches_all")


def counts(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Bound paragraphs per node, nodes without any included."""
    bound = matches.groupBy("node_id").agg(F.count("*").alias("n"))
    return nodes.select("node_id").join(bound, "node_id", "left").select(
        "node_id", F.coalesce("n", F.lit(0)).alias("n_paragraphs")
    )


def bound_text(matches: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Texts of the bound paragraphs of a node joined by newlines, in binding order."""
    text = matches.join(paragraphs.select("paragraph_id", "content"), "paragraph_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "content")))
    return text.groupBy("node_id").agg(ordered.alias("_texts")).select(
        "node_id", F.array_join(F.col("_texts.content"), "\n").alias("doc")
    )


def _first_matches(pairs: DataFrame, paragraphs: DataFrame, limit: int, max_shipped: int) -> DataFrame:
    """The smallest ``limit + 1`` paragraph ids per keyword (b null) and per pair."""
    texts = paragraphs.select("paragraph_id", F.lower("content").alias("content"))
    schema = f"a string, b string, paragraph_id {texts.schema['paragraph_id'].dataType.simpleString()}"
    keep = limit + 1
    size = pairs.agg(F.sum(F.length("a") + F.length("b") + 8)).first()[0] or 0
    if size <= max_shipped:
        shipped = pairs.sparkSession.sparkContext.broadcast(pairs.toArrow().to_pydict())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _Matcher(shipped.value["a"], shipped.value["b"], keep)
            for batch in batches:
                matcher.read(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield from matcher.table().to_batches()

        found = texts.mapInArrow(scan, schema)
    else:
        found = rare_gram_matches(pairs, texts, keep)
        every = texts.where("content IS NOT NULL").select("paragraph_id").orderBy("paragraph_id").limit(keep)
        blank = F.explode(F.array(F.lit(None).cast("string"), F.lit("")))  # in every text, so its first ids are the first
        found = found.unionByName(every.select(F.lit("").alias("a"), blank.alias("b"), "paragraph_id"))
    w = W.partitionBy("a", "b").orderBy("paragraph_id")
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


class _Matcher:
    """Keywords found in lower-cased texts; per keyword and per pair the ``keep`` smallest ids.

    Texts of a batch are read by ascending id, so a key that is full takes nothing more of the batch.  The automaton then
    has only words with an open key: each open pair needs one of its words there, the other is looked up when that is found.
    """

    def __init__(self, firsts: list[str], seconds: list[str], keep: int):
        self.keep = keep
        self.words = sorted(set(firsts) | set(seconds))
        number = {word: i for i, word in enumerate(self.words)}
        self.alone: list[list] = [[] for _ in self.words]
        self.both: dict[tuple[int, int], list] = {
            pair: [] for pair in sorted({(number[a], number[b]) for a, b in zip(firsts, seconds)})
        }
        self.always = {number[""]} if "" in number else set()
        self.watched: set[int] = set()

    def read(self, ids: list, texts: list[str | None], at_once: int = 1000) -> None:
        order = sorted((i for i in range(len(ids)) if texts[i] is not None), key=ids.__getitem__)
        for start in range(0, len(order), at_once):
            self._scan(ids, texts, order[start : start + at_once])

    def _scan(self, ids: list, texts: list[str], order: list[int]) -> None:
        smallest = ids[order[0]]
        alone = {w for w, held in enumerate(self.alone) if self._takes(held, smallest)}
        needed, partners = set(alone), {}
        for (a, b), held in self.both.items():
            if self._takes(held, smallest):
                longer = max(a, b, key=lambda w: len(self.words[w]))
                lead = a if a in alone else b if b in alone else longer
                needed.add(lead)
                partners.setdefault(lead, []).append((b if lead == a else a, held))
        self._watch(needed - self.always)
        for i in order:
            pid, text = ids[i], texts[i]
            words = self._words_in(text)
            for w in words & alone:
                if not self._offer(self.alone[w], pid):
                    alone.discard(w)
            for lead in words & partners.keys():
                open_keys = [
                    (other, held)
                    for other, held in partners[lead]
                    if not (other in words or self.words[other] in text) or self._offer(held, pid)
                ]
                if open_keys:
                    partners[lead] = open_keys
                else:
                    del partners[lead]

    def _watch(self, needed: set[int]) -> None:
        """Keep the automaton while it has all needed words and not many others."""
        if needed <= self.watched and len(needed) > 0.7 * len(self.watched):
            return
        self.watched = needed
        self.automaton = ahocorasick.Automaton()
        for w in needed:
            self.automaton.add_word(self.words[w], w)
        if needed:
            self.automaton.make_automaton()

    def _words_in(self, text: str) -> set[int]:
        return {w for _, w in self.automaton.iter(text)} | self.always if self.watched else set(self.always)

    def _takes(self, held: list, pid) -> bool:
        return len(held) < self.keep or pid < held[-1]

    def _offer(self, held: list, pid) -> bool:
        """Take ``pid`` if it is among the smallest; whether a larger one may still be taken."""
        if not self._takes(held, pid):
            return False
        if len(held) == self.keep:
            held.pop()
        insort(held, pid)
        return self._takes(held, pid)

    def table(self) -> pa.Table:
        rows = [(self.words[w], None, pid) for w, held in enumerate(self.alone) for pid in held]
        rows += [(self.words[a], self.words[b], pid) for (a, b), held in self.both.items() for pid in held]
        a, b, ids = zip(*rows) if rows else ((), (), ())
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "paragraph_id": pa.array(ids)})


def _choose(pairs: DataFrame, first: DataFrame, limit: int, fill: str) -> DataFrame:
    """Per keyword pair the paragraphs to keep: (a, b, paragraph_id, pos, matches_all)."""
    # Each pair looks up its keywords and itself; one join, so the texts are matched once.
    none = F.lit(None).cast("string")
    key = lambda k1, k2, both: F.struct(k1.alias("k1"), k2.alias("k2"), F.lit(both).alias("matches_all"))
    a, b = F.col("a"), F.col("b")
    keys = F.array_distinct(F.array(key(a, none, False), key(b, none, False), key(a, b, True)))
    asked = pairs.select("a", "b", F.explode(keys).alias("_k")).select("a", "b", "_k.*")
    ids = first.select(F.col("a").alias("f1"), F.col("b").alias("f2"), "paragraph_id")
    same = (F.col("k1") == F.col("f1")) & F.col("k2").eqNullSafe(F.col("f2"))
    merged = asked.join(ids, same).groupBy("a", "b", "paragraph_id").agg(F.max("matches_all").alias("matches_all"))
    pair = W.partitionBy("a", "b")
    by_id = pair.orderBy("paragraph_id")
    ranked = (
        merged.withColumn("_any", F.row_number().over(by_id))
        .withColumn("_n", F.count("*").over(pair))
        .withColumn("_all", F.count_if("matches_all").over(pair))
    )
    fits = F.col("_n") <= limit
    if fill == "repeat":
        short = F.least(F.col("_all"), F.lit(limit))
        again = F.when(~fits & F.col("matches_all") & (F.col("_any") <= limit - short), F.array(F.lit(0), F.lit(1)))
        usual = F.when(fits | F.col("matches_all"), F.array(F.lit(0))).otherwise(
            F.when(F.col("_any") <= limit - short, F.array(F.lit(1)))
        )
        ranked = ranked.withColumn("_tier", F.explode(F.coalesce(again, usual, F.array().cast("array<int>"))))
        tier = F.when(fits, 0).otherwise(F.col("_tier"))
    else:
        tier = F.when(fits | F.col("matches_all"), 0).otherwise(1)
    place = pair.orderBy("_t", "paragraph_id")
    return (
        ranked.withColumn("_t", tier)
        .withColumn("pos", F.row_number().over(place) - 1)
        .filter(F.col("pos") < limit)
        .select("a", "b", "paragraph_id", "pos", "matches_all")
    )
