"""Quality rules by divergence from language references.

Each document has two histograms: characters by class and words by the most common short words of its language.  They
are compared by Jensen-Shannon distance (base 2, 0 to 1) to the pooled histograms of all documents of the language.
Texts that are mostly symbols, capitals, tables or lists of rare words lie far away.  DataFrame functions only; the
reference is learned from every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE, missing_as_empty, quoted
from lodestar.plans.staging import staged

#: The character classes: capitals, digits, marks, symbols, and every other character of a word.
CLASSES = ("upper", "digit", "mark", "symbol", "other")
MARKS = r".,;:!?'\"()\-"
SYMBOLS = "#*$%&|<>"

#: The most common words of a language that its histogram distinguishes, and their greatest length.
COMMON_WORDS = 24
COMMON_LENGTH = 4
#: So many references are broadcast; more are joined as Spark sees fit.  Every language has one of its own.
LANGUAGES = 200

#: Below so many words a text fails; below the second number its words are too few for a histogram.
MIN_WORDS = 50
MIN_WORDS_COMMON = 100
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.35


def _rest(pattern: str) -> Column:
    """Number of characters that stay when the pattern is deleted."""
    return F.length(F.regexp_replace("_text", pattern, "")).cast("long")


def _prepared(docs: DataFrame) -> DataFrame:
    """Words, short words and character classes of each row, and the row itself; a null text has no words."""
    split = docs.select(
        F.struct(*map(quoted, docs.columns)).alias("row"), "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), missing_as_empty().alias("_text")
    ).withColumn("_words", F.filter(F.split("_text", f"[{SPACE}]+"), lambda w: w != ""))
    counted = split.select(
        "row",
        "doc_id",
        "lang",
        "_text",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        _rest(f"[{SPACE}]+").alias("word_chars"),
        _rest(f"[^{SYMBOLS}]+").alias("symbol"),
        _rest(r"\P{Lu}+").alias("upper"),
        _rest(r"\P{Nd}+").alias("digit"),
        _rest(f"[^{MARKS}]+").alias("mark"),
        F.transform(F.filter("_words", lambda w: F.length(w) <= COMMON_LENGTH), F.lower).alias("_short"),
    )
    used = F.col("symbol") + F.col("upper") + F.col("digit") + F.col("mark")
    return counted.withColumn("other", F.col("word_chars") - used)


def repeated_words() -> Column:
    """Number of words inside 3-word windows that the text holds twice or more, the first included.

    Windows are compared by 64-bit hashes; only texts in which two agree are sorted, by hash and place.
    """
    starts = (
        "filter(transform(s, (x, j) -> struct(x.i AS i,"
        " (j > 0 AND s[greatest(j - 1, 0)].h = x.h) OR"
        " (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h) AS twice)), y -> y.twice)"
    )
    covered = (
        "aggregate(array_sort(transform(t, y -> y.i)), struct(-3 AS last, 0L AS n),"
        " (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n), a -> a.n)"
    )
    # transform(array(x), v -> ...)[0] names an intermediate result
    by_hash = "array_sort(transform(_windows, (h, i) -> struct(h AS h, i AS i)))"
    found = f"transform(transform(array({by_hash}), s -> {starts}), t -> {covered})[0]"
    return F.expr(f"CASE WHEN size(array_distinct(_windows)) = size(_windows) THEN 0L ELSE {found} END")


def base_figures(docs: DataFrame) -> DataFrame:
    """``_prepared`` with the figures of the base rules; everything stays in the row."""
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    windows = F.expr(
        "CASE WHEN size(_words) < 3 THEN CAST(array() AS array<bigint>) ELSE transform("
        "sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"
    )
    return (
        _prepared(docs)
        .withColumn("_lines", lines)
        .withColumn("_windows", windows)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words())
        .drop("_text", "_words", "_lines", "_windows")
    )


def references(docs: DataFrame) -> DataFrame:
    """One row per language, however many there are.

    ``words`` are its most common short words, ``word_share`` their shares of all words and then that of all other
    words, ``class_share`` the shares of ``CLASSES``.
    """
    prepared = _prepared(docs)
    # two scans, each with only what it needs: words of rows, and sums of whole documents
    # the inner form of explode would work the words out twice, see ``explode_rows``
    words = prepared.select("lang", F.explode_outer("_short").alias("word")).where(F.col("word").isNotNull())
    grouped = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = prepared.groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("n_words", *CLASSES)))
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (
        grouped.withColumn("_rank", F.row_number().over(common))
        .where(F.col("_rank") <= COMMON_WORDS)
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "word", "n"))).alias("top"))
    )
    chars = sum((F.col(c) for c in CLASSES), F.lit(0))
    known = F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    with_words = totals.join(top, "lang", "left").withColumn("top", F.coalesce("top", F.array()))
    return with_words.select(
        "lang",
        F.transform("top", lambda x: x["word"]).alias("words"),
        F.transform(
            F.concat(F.transform("top", lambda x: x["n"]), F.array(F.col("n_words") - known)),
            lambda n: F.when(F.col("n_words") > 0, n / F.col("n_words")).otherwise(0.0),
        ).alias("word_share"),
        F.array(*(F.when(chars > 0, F.col(c) / chars).otherwise(0.0) for c in CLASSES)).alias("class_share"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def quality_verdicts(
    docs: DataFrame,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Judge every row: the base figures, ``base_failed``, both distances, ``kept``, and ``row`` with all its columns.

    A null text has no words and fails; a missing ``lang`` is a language of its own.  Repeated rows are judged alike,
    each for itself; other columns are ignored, and an empty table gives an empty result.
    """
    refs = staged(references(docs))
    few = refs.limit(LANGUAGES + 1).count() <= LANGUAGES
    rows = base_figures(docs).join(F.broadcast(refs) if few else refs, "lang", "left")
    found = F.transform("_short", lambda w: F.array_position("words", w))
    rows = rows.withColumn("_found", F.filter(found, lambda i: i > 0)).withColumn(
        "_counts",
        F.transform(
            "words", lambda _, k: (F.size("_found") - F.size(F.array_remove("_found", (k + 1).cast("long")))).cast("long")
        ),
    )
    word_share = F.transform(
        F.concat("_counts", F.array(F.col("n_words") - F.size("_found"))), lambda n: n / F.greatest("n_words", F.lit(1))
    )
    class_share = F.array(*(F.col(c) / F.greatest("word_chars", F.lit(1)) for c in CLASSES))
    judged = rows.select(
        "row",
        "doc_id",
        "n_words",
        "word_chars",
        F.col("symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("word_chars") > 0, F.round(js_distance(class_share, F.col("class_share")), 6)).alias(
            "class_distance"
        ),
        F.when(
            F.col("n_words") >= MIN_WORDS_COMMON, F.round(js_distance(word_share, F.col("word_share")), 6)
        ).alias("word_distance"),
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & (
        F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance
    )
    return judged.withColumn("kept", ~F.col("base_failed") & near)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that ``quality_verdicts`` keeps.

    The row number keeps the optimizer from moving the filter below the figures, where it would work them out anew at
    each use.
    """
    judged = quality_verdicts(docs).withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    return judged.where("kept").select("row.*")
