"""Evaluation: the run matrix, overlap between configurations, judge prompts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrays import explode_rows
from lodestar.functions.text import fill
from lodestar.plans.ordering import carry_forward, number_rows

# The compared configurations (strategy, k, index) and the pairs compared.
GROUPS = (
    ("adaptive_full", "adaptive", 20, "full"),
    ("simple_full", "fixed", 20, "full"),
    ("adaptive_plain", "adaptive", 20, "plain"),
)
COMPARISONS = (("adaptive_full", "adaptive_plain"), ("adaptive_full", "simple_full"))

# Fixed formats: a judge's heading and one line of its reply.
JUDGE_HEADING = r"^\s*\[([^\]]+)\]\s*$"
JUDGE_LINE = r"^\s*(\d+)::(\d+)::(.*)$"

# Judge prompts; ``<project>`` names the corpus under evaluation.
ANSWER_JUDGE = """\
You are an expert software engineer with extensive experience in <project>. Your task is to evaluate the quality of answers provided to questions about the project. A good answer should be relevant, accurate, and helpful in addressing the question asked. A bad answer provide unecessary, incorrect, or misleading information. 

<qa_pair>

Now look at the given question-answer pairs and give quality scores for each pair on a scale of 1 to 5. You should give a short reason less than 50 words for each determined score. You should output with this format:
{pair_id}::{score}::{reason}
"""

DESCRIPTION_JUDGE = """\
You are an expert software engineer with extensive experience in <project>. Your will be given a list of pull request descriptions written by others. Your task is to evaluate the quality of given pull request descriptions by referring to the original pull request details.

A code change description is a public record of change, and it is important that it communicates:
1. What change is being made? This should summarize the major changes such that readers have a sense of what is being changed without needing to read the entire CL. The description should be concise and to the point.
2. Why are these changes being made? What contexts did you have as an author when making this change? Were there decisions you made that aren't reflected in the source code? etc.

Original pull request details:
---------------
<pull_request>
---------------

Descriptions to be evaluated:
---------------
<generated_descriptions>
---------------

Now look at the original pull request and a list of pull request descriptions, and give quality scores for each description on a scale of 1 to 5. You should give a short reason less than 50 words for each determined score. You should output with this format:
{pair_id}::{score}::{reason}
"""


def matrix(inputs: DataFrame, groups: tuple[tuple, ...] = GROUPS) -> DataFrame:
    """Every (task, item) once per configuration: adds ``group, strategy, k, index_name``."""
    rows = F.array(
        *(
            F.struct(
                F.lit(name).alias("group"), F.lit(strategy).alias("strategy"), F.lit(k).alias("k"), F.lit(index).alias("index_name")
            )
            for name, strategy, k, index in groups
        )
    )
    return inputs.withColumn("_g", F.explode(rows)).select(*inputs.columns, "_g.*")


def items(results: DataFrame) -> DataFrame:
    """Results and distinct groups per item."""
    return results.groupBy("task", "item_id").agg(
        F.count("*").alias("n_results"), F.count_distinct("group").alias("n_groups")
    )


def listing(results: DataFrame) -> DataFrame:
    """Ranked documents of each result: (task, group, item_id, position, source_name, similarity_score)."""
    keep = ["task", "group", "item_id"]
    rows = explode_rows(results.select(*keep, "documents"), keep, "documents", "_at", "_d")
    return rows.select(
        *keep, (F.col("_at") + 1).alias("position"), "_d.source_name", "_d.similarity_score"
    )


def compare_groups(results: DataFrame, comparisons: tuple[tuple[str, str], ...] = COMPARISONS) -> DataFrame:
    """One row per item and compared pair with the source-name sets of both sides.

    ``results(task, group, item_id, result_no, documents)``; a group occurring twice for an
    item counts with its last result.  ``missing`` names the group an item lacks.  Items
    with a single result are not compared.
    """
    sides = sorted({name for pair in comparisons for name in pair})
    names = F.sort_array(F.array_distinct(F.col("documents.source_name")))
    rows = results.select("task", "item_id", "group", "result_no", names.alias("names"))
    per_item = rows.groupBy("task", "item_id").agg(
        F.count("*").alias("_n"),
        *(F.max_by("names", F.when(F.col("group") == side, F.col("result_no"))).alias(f"_of_{side}") for side in sides),
    )
    pairs = F.array(
        *(
            F.struct(
                F.lit(a).alias("group_1"),
                F.lit(b).alias("group_2"),
                F.col(f"_of_{a}").alias("names_1"),
                F.col(f"_of_{b}").alias("names_2"),
            )
            for a, b in comparisons
        )
    )
    compared = per_item.filter(F.col("_n") > 1).select("task", "item_id", F.explode(pairs).alias("_c"))
    missing = F.when(F.col("names_1").isNull(), F.col("group_1")).when(F.col("names_2").isNull(), F.col("group_2"))
    return compared.select("task", "item_id", "_c.*").withColumn("missing", missing)


def jaccard(compared: DataFrame) -> DataFrame:
    """Overlap of the two name sets; 0 when both are empty, null when a group is missing."""
    both = F.size(F.array_intersect("names_1", "names_2"))
    either = F.size(F.array_union("names_1", "names_2"))
    there = F.col("missing").isNull()
    return compared.select(
        "task",
        "item_id",
        "group_1",
        "group_2",
        F.when(there, both).alias("n_both"),
        F.when(there, either).alias("n_either"),
        F.when(there, F.when(either > 0, F.round(both / either, 6)).otherwise(0.0)).alias("jaccard"),
        "missing",
    )


def only_in(compared: DataFrame) -> DataFrame:
    """Source names found by one side of a comparison but not by the other."""
    keep = ["task", "item_id", "group_1", "group_2"]
    side = lambda name, a, b: F.transform(
        F.array_except(a, b), lambda s: F.struct(F.col(name).alias("only_in"), s.alias("source_name"))
    )
    both = F.concat(side("group_1", "names_1", "names_2"), side("group_2", "names_2", "names_1"))
    rows = explode_rows(compared.select(*keep, both.alias("_only")), keep, "_only", "_at", "_o")
    return rows.select(*keep, "_o.only_in", "_o.source_name")


def item_stats(results: DataFrame) -> DataFrame:
    """Documents and similarity spread per (task, group, item)."""
    return listing(results).groupBy("task", "group", "item_id").agg(
        F.count("*").alias("n_documents"), *_spread("similarity_score")
    )


def group_stats(results: DataFrame) -> DataFrame:
    """Summary per (task, group): items, documents, distinct documents, similarity spread."""
    rows = results.select("task", "group", "item_id", F.posexplode_outer("documents").alias("_at", "_d"))
    grouped = rows.groupBy("task", "group").agg(
        F.count_distinct("item_id").alias("n_items"),
        F.count("_at").alias("n_documents"),
        F.count_distinct("_d.source_name").alias("n_unique"),
        *_spread("_d.similarity_score"),
    )
    return grouped.withColumn("documents_per_item", F.round(F.col("n_documents") / F.col("n_items"), 6))


def _spread(score: str) -> list[Column]:
    # Scores carry six digits: summed as whole millionths the mean does not depend on row order.
    millionths = F.round(F.col(score) * 1e6).cast("bigint")
    return [
        (F.round(F.avg(millionths)) / 1e6).alias("avg_similarity"),
        F.round(F.min(score), 6).alias("min_similarity"),
        F.round(F.max(score), 6).alias("max_similarity"),
    ]


def pair_ids(results: DataFrame) -> DataFrame:
    """Number results from 0 in ``result_no`` order, the ids judges refer to."""
    return number_rows(results, "result_no", "pair_id")


WITH_NULLS = {"ignoreNullFields": "false"}

# Consecutive pair ids that become one text before the texts of a prompt meet in its cell.
BLOCK = 1_000


def _block() -> Column:
    return F.floor(F.col("pair_id") / BLOCK).alias("_block")


def _json_items(*fields: str) -> Column:
    """JSON of the rows of a block by ``pair_id``, written row by row; missing values are written as null."""
    collected = F.array_sort(F.collect_list(F.struct("pair_id", *fields)))
    return F.array_join(F.transform(collected, lambda x: F.to_json(x, WITH_NULLS)), ",").alias("_items")


def _prompt(template: str, name: str, **values: Column | str) -> Column:
    """The template with the JSON array of a set's ``(_block, _items)`` at ``<name>``.

    The texts of the blocks are joined to the template at once: a cell may take much of a task's memory, and neither a
    transformed nor a joined copy of it is made on the way.
    """
    before, after = template.split(f"<{name}>")
    collected = F.array_sort(F.collect_list(F.struct("_block", F.array(F.lit(","), F.col("_items")).alias("_part"))))
    n_parts = (F.count(F.lit(1)) * 2 - 1).cast("int")
    parts = F.slice(F.flatten(collected["_part"]), F.lit(2), n_parts)
    return F.concat_ws("", fill(before + "[", **values), parts, fill("]" + after, **values)).alias("prompt")


def answer_judge_prompts(numbered: DataFrame, project: str, per_prompt: int | None = None) -> DataFrame:
    """The prompt over all of ``numbered(pair_id, query, response)``: (batch, prompt).

    A model that cannot take all pairs at once may be asked for ``per_prompt`` pairs at a time.  A prompt is one cell, so
    it ends at 2 GB; ``fragments`` has no such end.
    """
    batch = F.lit(0).cast("bigint") if per_prompt is None else F.floor(F.col("pair_id") / per_prompt)
    rows = numbered.select(
        batch.alias("batch"), _block(), "pair_id", F.col("query").alias("question"), F.col("response").alias("answer")
    )
    dealt = rows.repartition("_block" if per_prompt is None else "batch")
    blocks = dealt.groupBy("batch", "_block").agg(_json_items("question", "answer"))
    return blocks.groupBy("batch").agg(_prompt(ANSWER_JUDGE, "qa_pair", project=project))


def description_judge_prompts(numbered: DataFrame, project: str) -> DataFrame:
    """One prompt per pull request over ``numbered(pair_id, pr, response)``: (pr_id, prompt)."""
    rows = numbered.select(F.col("pr.id").alias("pr_id"), _block(), "pair_id", "pr", F.col("response").alias("description"))
    blocks = rows.repartition("pr_id", "_block").groupBy("pr_id", "_block").agg(
        _json_items("description"), F.min_by("pr", "pair_id").alias("pr"), F.min("pair_id").alias("_first")
    )
    pull_request = F.to_json(F.min_by("pr", "_first"), WITH_NULLS)
    prompt = _prompt(DESCRIPTION_JUDGE, "generated_descriptions", project=project, pull_request=pull_request)
    return blocks.groupBy("pr_id").agg(prompt)


def parse_judgements(judge_lines: DataFrame, block: int = 100_000) -> DataFrame:
    """``judge_lines(file, line_no, line)`` -> (file, judge, pair_id, score, reason).

    A ``[judge]`` line heads the ``pair::score::reason`` lines below it; the rest is ignored.
    """
    heading = F.nullif(F.regexp_extract("line", JUDGE_HEADING, 1), F.lit(""))
    wanted = judge_lines.filter(F.col("line").rlike(JUDGE_HEADING) | F.col("line").rlike(JUDGE_LINE))
    headed = carry_forward(wanted, "file", "line_no", heading, "judge", block)
    part = lambda i: F.regexp_extract("line", JUDGE_LINE, i)
    return headed.filter(F.col("line").rlike(JUDGE_LINE)).select(
        "file",
        "judge",
        part(1).try_cast("bigint").alias("pair_id"),
        part(2).try_cast("int").alias("score"),
        part(3).alias("reason"),
    )


def judge_scores(judgements: DataFrame, numbered: DataFrame) -> DataFrame:
    """Mean score per judge and group; pairs are looked up by id."""
    scored = judgements.join(numbered.select("pair_id", "group"), "pair_id")
    return scored.groupBy("judge", "group").agg(
        F.count("*").alias("n_scores"), F.round(F.avg("score"), 6).alias("mean_score")
    )
