"""Whole jobs: corpus build, batch answering, the evaluation run and its reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import bind, chunking, evaluate, extract, fusion, inference, prompts, retrieval, telemetry, vectors
from lodestar.plans import generations
from lodestar.plans.staging import staged
from lodestar.schemas import CODE, DOCUMENT, ENRICHMENT
from lodestar.sources import readers, writers

# ``embed(df, text=column, out=column) -> DataFrame``
Embed = Callable[..., DataFrame]

# Fixed value: the content types loaded into the default index.
FULL_INDEX = {"full": (CODE, ENRICHMENT, DOCUMENT)}


def build_corpus(
    spark: SparkSession,
    java_root: str,
    doc_paths: list[str],
    out: str,
    chat: inference.ChatModel,
    embed: Embed,
    indexes: dict[str, tuple[str, ...]] = FULL_INDEX,
) -> dict[str, DataFrame]:
    """Scan, extract, bind, enrich, chunk, embed and load; every stage is a table below ``out``.

    Running it again gives what a build into an empty folder gives, but asks the models for new texts only: what is gone
    from the sources goes from links, answers, vectors and index members, and new paragraphs are bound to old nodes.
    """
    files = readers.scan_java(spark, java_root)
    for path in doc_paths:
        files = files.unionByName(readers.scan_docs(spark, path))
    taken, rejects = readers.route(files)

    java = taken.filter(F.col("source_type") == "java")
    declared = writers.save_table(extract.type_declarations(java), f"{out}/declarations")
    nodes = writers.save_table(
        extract.class_nodes(declared).withColumnRenamed("source_id", "node_id"), f"{out}/class_nodes"
    )
    writers.save_table(rejects.unionByName(extract.broken_files(declared)), f"{out}/rejects")
    paragraphs = writers.save_table(extract.paragraphs(taken), f"{out}/paragraphs")

    enriched = enrich_nodes(spark, nodes, paragraphs, out, chat)
    texts = nodes.join(enriched.drop("links"), "node_id").withColumnRenamed("node_id", "source_id")
    chunked = writers.save_table(chunking.chunks(texts, paragraphs), f"{out}/chunks", partition_by=("content_type",))
    sources = writers.save_table(
        nodes.select(F.col("node_id").alias("source_id"), "source_name", "content").unionByName(
            paragraphs.select("source_id", F.col("paragraph_name").alias("source_name"), "content")
        ),
        f"{out}/sources",
    )
    load_indexes(spark, chunked, indexes, out, embed)
    return {
        "class_nodes": nodes,
        "paragraphs": paragraphs,
        "enriched": enriched,
        "chunks": chunked,
        "sources": sources,
        "vectors": writers.read_vectors(spark, f"{out}/vectors"),
        "bindings": generations.current(spark, f"{out}/bindings"),
        "indexes": spark.read.parquet(f"{out}/indexes"),
        "index_members": generations.current(spark, f"{out}/index_members"),
    }


def bind_nodes(spark: SparkSession, nodes: DataFrame, paragraphs: DataFrame, out: str) -> DataFrame:
    """Bring the stored links up to date: only new nodes meet all paragraphs, old nodes just the new ones.

    ``paragraphs(paragraph_id, content)``.  The links are stored before the states they belong to, and merging a state in
    twice changes nothing, so a build that ends in between is made up for by the next.
    """
    kept = generations.current(spark, f"{out}/bindings")
    known = [generations.current(spark, f"{out}/bound_{side}") for side in ("nodes", "paragraphs")]
    if kept is None or None in known:
        links = bind.top_matches(nodes, paragraphs)
    else:
        links = bind.updated_matches(nodes, paragraphs, kept, *known)
    links = generations.replace(links, f"{out}/bindings")
    generations.replace(bind.state(nodes, "node_id", "signature"), f"{out}/bound_nodes")
    generations.replace(bind.state(paragraphs, "paragraph_id", "content"), f"{out}/bound_paragraphs")
    return links


def enrich_nodes(spark: SparkSession, nodes: DataFrame, paragraphs: DataFrame, out: str, chat: inference.ChatModel) -> DataFrame:
    """Bind all nodes and enrich those that are new or bound to other texts; failed ones are tried again next time.

    An answer belongs to a node and the digest of its ``links``; it goes when the node goes or its links change.
    """
    pieces = paragraphs.withColumnRenamed("source_id", "paragraph_id")
    matches = bind_nodes(spark, nodes, pieces, out)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "paragraph_id"))), lambda m: m["paragraph_id"].cast("string"))
    linked = matches.groupBy("node_id").agg(F.sha2(F.to_json(ordered), 256).alias("links"))
    wanted = nodes.join(linked, "node_id", "left").withColumn("links", F.coalesce("links", F.lit("")))
    done = generations.current(spark, f"{out}/enriched")
    pending = wanted
    if done is not None:
        done = done.join(wanted.select("node_id", "links"), ["node_id", "links"], "left_semi")
        pending = wanted.join(done.select("node_id"), "node_id", "left_anti")
    bound = matches.join(pending.select("node_id"), "node_id", "left_semi")
    asked = prompts.enrichment(pending, bind.bound_text(bound, pieces))
    fresh = writers.save_table(inference.enrich(asked, chat), f"{out}/enriched_last")
    writers.append_enrichment_audit(fresh.filter("processed"), f"{out}/enrichment_audit")
    answers = fresh.filter("processed").drop("prompt", "error").join(wanted.select("node_id", "links"), "node_id")
    return generations.replace(answers if done is None else answers.unionByName(done), f"{out}/enriched")


def load_indexes(
    spark: SparkSession, chunked: DataFrame, indexes: dict[str, tuple[str, ...]], out: str, embed: Embed
) -> None:
    """Bring every index up to date: vectors, the index table and its members.

    A chunk is embedded once, however many indexes hold it; chunks with a stored vector are not embedded again.  Vectors
    of chunks that are gone or have another text now go from every index, and what an index of ``indexes`` no longer takes
    goes from that index.
    """
    wanted = None
    for name, types in indexes.items():
        rows = vectors.select_types(chunked, types).select(F.lit(name).alias("index_name"), "chunk_id", "source_id", "content")
        wanted = rows if wanted is None else wanted.unionByName(rows)
    if wanted is None:
        return
    path, key = f"{out}/vectors", ["index_name", "chunk_id"]
    texts = chunked.select("chunk_id", F.sha2("content", 256).alias("digest"))
    members = generations.current(spark, f"{out}/index_members")
    if members is None:
        members = spark.createDataFrame([], "index_name string, chunk_id string")
    new = wanted.select("chunk_id", "content").dropDuplicates(["chunk_id"])
    stored = None
    if readers.exists(spark, path):
        loaded = generations.current(spark, f"{out}/loaded_texts")
        same = texts if loaded is None else texts.join(loaded, ["chunk_id", "digest"], "left_semi")
        here = writers.read_vectors(spark, path).select(*key)
        changed = here.join(same.select("chunk_id"), "chunk_id", "left_anti")
        unwanted = here.where(F.col("index_name").isin(*indexes)).join(wanted.select(*key), key, "left_anti")
        stale = writers.save_table(changed.unionByName(unwanted).distinct(), f"{out}/stale_last")
        writers.remove_vectors(stale, path)
        members = members.join(stale, key, "left_anti")
        stored = writers.read_vectors(spark, path)
        wanted = wanted.join(stored.select(*key), key, "left_anti")
        new = new.join(stored.select("chunk_id"), "chunk_id", "left_anti")
    made = embed(new, text="content", out="embedding").select("chunk_id", "embedding")
    made = writers.save_table(made, f"{out}/embedded_last")
    if stored is not None:
        again = stored.join(wanted.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
        made = made.unionByName(again.select("chunk_id", F.col("embedding").cast(made.schema["embedding"].dataType)))
    loaded = writers.save_table(wanted.drop("content").join(made, "chunk_id"), f"{out}/loaded_last")
    writers.append_vectors(loaded, path)
    _add_members(spark, chunked, members, list(indexes), out)
    generations.replace(texts, f"{out}/loaded_texts")


def _add_members(spark: SparkSession, chunked: DataFrame, members: DataFrame, names: list[str], out: str) -> None:
    """Record the indexes and the chunks whose vectors they hold."""
    known = spark.createDataFrame([], "index_name string")
    if readers.exists(spark, f"{out}/indexes"):
        known = spark.read.parquet(f"{out}/indexes")
    for name in names:
        vectors.ensure_index(known, name).coalesce(1).write.mode("append").parquet(f"{out}/indexes")
    known = spark.read.parquet(f"{out}/indexes")
    now = members
    for name in names:
        ids = writers.read_vectors(spark, f"{out}/vectors", name).select("chunk_id")
        now = now.unionByName(vectors.add_members(ids, chunked, known, members, name))
    generations.replace(now, f"{out}/index_members")


def embed_requests(requests: DataFrame, embed: Embed, path: str | None = None) -> DataFrame:
    """Embed sub-queries once and store them, at ``path`` if given: (request_id, query_no, embedding)."""
    short = retrieval.truncate_query(requests)
    return staged(embed(short, text="embedding_text", out="embedding").select("request_id", "query_no", "embedding"), path)


def retrieve_groups(requests: DataFrame, index: DataFrame, groups: tuple[tuple, ...]) -> DataFrame:
    """Answer all sub-queries under every configuration in one plan.

    ``requests(request_id, query_no, embedding)``, ``index(index_name, chunk_id, source_id,
    embedding)``, groups of (name, strategy, k, index name).  Configurations sharing an index share its scan.
    -> (group, request_id, source_id, query_no, score, chunk_ids, rrf_score, position)
    """
    key = F.concat_ws("#", F.col("request_id").cast("string"), F.col("query_no").cast("string"))
    queries = requests.select(key.alias("query_id"), "embedding")
    lists = None
    for name in sorted({g[3] for g in groups}):
        here = [g[:3] for g in groups if g[3] == name]
        fetch = max(retrieval.STRATEGIES[strategy][0](k) for _, strategy, k in here)
        hits = vectors.knn(queries, index.filter(F.col("index_name") == name), fetch)
        found = retrieval.retrieve_all(hits, here)
        lists = found if lists is None else lists.unionByName(found)
    request = F.regexp_extract("query_id", r"(?s)\A(.*)#\d+\z", 1).cast(requests.schema["request_id"].dataType)
    placed = lists.withColumn("request_id", request).withColumn(
        "query_no", F.substring_index("query_id", "#", -1).cast("int")
    )
    out = None
    for k in sorted({g[2] for g in groups}):
        routed = fusion.route(placed.filter(F.col("k") == k), requests, k, ("group", "request_id"))
        out = routed if out is None else out.unionByName(routed)
    return out


def documents(retrieved: DataFrame, sources: DataFrame) -> DataFrame:
    """(group, request_id, documents, texts): what was retrieved, in rank order, with its texts."""
    named = retrieval.attach_content(retrieved, sources)
    entry = F.struct("position", "source_id", "source_name", "chunk_ids", F.col("score").alias("similarity_score"), "rrf_score", "content")
    lists = named.groupBy("group", "request_id").agg(F.array_sort(F.collect_list(entry)).alias("_docs"))
    meta = lambda d: F.struct(
        *(d[f].alias(f) for f in ("source_id", "source_name", "chunk_ids", "similarity_score", "rrf_score"))
    )
    return lists.select(
        "group",
        "request_id",
        F.transform("_docs", meta).alias("documents"),
        F.transform("_docs", lambda d: F.coalesce(d["content"], F.lit(""))).alias("texts"),
    )


def run_evaluation(
    tasks: dict[str, DataFrame],
    index: DataFrame,
    sources: DataFrame,
    embed: Embed,
    chat: inference.ChatModel,
    groups: tuple[tuple, ...] = evaluate.GROUPS,
    work: str | None = None,
) -> DataFrame:
    """Every task input under every configuration: retrieve, prompt, generate.

    ``tasks`` maps a task name to its inputs.  -> (task, group, request_id, input, prompt,
    documents, response, error, duration, timestamp); ``input`` is the question or the pull
    request as JSON.  Write it out before using it more than once, as the model answers anew.
    The sub-queries of all tasks are embedded once and search each index once; both results are
    stored, below ``work`` if given.
    """
    asked = None
    for task, inputs in tasks.items():
        rows = prompts.TASKS[task][0](inputs).select(
            F.concat(F.lit(f"{task}:"), F.col("request_id").cast("string")).alias("request_id"), "query_no", "query"
        )
        asked = rows if asked is None else asked.unionByName(rows)
    requests = embed_requests(asked, embed, work and f"{work}/requests")
    retrieved = staged(retrieve_groups(requests, index, groups), work and f"{work}/retrieved")
    out = None
    for task, inputs in tasks.items():
        render = prompts.TASKS[task][1]
        own = F.substr("request_id", F.lit(len(task) + 2)).cast(inputs.schema["request_id"].dataType)
        mine = retrieved.filter(F.col("request_id").startswith(f"{task}:")).withColumn("request_id", own)
        rows = evaluate.matrix(inputs.select("request_id"), groups).select("request_id", "group")
        lists = rows.join(documents(mine, sources), ["group", "request_id"], "left")
        context = F.coalesce(prompts.numbered(F.col("texts")), F.lit(""))
        keyed = F.struct("group", "request_id")
        contexts = lists.select(keyed.alias("request_id"), context.alias("context"))
        per_group = rows.join(inputs, "request_id").withColumn("request_id", keyed).drop("group")
        rendered = render(per_group, contexts).select("request_id.group", "request_id.request_id", "prompt")
        answered = rendered.join(lists.select("group", "request_id", "documents"), ["group", "request_id"])
        named = answered.join(_inputs(inputs), "request_id").withColumn("task", F.lit(task))
        named = named.withColumn("request_id", F.col("request_id").cast("string"))
        out = named if out is None else out.unionByName(named)
    done = inference.generate(out, chat)
    return done.select(
        "task",
        "group",
        "request_id",
        "input",
        "prompt",
        "documents",
        "response",
        "error",
        F.col("duration_ms").alias("duration"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
    )


def _inputs(inputs: DataFrame) -> DataFrame:
    if "query" in inputs.columns:
        return inputs.select("request_id", F.col("query").alias("input"))
    pr = F.struct(F.col("request_id").alias("id"), "title", "description", "hunks")
    return inputs.select("request_id", F.to_json(pr, {"ignoreNullFields": "false"}).alias("input"))


def overlap_report(results: DataFrame) -> dict[str, DataFrame]:
    """Items, listings, Jaccard overlap and one-sided sources of an evaluation run."""
    compared = evaluate.compare_groups(results)
    return {
        "items": evaluate.items(results),
        "listing": evaluate.listing(results),
        "jaccard": evaluate.jaccard(compared),
        "only_in": evaluate.only_in(compared),
        "item_stats": evaluate.item_stats(results),
        "group_stats": evaluate.group_stats(results),
    }


def judge_prompts(results: DataFrame, project: str) -> dict[str, DataFrame]:
    """The judge prompts of one task's results: numbered pairs, and a prompt over all answers or one per pull request."""
    numbered = evaluate.pair_ids(results)
    return {
        "pairs": numbered.select("pair_id", "result_no", "task", "group", "item_id"),
        "answers": evaluate.answer_judge_prompts(numbered.filter(F.col("pr").isNull()), project),
        "descriptions": evaluate.description_judge_prompts(numbered.filter(F.col("pr").isNotNull()), project),
    }


def judge_report(spark: SparkSession, results_path: str, task: str, replies_path: str) -> DataFrame:
    """Mean scores per judge and group, from a result file and the files with the judges' replies."""
    numbered = evaluate.pair_ids(readers.read_eval_results(spark, results_path, task))
    judged = evaluate.parse_judgements(readers.read_numbered_lines(spark, replies_path))
    return evaluate.judge_scores(judged, numbered)


def pull_requests_from_diffs(pull_requests: DataFrame, diffs: DataFrame, path: str) -> None:
    """Store pull requests (id, title, description) with the hunks of their diffs (pr_id, diff)."""
    writers.save_pull_requests(extract.attach_hunks(pull_requests, diffs), path)


def latency_report(spark: SparkSession, log_path: str, csv_path: str | None = None) -> DataFrame:
    """Latency statistics of a log, with the events exported on request."""
    events = telemetry.parse_log(readers.read_log(spark, log_path))
    if csv_path is not None:
        writers.write_log_csv(events, csv_path)
    return telemetry.latency_stats(events)
