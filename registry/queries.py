"""One callable per operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import (
    bind,
    chunking,
    evaluate,
    extract,
    fragments,
    fusion,
    inference,
    prompts,
    retrieval,
    telemetry,
    vectors,
)
from lodestar.plans import jobs
from lodestar.plans.staging import staged
from lodestar.sources import readers
from registry import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(col: str):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",").alias(col)


# ------------------------------------------------------------------ models used here


def letter_counts(texts: list[str]) -> np.ndarray:
    """A toy embedding model: how often each letter a-z occurs."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return np.array([[t.lower().count(c) for c in letters] for t in texts], dtype=np.float32)


def prompt_length(texts: list[str]) -> list[str]:
    """A toy chat model: tells how long the prompt was."""
    return [f"{len(t)} characters" for t in texts]


def summarise(texts: list[str]) -> list[str]:
    """A toy chat model for enrichment: JSON for prompts of even length, prose otherwise."""
    return [
        json.dumps({"description": str(len(t)), "usage": "u", "relationship": "r"}) if len(t) % 2 == 0 else f"about {len(t)}"
        for t in texts
    ]


letter_embed = partial(inference.embed, model=letter_counts)

# ------------------------------------------------------------------ vectors and retrieval


def hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return vectors.knn(inputs.queries(spark, sf), inputs.vectors(spark, sf), k)


@query
def knn_cosine_topk(spark, sf):
    return hits(spark, sf, 10)


@query
def knn_block_grid(spark, sf):
    """Queries as rows that meet the vectors cell by cell, as knn does for query tables too large to ship."""
    return vectors.knn(inputs.queries(spark, sf), inputs.vectors(spark, sf), 10, max_shipped=1)


@query
def normalize_vectors(spark, sf):
    scaled = inputs.vectors(spark, sf).withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    )
    unit = vectors.normalize(scaled)
    return unit.select("chunk_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query
def hit_sources(spark, sf):
    found = retrieval.attach_sources(hits(spark, sf, 25), inputs.chunk_sources(spark, sf))
    return found.select("query_id", "chunk_id", "source_id", "score", "rank")


@query
def source_rollup(spark, sf):
    found = retrieval.attach_sources(hits(spark, sf, 25), inputs.chunk_sources(spark, sf))
    return retrieval.rollup(found).withColumn("chunk_ids", _joined("chunk_ids"))


@query
def fixed_k(spark, sf):
    found = retrieval.retrieve(hits(spark, sf, 20 + retrieval.FIXED_EXTRA), inputs.chunk_sources(spark, sf), "fixed", 20)
    return found.withColumn("chunk_ids", _joined("chunk_ids"))


@query
def adaptive_k(spark, sf):
    found = retrieval.retrieve(hits(spark, sf, retrieval.ADAPTIVE_FETCH), inputs.chunk_sources(spark, sf), "adaptive", 20)
    return found.withColumn("chunk_ids", _joined("chunk_ids"))


@query
def adaptive_k_scores(spark, sf):
    """The cut on score lists that reach all its branches."""
    lists = inputs.table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"),
        F.col("event_id").alias("source_id"),
        F.round(F.least(F.lit(1.0), F.col("value") / 100), 6).alias("score"),
    )
    return retrieval.adaptive_k(lists, 20)


def _lists(spark, sf):
    requests = inputs.requests(spark, sf)
    found = retrieval.retrieve(hits(spark, sf, 20 + retrieval.FIXED_EXTRA), inputs.chunk_sources(spark, sf), "fixed", 20)
    return requests, found.join(requests.select("query_id", "request_id", "query_no"), "query_id")


@query
def rrf_fusion(spark, sf):
    return fusion.rrf(_lists(spark, sf)[1], 20).withColumn("chunk_ids", _joined("chunk_ids"))


@query
def fusion_route(spark, sf):
    requests, lists = _lists(spark, sf)
    return fusion.route(lists, requests, 20).withColumn("chunk_ids", _joined("chunk_ids"))


@query
def truncate_query(spark, sf):
    return retrieval.truncate_query(inputs.table(spark, sf, "documents").select("doc_id", F.col("text").alias("query")))


# ------------------------------------------------------------------ index tables


def _members(spark, sf):
    chunks = inputs.typed_chunks(spark, sf)
    full = vectors.select_types(chunks, ["CODE", "ENRICHMENT", "DOCUMENT"]).select(F.lit("full").alias("index_name"), "chunk_id")
    plain = vectors.select_types(chunks, ["CODE", "DOCUMENT"]).select(F.lit("plain").alias("index_name"), "chunk_id")
    return full.unionByName(plain)


def _indexes(spark, sf):
    labels = inputs.table(spark, sf, "embeddings").select("label").distinct()
    return labels.select(F.concat(F.lit("index-"), F.col("label").cast("string")).alias("index_name"))


@query
def type_filter(spark, sf):
    return vectors.select_types(inputs.typed_chunks(spark, sf), ["CODE", "DOCUMENT"]).select("chunk_id", "content_type")


@query
def load_counts(spark, sf):
    return vectors.counts(_members(spark, sf), inputs.typed_chunks(spark, sf))


@query
def index_ensure(spark, sf):
    indexes = _indexes(spark, sf)
    return vectors.ensure_index(indexes, "full").unionByName(vectors.ensure_index(indexes, "index-1"))


@query
def index_members(spark, sf):
    """Add the chunks named by document ids to two indexes, of which one does not exist."""
    chunks = inputs.typed_chunks(spark, sf)
    ids = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    there = chunks.filter(F.col("content_type") == "CODE").select(F.lit("index-1").alias("index_name"), "chunk_id")
    add = partial(vectors.add_members, ids, chunks, _indexes(spark, sf), there)
    return add("index-1").unionByName(add("absent"))


# ------------------------------------------------------------------ extraction


@query
def pack_lines(spark, sf):
    return extract.pack_lines(inputs.plain_docs(spark, sf))


@query
def sections(spark, sf):
    return extract.sections(inputs.structured_docs(spark, sf))


@query
def pack_blocks(spark, sf):
    return extract.sections(inputs.structured_docs(spark, sf), 400)


@query
def type_declarations(spark, sf):
    return extract.type_declarations(inputs.java_files(spark, sf))


@query
def type_signature(spark, sf):
    """Signatures of the outermost declarations."""
    found = extract.type_declarations(inputs.java_files(spark, sf))
    return found.filter(F.col("pos") == 0).select("source_name", "signature")


@query
def source_identity(spark, sf):
    """Files of equal names in two folders: every declaration and paragraph is a source of its own."""
    folders = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("folder")
    java = inputs.java_files(spark, sf).select("source_name", "text", folders)
    java = java.withColumn("path", F.concat("folder", F.lit("/"), "source_name"))
    docs = inputs.plain_docs(spark, sf).withColumn("source_type", F.lit("pdf")).unionByName(
        inputs.structured_docs(spark, sf).withColumn("source_type", F.lit("asciidoc"))
    )
    docs = docs.select("source_name", "source_type", "text", folders)
    docs = docs.withColumn("path", F.concat("folder", F.lit("/"), "source_name"))
    nodes = extract.class_nodes(extract.type_declarations(java)).select(F.lit("node").alias("kind"), "source_id", "source_name", F.col("signature").alias("name"))
    paras = extract.paragraphs(docs).select(F.lit("paragraph").alias("kind"), "source_id", "source_name", F.col("paragraph_name").alias("name"))
    # Ids are hexadecimal; as bytes they take half the memory and shuffle.
    return nodes.unionByName(paras).groupBy("kind", "source_name", "name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.unhex("source_id")).alias("n_ids")
    )


@query
def extract_counts(spark, sf):
    nodes = extract.class_nodes(extract.type_declarations(inputs.java_files(spark, sf)))
    return extract.counts(nodes, extract.pack_lines(inputs.plain_docs(spark, sf)))


@query
def split_diff(spark, sf):
    return extract.split_diff(inputs.diffs(spark, sf))


@query
def attach_hunks(spark, sf):
    prs = inputs.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("PR "), F.col("doc_id").cast("string")).alias("title")
    )
    nested = extract.attach_hunks(prs, inputs.diffs(spark, sf))
    text = F.transform("hunks", lambda h: F.concat(h["filepath"], F.lit("="), h["content"]))
    return nested.select("id", "title", F.array_join(text, "|").alias("hunks"))


@query
def source_name(spark, sf):
    pages = inputs.table(spark, sf, "pages")
    return pages.select("page_id", readers.source_name(F.lit("markdown"), F.col("url")).alias("source_name"))


@query
def document_kind(spark, sf):
    """Routing by lower-cased extension; files no extractor takes are rejects."""
    endings = F.array(*(F.lit(e) for e in (".md", ".ADOC", ".pdf", ".txt", "")))
    files = inputs.table(spark, sf, "pages").select(
        "page_id", F.concat("url", endings[(F.col("page_id") % 5).cast("int")]).alias("path")
    )
    taken, left = readers.route(files.withColumn("source_type", readers.document_kind(F.col("path"))))
    return taken.select("path", "source_type").unionByName(left.select("path", F.col("reason").alias("source_type")))


# ------------------------------------------------------------------ chunking


@query
def clean_text(spark, sf):
    dirty = inputs.table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit("\u0000\u0007"), F.replace("text", F.lit(" "), F.lit(" \u001f")),
            F.lit('\t_serializedATN =\n  "'), "text", F.lit('";\r\nend\u007f'),
        ).alias("content"),
    )
    return chunking.clean_text(dirty)


@query
def content_type(spark, sf):
    given = F.when(F.col("source") == "src1", "CODE").when(F.col("source") == "src2", "DOCUMENT").when(F.col("source") != "src3", F.col("source"))
    return inputs.table(spark, sf, "documents").select("doc_id", chunking.content_type(given).alias("content_type"))


@query
def chunk_unpivot(spark, sf):
    return chunking.unpivot(inputs.processed_nodes(spark, sf), inputs.text_sources(spark, sf))


@query
def split_tokens(spark, sf):
    return chunking.split_tokens(inputs.text_sources(spark, sf), 50)


@query
def split_tokens_wide(spark, sf):
    return chunking.split_tokens(inputs.text_sources(spark, sf), 1500)


@query
def chunk_counts(spark, sf):
    """Clean, split and count the chunks of every source."""
    return chunking.counts(chunking.chunks(inputs.processed_nodes(spark, sf), inputs.text_sources(spark, sf), 100))


# ------------------------------------------------------------------ binding and enrichment


@query
def signature_keywords(spark, sf):
    rows = inputs.java_files(spark, sf)
    nodes = extract.type_declarations(rows).select("source_name", "pos", "signature")
    return bind.keywords(nodes)


@query
def unprocessed_anti(spark, sf):
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "source")
    done = inputs.table(spark, sf, "labels").select(F.col("doc_id").alias("node_id"))
    return bind.unprocessed(docs, done)


@query
def keyword_bind(spark, sf):
    return bind.top_matches(inputs.nodes(spark, sf), inputs.paragraphs(spark, sf))


@query
def incremental_bind(spark, sf):
    """Bind one half of the documents, then bring the links up to the whole table.

    The first state has the documents of even id, each third of them with another text, copies of all others under
    negative ids, and half of the nodes; so texts and nodes are added, changed and taken away.
    """
    nodes, paragraphs = inputs.nodes(spark, sf), inputs.paragraphs(spark, sf)
    pid, text = F.col("paragraph_id"), F.col("content")
    halves = paragraphs.withColumn("even", pid % 2 == 0)
    before = halves.select(
        F.when(F.col("even"), pid).otherwise(-1 - pid).alias("paragraph_id"),
        F.when(F.col("even") & (pid % 3 == 0), F.reverse(text)).otherwise(text).alias("content"),
    )
    first = nodes.where(F.crc32("node_id") % 2 == 0)
    kept = staged(bind.top_matches(first, before))
    known = staged(bind.state(first, "node_id", "signature")), staged(bind.state(before, "paragraph_id", "content"))
    return bind.updated_matches(nodes, paragraphs, kept, *known)


@query
def keyword_bind_grams(spark, sf):
    """The binding as with more keywords than are shipped to the tasks."""
    return bind.top_matches(inputs.nodes(spark, sf), inputs.paragraphs(spark, sf), max_shipped=0)


@query
def keyword_bind_repeat(spark, sf):
    return bind.top_matches(inputs.nodes(spark, sf), inputs.paragraphs(spark, sf), fill="repeat")


@query
def keyword_bind_counts(spark, sf):
    nodes = inputs.nodes(spark, sf)
    return bind.counts(nodes, bind.top_matches(nodes, inputs.paragraphs(spark, sf)))


def _enrichment_prompts(spark, sf):
    nodes, paragraphs = inputs.nodes(spark, sf), inputs.paragraphs(spark, sf)
    matches = bind.top_matches(nodes, paragraphs)
    return prompts.enrichment(nodes, bind.bound_text(matches, paragraphs))


@query
def prompt_enrichment(spark, sf):
    return _enrichment_prompts(spark, sf)


@query
def enrich_nodes(spark, sf):
    done = inference.enrich(_enrichment_prompts(spark, sf), summarise)
    return done.select("node_id", "description", "usage", "relationship", "processed")


@query
def parse_summary(spark, sf):
    rows = inputs.raw_replies(spark, sf).withColumn("_s", inference.parse_summary(F.col("raw")))
    return rows.select("event_id", "_s.*")


# ------------------------------------------------------------------ prompts


@query
def queries_answer(spark, sf):
    return prompts.queries_answer(_questions(spark, sf))


@query
def hunk_queries_interpretation(spark, sf):
    return prompts.queries_interpretation(inputs.pull_requests(spark, sf))


@query
def hunk_queries_review(spark, sf):
    return prompts.queries_review(inputs.pull_requests(spark, sf))


def _contexts(spark, sf, request_id, requests):
    """Sources of a request: every document belongs to one, dealt by id over the ``requests``."""
    docs = inputs.table(spark, sf, "documents").select(
        request_id.alias("request_id"),
        (F.floor(F.col("doc_id") / requests) + 1).alias("position"),
        F.col("text").alias("content"),
    )
    return prompts.context(docs)


def _questions(spark, sf):
    return inputs.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("request_id"), F.col("text").alias("query"))


@query
def prompt_answer(spark, sf):
    questions = _questions(spark, sf)
    n = questions.count()
    return prompts.answer(questions, _contexts(spark, sf, (F.col("doc_id") % n).cast("string"), n))


def _turn_contexts(spark, sf):
    """Every document belongs to one of the first two turns of a conversation."""
    n = inputs.table(spark, sf, "conversations").select("conv_id").distinct().count()
    d = F.col("doc_id")
    turn = F.concat_ws("-", (d % n).cast("string"), (F.floor(d / n) % 2).cast("string"))
    return _contexts(spark, sf, turn, 2 * n)


@query
def prompt_interpretation(spark, sf):
    return prompts.interpretation(inputs.pull_requests(spark, sf), _turn_contexts(spark, sf))


@query
def prompt_review(spark, sf):
    return prompts.review(inputs.pull_requests(spark, sf), _turn_contexts(spark, sf))


# ------------------------------------------------------------------ whole runs


def _corpus(spark, sf):
    """Documents as sources, cut into chunks of 200 tokens, embedded by letter counts."""
    docs = inputs.table(spark, sf, "documents")
    sources = docs.select(F.col("doc_id").alias("source_id"), F.col("source").alias("source_name"), F.col("text").alias("content"))
    kinds = F.when(F.col("source_id") % 3 == 0, F.lit("ENRICHMENT")).otherwise(F.lit("DOCUMENT"))
    cut = chunking.split_tokens(sources.select("source_id", "content"), 200)
    chunks = cut.withColumn("chunk_id", F.col("source_id") * 1000 + F.col("chunk_no")).withColumn("content_type", kinds)
    # The vector table is stored once and then searched under several configurations.
    embedded = staged(letter_embed(chunks, text="content", out="embedding").drop("content", "chunk_no"))
    full = vectors.select_types(embedded, ["ENRICHMENT", "DOCUMENT"]).withColumn("index_name", F.lit("full"))
    plain = vectors.select_types(embedded, ["DOCUMENT"]).withColumn("index_name", F.lit("plain"))
    return full.unionByName(plain), sources


@query
def embed_texts(spark, sf):
    rows = letter_embed(inputs.paragraphs(spark, sf), text="content", out="embedding")
    return rows.select("paragraph_id", F.posexplode("embedding").alias("dim", "value"))


@query
def answer_questions(spark, sf):
    """Questions through embedding, search, roll-up, cut, prompt and model."""
    index, sources = _corpus(spark, sf)
    runs = jobs.run_evaluation(
        {"query_answer": _questions(spark, sf)}, index, sources, letter_embed, prompt_length,
        (("adaptive_full", "adaptive", 20, "full"),),
    )
    return _flat(runs)


@query
def evaluation_runs(spark, sf):
    """Three tasks under three configurations, one plan."""
    index, sources = _corpus(spark, sf)
    prs = inputs.pull_requests(spark, sf)
    tasks = {"query_answer": _questions(spark, sf), "code_interpretation": prs, "code_review": prs}
    return _flat(jobs.run_evaluation(tasks, index, sources, letter_embed, prompt_length))


def _flat(runs):
    docs = F.transform(
        "documents", lambda d: F.concat(d["source_id"].cast("string"), F.lit(":"), F.array_join(d["chunk_ids"].cast("array<string>"), "+"))
    )
    return runs.select(
        "task", "group", "request_id", F.coalesce(F.array_join(docs, ","), F.lit("")).alias("documents"), "response", "error"
    )


@query
def hashed_embedding_search(spark, sf):
    """The built-in embedder: questions against whole documents."""
    docs = inputs.paragraphs(spark, sf)
    embedder = inference.hashing_embedder(docs, "content", 128)
    index = embedder(docs, "content").select(F.col("paragraph_id").alias("chunk_id"), "embedding")
    questions = embedder(_questions(spark, sf), "query").select(F.col("request_id").alias("query_id"), "embedding")
    return vectors.knn(questions, index, 10)


# ------------------------------------------------------------------ evaluation


def _results(spark, sf):
    """Three configurations over the vector table as result rows; every vector is a question.

    Questions labelled 0 lack one configuration, questions labelled 1 have one twice."""
    chunks = inputs.typed_chunks(spark, sf).withColumn("source_id", F.floor(F.col("chunk_id") / 4))
    requests = inputs.queries(spark, sf).select(F.col("query_id").alias("request_id"), F.lit(0).alias("query_no"), "embedding")
    index = vectors.select_types(chunks, ["CODE", "ENRICHMENT", "DOCUMENT"]).withColumn("index_name", F.lit("full")).unionByName(
        vectors.select_types(chunks, ["CODE", "DOCUMENT"]).withColumn("index_name", F.lit("plain"))
    )
    found = jobs.retrieve_groups(requests, index, evaluate.GROUPS)
    names = found.select(
        "group", "request_id", "position",
        F.concat(F.lit("s"), (F.col("source_id") % 60).cast("string")).alias("source_name"), "chunk_ids", "score",
    )
    entry = F.struct("position", "source_name", "chunk_ids", F.col("score").alias("similarity_score"))
    lists = names.groupBy("group", "request_id").agg(F.array_sort(F.collect_list(entry)).alias("documents"))
    labels = inputs.table(spark, sf, "embeddings").select(F.col("vec_id").alias("request_id"), "label")
    rows = lists.join(labels, "request_id").filter((F.col("label") != 0) | (F.col("group") != "adaptive_plain"))
    again = F.array(F.lit(0), F.lit(1))
    copies = F.when((F.col("label") == 1) & (F.col("group") == "simple_full"), again).otherwise(F.array(F.lit(0)))
    late = F.when(F.col("copy") == 1, F.slice("documents", 1, 3)).otherwise(F.col("documents"))
    return rows.withColumn("copy", F.explode(copies)).select(
        F.lit("query_answer").alias("task"), "group", F.col("request_id").alias("item_id"), F.col("copy").alias("result_no"), late.alias("documents")
    )


@query
def eval_matrix(spark, sf):
    turns = inputs.table(spark, sf, "conversations").select(
        F.lit("code_review").alias("task"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id")
    )
    questions = inputs.table(spark, sf, "benchmark").select(F.lit("query_answer").alias("task"), F.col("item_id").cast("string").alias("item_id"))
    return evaluate.matrix(turns.unionByName(questions))


@query
def eval_items(spark, sf):
    return evaluate.items(_results(spark, sf))


@query
def eval_listing(spark, sf):
    return evaluate.listing(_results(spark, sf))


@query
def group_jaccard(spark, sf):
    return evaluate.jaccard(evaluate.compare_groups(_results(spark, sf)))


@query
def compare_missing_group(spark, sf):
    compared = evaluate.compare_groups(_results(spark, sf))
    return compared.filter(F.col("missing").isNotNull()).select("task", "item_id", "group_1", "group_2", "missing")


@query
def only_in_group(spark, sf):
    return evaluate.only_in(evaluate.compare_groups(_results(spark, sf)))


@query
def item_stats(spark, sf):
    return evaluate.item_stats(_results(spark, sf))


@query
def group_stats(spark, sf):
    return evaluate.group_stats(_results(spark, sf))


@query
def pair_ids(spark, sf):
    return evaluate.pair_ids(inputs.answered(spark, sf)).select("pair_id", "result_no", "group")


@query
def judge_prompts_answers(spark, sf):
    return evaluate.answer_judge_prompts(evaluate.pair_ids(inputs.answered(spark, sf)), "the project")


@query
def judge_fragments_answers(spark, sf):
    return fragments.answer_fragments(evaluate.pair_ids(inputs.answered(spark, sf)), "the project")


@query
def judge_fragments_descriptions(spark, sf):
    return fragments.description_fragments(evaluate.pair_ids(inputs.answered(spark, sf)), "the project")


@query
def judge_prompts_batches(spark, sf):
    """For models that cannot take all pairs at once."""
    return evaluate.answer_judge_prompts(evaluate.pair_ids(inputs.answered(spark, sf)), "the project", 10)


@query
def judge_prompts_descriptions(spark, sf):
    return evaluate.description_judge_prompts(evaluate.pair_ids(inputs.answered(spark, sf)), "the project")


@query
def parse_judgements(spark, sf):
    return evaluate.parse_judgements(inputs.judge_lines(spark, sf), 64)


@query
def judge_scores(spark, sf):
    judged = evaluate.parse_judgements(inputs.judge_lines(spark, sf))
    return evaluate.judge_scores(judged, evaluate.pair_ids(inputs.answered(spark, sf)))


# ------------------------------------------------------------------ telemetry


@query
def log_parse(spark, sf):
    time = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return telemetry.parse_log(inputs.log_lines(spark, sf)).withColumn("timestamp", time)


@query
def latency_stats(spark, sf):
    return telemetry.latency_stats(telemetry.parse_log(inputs.log_lines(spark, sf)))


@query
def task_durations(spark, sf):
    """Wall-clock statistics of result rows per task and configuration."""
    rows = inputs.table(spark, sf, "events").select(
        F.col("event_type").alias("task"),
        F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group"),
        F.floor(F.col("value") * 1000).alias("duration_ms"),
    )
    return telemetry.latency_stats(rows, ("task", "group"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Search, roll-up, adaptive cut and fusion for all requests of the vector table."""
    requests = inputs.requests(spark, sf)
    index = inputs.vectors(spark, sf).withColumn("source_id", F.floor(F.col("chunk_id") / 4))
    near = vectors.knn(requests.select("query_id", "embedding"), index, retrieval.ADAPTIVE_FETCH)
    found = retrieval.retrieve(near, None, "adaptive", 20)
    lists = found.join(requests.select("query_id", "request_id", "query_no"), "query_id")
    return fusion.route(lists, requests, 20).withColumn("chunk_ids", _joined("chunk_ids"))


QUERIES["retrieval_flagship"] = flagship
