"""Source texts into rows: type declarations, packed paragraphs, sections, diff hunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrays import explode_rows
from lodestar.functions.text import lines, pack, trim

PARAGRAPH_CHARS = 3000  # fixed value: longest packed paragraph

# ---------------------------------------------------------------- type declarations

PACKAGE = r"(?m)^\s*package\s+([\w.]+)\s*;"

# One scan over Java source: text that hides brackets, brackets, statement ends, type heads.
# The first part runs over everything of no interest without a match per word.
_JAVA = re.compile(
    r"""
    (?: [^\w"'/(){};]++ | (?! (?: class | interface | enum | record ) \b ) \w++ | / (?! [/*] ) )*+
    (?: (?P<skip> //[^\n]*+ | /\*.*?\*/ | \"{3}(?:\\.|.)*?\"{3} | "(?:\\.|[^"\\\n])*" | '(?:\\.|[^'\\\n])*' )
      | (?P<open> [({] ) | (?P<close> [)}] ) | (?P<end> ; )
      | (?P<head> (?<![\w$.@]) (?: (?P<kind> class | interface | enum ) \s+ (?P<name> [^\W\d][\w$]* )
                                | record \s+ (?P<record> [^\W\d][\w$]* ) \s* (?=[(<]) ) )
      | \w+ | . )
    """,
    re.VERBOSE | re.DOTALL,
)
_KIND_ORDER = {"class": 0, "interface": 0, "enum": 1, "record": 2}


def _declarations(text: str) -> tuple[list[tuple[int, int, str, str]], bool]:
    """(kind order, start, name, code) of every type in one file, and whether brackets match."""
    found, opened, pending = [], [], None
    start = 0  # where the declaration now being read begins
    for m in _JAVA.finditer(text):
        if m["open"]:
            owner = None
            if m["open"] == "{" and pending and pending[3] == len(opened):
                owner, pending = pending, None
            opened.append((m["open"], owner, start))
            if m["open"] == "{":
                start = m.end()
        elif m["close"]:
            if not opened:
                return found, False
            bracket, owner, outer = opened.pop()
            if owner:
                found.append((owner[0], owner[1], owner[2], text[owner[1] : m.end()]))
            if bracket == "{":
                inside_call = bool(opened) and opened[-1][0] == "("
                start = outer if inside_call else m.end()
        elif m["end"]:
            start = m.end()
        elif m["head"]:
            before = text[start : m.start("head")]
            begin = start + len(before) - len(before.lstrip())
            pending = (_KIND_ORDER.get(m["kind"], 2), begin, m["name"] or m["record"], len(opened))
    found.sort(key=lambda d: d[:2])
    return found, not opened


def type_declarations(files: DataFrame) -> DataFrame:
    """One row per class or interface, then enum, then record, nested types included.

    ``files(source_name, text)`` -> (source_name, pos, signature, content, parsed).  A file
    whose brackets do not match yields what was complete, with ``parsed`` false, and one row
    without a signature that marks it as broken.  A ``path`` comes along.

    Files are dealt to tasks by what they are: a table of very many small files may be one split, and what is extracted
    from it would be in one task.
    """
    package = F.regexp_extract(F.coalesce("text", F.lit("")), PACKAGE, 1).alias("package")
    where = ["path"] if "path" in files.columns else []
    dealt = files.repartition(F.xxhash64("source_name", "text", *where))
    named = dealt.select("source_name", "text", package, *where)
    schema = "source_name string, pos int, signature string, content string, parsed boolean"
    schema += ", path string" if where else ""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text, package, *path in zip(*(c.to_pylist() for c in batch.columns)):
                found, whole = _declarations(text or "")
                rows.extend((name, pos, f"{package}.{d[2]}", d[3], whole, *path) for pos, d in enumerate(found))
                if not whole:
                    rows.append((name, None, None, None, False, *path))
            if rows:
                columns = zip(["source_name", "pos", "signature", "content", "parsed", *where], zip(*rows))
                types = {"pos": pa.int32(), "parsed": pa.bool_()}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, types.get(c, pa.string())) for c, v in columns})

    return named.mapInArrow(scan, schema)


def signature(package: Column, name: Column) -> Column:
    """``package.Name``; a missing package leaves ``.Name``."""
    return F.concat(F.coalesce(package, F.lit("")), F.lit("."), name)


# ---------------------------------------------------------------- packed paragraphs


def pack_lines(docs: DataFrame, max_chars: int = PARAGRAPH_CHARS) -> DataFrame:
    """Plain text: lines packed into paragraphs (source_name, ordinal, paragraph_name, content); a ``path`` comes along."""
    where = [c for c in docs.columns if c == "path"]
    split = docs.select("source_name", *where, lines(F.col("text")).alias("_lines"))
    packed = pack(split, "_lines", "_texts", max_chars, " ")
    keep = ["source_name", *where, F.col("source_name").alias("_context")]
    return _named(explode_rows(packed, keep, "_texts", "ordinal", "content"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("paragraph_name", F.concat_ws("::", "_context", F.col("ordinal").cast("string"))).drop("_context")


# ---------------------------------------------------------------- sections

# Delimited blocks: headings and blank lines inside them do not count.
FENCES = ("----", "....", "++++", "////", "====", "****", "____", "```")
FENCE = (
    r"(?msd)^(-{4,}|\.{4,}|\+{4,}|/{4,}|={4,}|\*{4,}|_{4,}|`{3})(?:(?<=`)\w+)?[ \t]*$"
    r".*?(?:^\1[ \t]*$|\z)"
)
FENCE_FIRST = r"\A[^\n]*\n?"
FENCE_LAST = r"(?:\A|\n)(?:-{4,}|\.{4,}|\+{4,}|={4,}|\*{4,}|_{4,}|`{3})[ \t]*\z"
TITLE = r"(?d)\A\s*=[ \t]+\S.*"
NOT_CONTENT = r"\n(?::[\w!-]+:.*|//(?!/).*|\[[^\]\n]*\][ \t]*)(?=\n|\z)"
MARKER = r"[ \t]*(?:[*-]{1,5}|\.{1,5}|\d+\.)[ \t]+"
HELD = "\x01"  # stands for a newline inside a delimited block
LEVELS = range(1, 6)  # heading levels: "==" to "======"


def _where(df: DataFrame, text: str, marks: tuple[str, ...], then: Column) -> DataFrame:
    """Rewrite ``text`` by ``then``, but only in rows holding one of ``marks``.

    The search for a fixed string is far cheaper than the regular expressions it spares.
    """
    there = F.lit(False)
    for mark in marks:
        there = there | F.col(text).contains(mark)
    return df.withColumn(text, F.when(there, then).otherwise(F.col(text)))


def _held(text: Column) -> Column:
    """Turn every delimited block into one line, so that it is opaque to line rules."""
    inner = lambda b: F.regexp_replace(F.regexp_replace(b, FENCE_FIRST, ""), FENCE_LAST, "")
    held = lambda b: F.when(b.startswith("/"), F.lit("\n\n")).otherwise(
        F.concat(F.lit("\n\n" + HELD), F.translate(inner(b), "\n", HELD), F.lit("\n\n"))
    )
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    gaps = F.split(text, FENCE, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), blocks.alias("block"))
    glued = F.transform(pairs, lambda p: F.concat(p["gap"], F.when(p["block"].isNull(), "").otherwise(held(p["block"]))))
    return F.array_join(glued, "")


def _subsections(df: DataFrame, text: str, pos: str, piece: str, nested: str) -> DataFrame:
    """Explode a section text into its child sections, in order, followed by its own text.

    A heading opens a child when no earlier heading in the text has a smaller level.
    Texts start with a newline, so every heading follows one.
    """
    own = text
    for level in LEVELS:
        mark = "=" * (level + 1)
        here = F.col(own).contains(f"\n{mark} ") | F.col(own).contains(f"\n{mark}\t")
        cut = F.split(F.col(own), rf"\n(?={mark}[ \t]+\S)", -1)
        df = df.withColumn(f"_s{level}", F.when(here, cut).otherwise(F.array(own))).withColumn(
            f"_own{level}", F.col(f"_s{level}")[0]
        )
        own = f"_own{level}"
    children = F.concat(*(F.slice(F.col(f"_s{lv}"), 2, F.size(f"_s{lv}")) for lv in reversed(LEVELS)))
    mark = lambda flag: lambda t: F.struct(t.alias("text"), F.lit(flag).alias("nested"))
    parts = F.concat(F.transform(children, mark(True)), F.array(mark(False)(F.col(own))))
    keep = [c for c in df.columns if c != text and not c.startswith(("_s", "_own"))]
    rows = explode_rows(df.select(*keep, parts.alias("_parts")), keep, "_parts", pos, "_part")
    return rows.select(*keep, pos, F.col("_part.text").alias(piece), F.col("_part.nested").alias(nested))


def _open(df: DataFrame, piece: str, nested: str, title: str, body: str) -> DataFrame:
    """Split a child section into its title and the text below it."""
    line = F.substring_index(piece, "\n", 1)
    rest = F.when(F.col(piece).contains("\n"), F.substr(piece, F.length(line) + 1)).otherwise("")
    return (
        df.withColumn(title, F.when(F.col(nested), trim(F.ltrim(line, F.lit("=")))))
        .withColumn(body, F.when(F.col(nested), rest).otherwise(F.col(piece)))
        .drop(piece, nested)
    )


def _blocks(df: DataFrame, body: str, out: str) -> DataFrame:
    """Blocks of a section text: paragraphs, list runs and delimited blocks; headings as text."""
    text = F.col(body)
    df = _where(df, body, ("\n==",), F.regexp_replace(text, r"\n={2,6}[ \t]+(\S.*)(?=\n|\z)", "\n\n$1\n"))
    df = _where(df, body, ("\n:", "\n//", "\n["), F.regexp_replace(text, NOT_CONTENT, ""))
    df = df.withColumn(body, F.regexp_replace(text, rf"\n({MARKER}.*)(?:\n[ \t]*)+(?=\n{MARKER})", "\n$1"))
    listed = lambda b: F.concat(trim(F.regexp_replace(b, rf"(?md)^{MARKER}", "")), F.lit("\n"))
    plain = lambda b: F.when(b.contains(HELD), F.translate(trim(b), HELD, "\n")).otherwise(trim(b))
    block = lambda b: F.when(b.rlike(rf"\A{MARKER}"), listed(b)).otherwise(plain(b))
    blocks = F.transform(F.split(text, r"\n[ \t]*\n\s*", -1), lambda b: block(F.ltrim(b, F.lit("\n"))))
    return df.withColumn(out, F.filter(blocks, lambda b: trim(b) != ""))


def sections(docs: DataFrame, max_chars: int = PARAGRAPH_CHARS) -> DataFrame:
    """Structured text: one run of paragraphs per document, section and sub-section.

    Sections nest to depth two; deeper ones fold into their ancestor, titles as text.
    Child sections come before the text of their parent.  Everything happens inside the
    row, so no shuffle.  -> (source_name, section_1, section_2, ordinal, paragraph_name, content)
    with (section_1, section_2, ordinal) the order of emission; a ``path`` comes along.
    """
    where = [c for c in docs.columns if c == "path"]
    df = docs.select("source_name", *where, F.coalesce("text", F.lit("")).alias("_text"))
    df = _where(df, "_text", ("\r",), F.regexp_replace("_text", r"\r\n?", "\n"))
    df = df.withColumn("_text", F.concat(F.lit("\n"), "_text"))
    df = _where(df, "_text", tuple("\n" + f for f in FENCES), _held(F.col("_text")))
    df = _where(df, "_text", ("\n=",), F.regexp_replace("_text", TITLE, ""))
    first = _open(_subsections(df, "_text", "section_1", "_p1", "_n1"), "_p1", "_n1", "_t1", "_b1")
    second = _open(_subsections(first, "_b1", "section_2", "_p2", "_n2"), "_p2", "_n2", "_t2", "_b2")
    context = F.concat_ws("::", "source_name", "_t1", "_t2").alias("_context")
    blocks = _blocks(second.select("source_name", *where, "section_1", "section_2", context, "_b2"), "_b2", "_blocks")
    packed = pack(blocks, "_blocks", "_texts", max_chars, "\n\n")
    keep = ["source_name", *where, "section_1", "section_2", "_context"]
    return _named(explode_rows(packed, keep, "_texts", "ordinal", "content"))


# ---------------------------------------------------------------- per-type dispatch


def _source_key(kind: str, *columns: str) -> Column:
    """Id of an extracted source: each part by its length, so that no two lists of parts look alike."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    parts = [x for t in text for x in (F.length(t).cast("string"), F.lit(":"), t)]
    return F.sha2(F.concat(F.lit(f"{kind}:"), *parts), 256)


def class_nodes(declared: DataFrame) -> DataFrame:
    """Type declarations as sources, keyed by path (or name), signature, position and content.

    Equal file names in two folders give different sources, and a changed declaration is a new one.
    """
    place = "path" if "path" in declared.columns else "source_name"
    found = declared.filter(F.col("signature").isNotNull())
    key = _source_key("type", place, "signature", "pos", "content")
    return found.select(key.alias("source_id"), "source_name", "signature", "content")


def broken_files(declared: DataFrame) -> DataFrame:
    """Rejects (path, reason) for files whose brackets do not match."""
    marks = declared.filter(F.col("signature").isNull())
    place = "path" if "path" in declared.columns else "source_name"
    return marks.select(F.col(place).alias("path"), F.lit("brackets do not match").alias("reason"))


def paragraphs(files: DataFrame, max_chars: int = PARAGRAPH_CHARS) -> DataFrame:
    """Paragraphs of the plain-text and structured documents; Markdown yields none.

    Keyed by path (or name), place in the document and content.
    """
    place = "path" if "path" in files.columns else "source_name"
    packed = pack_lines(files.filter(F.col("source_type") == "pdf"), max_chars)
    cut = sections(files.filter(F.col("source_type") == "asciidoc"), max_chars)
    flat = packed.withColumn("source_id", _source_key("paragraph", place, "paragraph_name", "content"))
    nested = cut.withColumn(
        "source_id", _source_key("section", place, "paragraph_name", "section_1", "section_2", "content")
    )
    out = ["source_id", "source_name", "paragraph_name", "content"]
    return flat.select(*out).unionByName(nested.select(*out))


def counts(nodes: DataFrame, paras: DataFrame) -> DataFrame:
    """Extracted rows per source and kind."""
    rows = nodes.select("source_name", F.lit("class_node").alias("kind")).unionByName(
        paras.select("source_name", F.lit("paragraph").alias("kind"))
    )
    return rows.groupBy("source_name", "kind").agg(F.count("*").alias("n_rows"))


# ---------------------------------------------------------------- diffs

FILE_HEAD = r"diff --git a/.+? b/(.+)"  # fixed format of a file header line


def diff_hunks(diff: Column) -> Column:
    """Array of (filepath, content) per changed file: new path, text from the first ``@@`` on."""
    files = F.split(diff, rf"(?md)^(?={FILE_HEAD}$)", -1)
    hunk = lambda f: F.struct(
        F.regexp_extract(f, rf"(?d)\A{FILE_HEAD}", 1).alias("filepath"),
        F.when(F.locate("\n@@", f) > 0, F.substr(f, F.locate("\n@@", f) + 1)).alias("content"),
    )
    return F.filter(F.transform(files, hunk), lambda h: (h["filepath"] != "") & h["content"].isNotNull())


def split_diff(diffs: DataFrame) -> DataFrame:
    """``diffs(pr_id, diff)`` -> one row per changed file with hunks: (pr_id, pos, filepath, content)."""
    found = diffs.select("pr_id", diff_hunks(F.col("diff")).alias("_hunks"))
    return explode_rows(found, ["pr_id"], "_hunks", "pos", "_h").select("pr_id", "pos", "_h.filepath", "_h.content")


def attach_hunks(pull_requests: DataFrame, diffs: DataFrame) -> DataFrame:
    """Pull requests with their hunks nested in order; none becomes an empty array."""
    nested = diffs.select(F.col("pr_id").alias("id"), diff_hunks(F.col("diff")).alias("hunks"))
    none = F.array().cast("array<struct<filepath:string,content:string>>")
    return pull_requests.join(nested, "id", "left").withColumn("hunks", F.coalesce("hunks", none))
