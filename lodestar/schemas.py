"""Table schemas as DDL strings."""

HUNK = "struct<filepath:string,content:string>"
PULL_REQUEST = f"id string, title string, description string, hunks array<{HUNK}>"
DOCUMENT_REF = "struct<source_name:string,chunk_ids:array<string>,similarity_score:double>"
RESULT_FILE = (
    "task string, `group` string, input string, response string, duration bigint, "
    "documents array<struct<source_name:string,chunk_ids:array<string>,"
    "embedding_ids:array<string>,similarity_score:double,rrf_score:double>>"
)
SUMMARY = "description string, usage string, exampleUsage string, relationship string"

# Content types of a chunk.
CODE, ENRICHMENT, DOCUMENT, UNDEFINED = "CODE", "ENRICHMENT", "DOCUMENT", "UNDEFINED"
CONTENT_TYPES = (CODE, ENRICHMENT, DOCUMENT, UNDEFINED)
