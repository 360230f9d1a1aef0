"""The stored tables: their columns, what deals them into buckets, what names a row and what every row must keep to."""

from __future__ import annotations

from docloom.operators.doctypes import DOCUMENT_TYPES
from docloom.operators.lifecycle import JOB_STATES, LIFECYCLES
from docloom.sources.publish import Stored


def _one_of(column: str, allowed) -> str:
    return f"{column} IN ({', '.join(repr(a) for a in allowed)})"


def _given(*columns: str) -> dict[str, str]:
    return {f"{c}_given": f"{c} IS NOT NULL" for c in columns}


_FINITE = "embedding IS NULL OR forall(embedding, x -> x IS NOT NULL AND NOT isnan(x))"

GUARD = Stored(
    "document_id long, tenant_id long, lifecycle_status string, current_index_version long, index_input_hash string",
    "document_id", ("document_id",), {**_given("document_id", "tenant_id"), "lifecycle": _one_of("lifecycle_status", LIFECYCLES), "version_has_hash": "current_index_version IS NULL OR index_input_hash IS NOT NULL"},
)
DOCUMENT = Stored(
    "id long, tenant_id long, enterprise_id long, knowledge_base_id long, name string, file_name string, file_type string, file_size long, storage_key string, document_type string, status string, parser string, file_hash string",
    "id", ("id",), {**_given("id", "tenant_id"), "type": _one_of("document_type", DOCUMENT_TYPES)},
)
SECTION = Stored(
    "id long, document_id long, knowledge_base_id long, index_version long, parent_id long, title string, level int, section_no string, section_type string, sort_order long, page_start int, page_end int, content string",
    "document_id", ("document_id", "id"), {**_given("id", "document_id", "title"), "parent_before": "parent_id IS NULL OR parent_id < id"},
)
CHUNK = Stored(
    "id long, tenant_id long, enterprise_id long, knowledge_base_id long, document_id long, section_id long, index_version long, chunk_index int, content string, document_type string, section_type string, page_start int, page_end int, embedding array<float>",
    "document_id", ("document_id", "id"), {**_given("id", "document_id", "tenant_id", "content"), "vector_finite": _FINITE},
)
PATTERN = Stored(
    "id long, tenant_id long, enterprise_id long, knowledge_base_id long, name string, code string, type string, scenario string, summary string, content string, generalized_content string, fingerprint string, version int, status string, embedding array<float>",
    "fingerprint", ("id",), {**_given("id", "tenant_id", "name", "fingerprint"), "vector_finite": _FINITE},
)
PATTERN_SOURCE = Stored(
    "pattern_id long, document_id long, section_id long, index_version long, source_type string, page_start int, page_end int, sort_order int",
    "document_id", ("pattern_id", "document_id", "section_id"), _given("pattern_id", "document_id"),
)
JOB = Stored(
    "tenant_id long, document_id long, index_version long, input_hash string, state string, owner_id string, expires_at timestamp, error_message string",
    "document_id", ("tenant_id", "document_id", "index_version"), {**_given("tenant_id", "document_id", "index_version"), "state": _one_of("state", JOB_STATES)},
)
KNOWLEDGE_BASE = Stored("id long, tenant_id long, enterprise_id long, name string, description string, kind string", "id", ("id",), _given("id", "tenant_id", "name"))

TABLES = {"guard": GUARD, "document": DOCUMENT, "section": SECTION, "chunk": CHUNK, "pattern": PATTERN, "pattern_source": PATTERN_SOURCE, "job": JOB, "knowledge_base": KNOWLEDGE_BASE}


def fitted(rows, stored: Stored):
    """The table's columns in its types; columns that the rows lack are null (an added column needs no rewrite)."""
    from pyspark.sql import functions as F

    schema = rows.sparkSession.createDataFrame([], stored.schema).schema
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
