"""Composed operations: nulls, repeated requests, documents without chunks, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.context import TenantContext
from docloom.operators import ingest as ig
from docloom.operators import rag

GUARD = "document_id long, tenant_id long, lifecycle_status string, current_index_version long, index_input_hash string"
JOBS = "document_id long, tenant_id long, index_version long, state string"


def tables(spark):
    guard = spark.createDataFrame([(1, 1, "ACTIVE", 3, "a"), (2, 1, "DELETED", 1, "a"), (3, 2, "ACTIVE", 1, "a")], GUARD)
    chunks = spark.createDataFrame([(1, 10), (1, 11), (3, 30), (None, 90)], "document_id long, id long")
    jobs = spark.createDataFrame([(1, 1, 3, "RUNNING"), (1, 1, 4, "PENDING"), (3, 2, 1, "PENDING")], JOBS)
    return guard, chunks, jobs


def test_ingest(spark):
    guard, chunks, jobs = tables(spark)
    asked = spark.createDataFrame([(1, 1, 1, 4, "b"), (2, 1, 1, 2, "b"), (3, 2, 1, 9, "b"), (4, 3, 1, 9, "b"), (5, 4, 1, 1, "n"), (6, None, 1, 1, "n")], "request_id long, document_id long, tenant_id long, index_version long, input_hash string")
    staged = spark.createDataFrame([(1, 12), (2, 20), (3, 31)], "document_id long, id long")
    done = ig.ingest(asked, staged, guard, chunks, jobs)
    assert {r.document_id: r.decision for r in done.decisions.collect()} == {1: "APPLY", 2: "REJECT_DELETED", 3: "REJECT_TENANT_MISMATCH", 4: "APPLY"}
    assert {(r.document_id, r.lifecycle_status, r.current_index_version) for r in done.guard.collect()} == {(1, "ACTIVE", 4), (2, "DELETED", 1), (3, "ACTIVE", 1), (4, "ACTIVE", 1)}
    assert sorted(r.id for r in done.chunks.collect()) == [12, 30, 90]
    assert sorted((r.document_id, r.index_version, r.state) for r in done.jobs.collect()) == [(1, 3, "OBSOLETE"), (1, 4, "PENDING"), (3, 1, "PENDING")]
    empty = ig.ingest(asked.limit(0), staged, guard, chunks, jobs)
    assert (empty.guard.count(), empty.chunks.count()) == (3, 4)


def test_delete(spark):
    guard, chunks, jobs = tables(spark)
    patterns = spark.createDataFrame([(7,), (8,), (9,)], "id long")
    sources = spark.createDataFrame([(7, 1), (8, 1), (8, 3)], "pattern_id long, document_id long")
    asked = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1), (None, 1)], "document_id long, tenant_id long")
    done = ig.delete_documents(asked, guard, chunks, patterns, sources, jobs)
    assert {r.name: r.n for r in done.counters.collect()} == {"documents": 1, "chunks": 2, "sources": 2, "patterns": 1}
    assert {r.document_id: r.lifecycle_status for r in done.guard.collect()} == {1: "DELETED", 2: "DELETED", 3: "ACTIVE"}
    assert sorted(r.id for r in done.patterns.collect()) == [8, 9]
    assert sorted(r.id for r in done.chunks.collect()) == [30, 90]
    assert sorted((r.document_id, r.state) for r in done.jobs.collect()) == [(1, "OBSOLETE"), (1, "OBSOLETE"), (3, "PENDING")]


def test_request(spark):
    vector = lambda *x: [float(y) for y in x]
    guard = spark.createDataFrame([(1, 1, "ACTIVE", 1, "a"), (2, 1, "QUARANTINED", 1, "a")], GUARD)
    chunks = spark.createDataFrame([(10, 1, 1, "b", "the plan of one", vector(1, 0), 2), (11, 1, 1, "b", "other", vector(0, 1), None), (20, 2, 1, "b", "the hidden one", vector(1, 0), 1)], "id long, document_id long, tenant_id long, document_type string, content string, embedding array<double>, section_id long")
    documents = spark.createDataFrame([(1, "b"), (2, "b")], "id long, document_type string")
    sections = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 1), (2, 1, None)], "document_id long, id long, parent_id long")
    patterns = spark.createDataFrame([(5, 1, "t", "active", "f", vector(1, 0)), (6, 1, "u", "active", "f", vector(1, 0)), (7, 1, "u", "active", "g", vector(1, 0))], "id long, tenant_id long, type string, status string, fingerprint string, embedding array<double>")
    sources = spark.createDataFrame([(5, 1), (6, 1), (7, 2)], "pattern_id long, document_id long")
    index = rag.Index(chunks, guard, documents, sections, patterns, sources)
    asked = rag.Request(F.array(F.lit(1.0), F.lit(0.0)), "the", pattern_types=["none"], pattern_document_types=["b"], fact_types=["c"])
    got = rag.run(index, TenantContext(1), asked)
    assert {(r.layer, r.id, r["rank"]) for r in got["trace"].collect()} == {("evidence", 10, 1), ("evidence", 11, 2), ("section", 1, 0), ("section", 2, 0), ("section", 3, 0), ("pattern", 5, 1)}
    assert got["patterns"].first().duplicate_count == 2
    assert [r.evidence for r in got["context"].collect()] == ["[1] the plan of one\n\n[2] other"]
    longest = rag.Request(asked.vector, "the", scorer=lambda text: -F.length(text).cast("double"), top_k=1)
    assert [r.id for r in rag.retrieve(index, TenantContext(1), longest)["evidences"].collect()] == [11]
    assert rag.run(index, TenantContext(9), asked)["trace"].count() == 0
