"""Guarded ingest and deletion: guard, sections, chunks, patterns and jobs change together.

``ingest`` and ``delete_documents`` are one plan each: they return the new tables as lazy DataFrames, and the check is
part of the plan that makes the tables, so it sees the guard that is replaced.

``begin``, ``embed_parts`` and ``finish`` are the same ingest in three phases over a published store, for embeddings
that take long: decide at a pinned version, embed while others may publish, check again at the version that is
newest then and replace sections, chunks, guard, documents and jobs in one commit.  Where another writer publishes
in between, the commit fails and the last phase starts over from the new version.

Defined results: a request or deletion without a document id changes nothing; of several requests for a
document in one call the highest version counts, then the least request_id (``lifecycle.apply_in_order``
takes whole sequences); staged chunks of documents whose request is not applied are left out; an applied
request without staged chunks empties its document.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import extraction as ex
from docloom.operators import lifecycle as lc
from docloom.operators.assembly import real_ids
from docloom.operators.doctypes import normalised_type
from docloom.operators.ids import dense_ids
from docloom.sources import tables as tb
from docloom.sources.publish import Conflict, Staged, Store, Version


class Ingested(NamedTuple):
    decisions: DataFrame
    guard: DataFrame
    chunks: DataFrame
    jobs: DataFrame


class Deleted(NamedTuple):
    guard: DataFrame
    chunks: DataFrame
    patterns: DataFrame
    sources: DataFrame
    jobs: DataFrame
    counters: DataFrame


def one_per_document(requests: DataFrame) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy(F.desc("index_version"), "request_id")
    return requests.filter("document_id IS NOT NULL").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def ingest(requests: DataFrame, staged: DataFrame, guard: DataFrame, chunks: DataFrame, jobs: DataFrame) -> Ingested:
    """requests(request_id, document_id, tenant_id, index_version, input_hash), staged: their new chunks.

    Applied requests set the guard ACTIVE at their version and replace all chunks of their document; jobs below
    the new version become OBSOLETE.
    """
    decided = lc.decisions(one_per_document(requests), guard)
    applied = decided.filter(F.col("decision") == lc.APPLY)
    changes = applied.select("document_id", "tenant_id", F.lit(lc.ACTIVE).alias("lifecycle_status"), F.col("index_version").alias("current_index_version"), F.col("input_hash").alias("index_input_hash"))
    after = lc.upsert(guard, changes, "document_id", adopt=("tenant_id",))
    ids = applied.select("document_id")
    kept = chunks.join(ids, "document_id", "left_anti").select(*chunks.columns)
    new = staged.join(ids, "document_id", "left_semi").select(*chunks.columns)
    return Ingested(decided, after, kept.unionByName(new), lc.obsolete_jobs(jobs, after))


def delete_documents(deletes: DataFrame, guard: DataFrame, chunks: DataFrame, patterns: DataFrame, sources: DataFrame, jobs: DataFrame) -> Deleted:
    """deletes(document_id, tenant_id).  Only deletions by the document's tenant count; repeating one changes nothing.

    counters(name, n): documents deleted for the first time, and chunks, sources and patterns that went.
    """
    mine = guard.select("document_id", "tenant_id").join(deletes.select("document_id", "tenant_id").distinct(), ["document_id", "tenant_id"], "left_semi").select("document_id")
    marked = lc.tombstone(guard, deletes)
    left, sources_left = lc.purge(patterns, sources, mine)
    after = marked.select(*guard.columns)

    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")

    counters = (
        counted("documents", marked.filter("first_time"))
        .unionByName(counted("chunks", chunks.join(mine, "document_id", "left_semi")))
        .unionByName(counted("sources", sources.join(mine, "document_id", "left_semi")))
        .unionByName(counted("patterns", patterns.join(left.select("id"), "id", "left_anti")))
    )
    return Deleted(after, chunks.join(mine, "document_id", "left_anti").select(*chunks.columns), left, sources_left, lc.obsolete_jobs(jobs, after), counters)


#: A document whose vectors are missing, of another dimension or not finite.
REJECT_VECTORS = "REJECT_VECTORS"
#: What a request may say about its document, besides what the guard needs.
ABOUT = ("enterprise_id", "knowledge_base_id", "name", "file_name", "file_type", "file_size", "storage_key", "document_type", "parser", "file_hash")


class Begun(NamedTuple):
    """Requests with their decision at ``at``; ``known``: the document had a guard."""

    requests: DataFrame
    at: Version


class Embedded(NamedTuple):
    begun: Begun
    sections: DataFrame
    chunks: DataFrame
    wrong: DataFrame


class Finished(NamedTuple):
    """Decisions (request_id, document_id, decision) and the version they are in force from."""

    decisions: DataFrame
    version: Version
    tries: int


def begin(store: Store, requests: DataFrame) -> Begun:
    """Phase 1: requests as in ``ingest``, with any columns of ``ABOUT``, decided at the newest version."""
    at = store.pin()
    guard = store.read("guard", at, tb.GUARD)
    known = guard.select("document_id", F.lit(True).alias("known"))
    decided = lc.decisions(one_per_document(requests), guard).join(known, "document_id", "left")
    return Begun(store.keep(decided.withColumn("known", F.coalesce("known", F.lit(False)))), at)


def embed_parts(store: Store, begun: Begun, sections: DataFrame, chunks: DataFrame, factory: Callable[[], Callable], dim: int) -> Embedded:
    """Phase 2: vectors for the chunks of documents that may be applied; nothing is locked meanwhile.

    sections(document_id, id, parent_id, title, ...) and chunks(document_id, section_id, chunk_index, content, ...) have
    temporary section ids, distinct within a document and in preorder.  One wrong vector rejects its document whole.
    """
    mine = begun.requests.filter(F.col("decision") == lc.APPLY).select("document_id")
    vectors = store.keep(ex.embed(chunks.join(mine, "document_id", "left_semi"), "content", factory))
    right = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    wrong = store.keep(vectors.filter(~F.coalesce(right, F.lit(False))).select("document_id").distinct())
    return Embedded(begun, store.keep(sections.join(mine, "document_id", "left_semi")), vectors, wrong)


def stored_sections(store: Store, sections: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """(sections with real ids and parents, their (document_id, temporary_id, real_id)).

    Ids follow each other without gaps in order of document and preorder, so a rerun from the same version gives the
    same ones.
    """
    temporary = sections.withColumnRenamed("id", "temporary_id")
    numbered, _ = dense_ids(temporary, ["document_id", "temporary_id"], start, store.keep)
    ids = numbered.select("document_id", "temporary_id", F.col("id").alias("real_id"))
    # An old and a new name for the same column: parents are temporary ids as well.
    return real_ids(numbered.drop("temporary_id"), ids, "parent_id"), ids


def finish(store: Store, embedded: Embedded, tries: int = 5) -> Finished:
    """Phase 3: decide again at the newest version, replace what is still to be applied, and commit all tables at once.

    A document whose guard has gone since phase 1 is rejected as one of another tenant.
    """
    begun = embedded.begun
    dropped = begun.requests.filter(F.col("decision") != lc.APPLY).select("request_id", "document_id", "decision")
    asked = begun.requests.filter(F.col("decision") == lc.APPLY).drop("decision")
    for attempt in range(1, tries + 1):
        now = store.pin()
        guard = store.read("guard", now, tb.GUARD)
        known = lc.decisions(asked.filter("known"), guard, require_existing=True)
        again = known.unionByName(lc.decisions(asked.filter("NOT known"), guard))
        bad = embedded.wrong.select("document_id", F.lit(True).alias("_bad"))
        verdict = F.when((F.col("decision") == lc.APPLY) & F.col("_bad"), REJECT_VECTORS).otherwise(F.col("decision"))
        final = store.keep(again.join(bad, "document_id", "left").withColumn("decision", verdict).drop("_bad"))
        decisions = dropped.unionByName(final.select("request_id", "document_id", "decision"))
        applied = final.filter(F.col("decision") == lc.APPLY)
        if applied.isEmpty():
            return Finished(decisions, now, attempt)
        try:
            return Finished(decisions, store.commit(now, _replaced(store, now, applied, embedded)), attempt)
        except Conflict:
            if attempt == tries:
                raise
    raise AssertionError("unreachable")


def _replaced(store: Store, now: Version, applied: DataFrame, embedded: Embedded) -> dict[str, Staged]:
    """The buckets of the applied documents with their new rows, staged."""
    touched = store.touched(applied, "document_id")
    ids = applied.select("document_id")
    have = [c for c in ABOUT if c in applied.columns]
    stamp = applied.select("document_id", "tenant_id", "index_version", *(c for c in ("enterprise_id", "knowledge_base_id", "document_type") if c in have))

    def old(name: str) -> DataFrame:
        return store.read(name, now, tb.TABLES[name], touched)

    def staged(name: str, rows: DataFrame) -> tuple:
        return tb.fitted(rows, tb.TABLES[name]), tb.TABLES[name], touched

    def with_new(name: str, rows: DataFrame) -> tuple:
        new = tb.fitted(rows.drop(*(c for c in stamp.columns if c != "document_id")).join(stamp, "document_id"), tb.TABLES[name])
        return staged(name, old(name).join(ids, "document_id", "left_anti").select(*new.columns).unionByName(new))

    sections, made = stored_sections(store, embedded.sections.join(ids, "document_id", "left_semi"), now.next_ids.get("section", 1))
    place = sections.select("document_id", "id", F.col("id").alias("sort_order"))
    first = place.groupBy("document_id").agg(F.min("id").alias("_first"))
    sections = sections.drop("sort_order").join(first, "document_id").withColumn("sort_order", F.col("id") - F.col("_first")).drop("_first")
    chunks = real_ids(embedded.chunks.join(ids, "document_id", "left_semi"), made, "section_id")
    numbered, _ = dense_ids(chunks, ["document_id", "chunk_index"], now.next_ids.get("chunk", 1), store.keep)
    changes = applied.select("document_id", "tenant_id", F.lit(lc.ACTIVE).alias("lifecycle_status"), F.col("index_version").alias("current_index_version"), F.col("input_hash").alias("index_input_hash"))
    guard = lc.upsert(old("guard"), changes, "document_id", adopt=("tenant_id",))
    about = applied.select(F.col("document_id").alias("id"), "tenant_id", *have, F.lit("embedded").alias("status"))
    about = tb.fitted(about.withColumn("document_type", normalised_type(F.col("document_type") if "document_type" in have else F.lit(None).cast("string"))), tb.DOCUMENT)
    kept = tuple(c for c in about.columns if c not in ("id", "status"))
    documents = lc.upsert(store.read("document", now, tb.DOCUMENT, touched), about, "id", keep=kept)
    jobs = lc.obsolete_jobs(old("job"), guard)
    new = {"section": with_new("section", sections), "chunk": with_new("chunk", numbered)}
    return store.stage_all(new | {"guard": staged("guard", guard), "document": staged("document", documents), "job": staged("job", jobs)})


def ingest_in_phases(store: Store, requests: DataFrame, sections: DataFrame, chunks: DataFrame, factory: Callable[[], Callable], dim: int, tries: int = 5) -> Finished:
    """All three phases of one writer."""
    begun = begin(store, requests)
    return finish(store, embed_parts(store, begun, sections, chunks, factory, dim), tries)
