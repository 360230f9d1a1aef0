"""The whole audit of ownership: invariants, what only people can settle, trusted backfills, and the tender quarantine.

Every audit is a table (name, n); invariants are to be 0.  Tables: chunks(document_id, section_id, tenant_id,
knowledge_base_id), documents(id, tenant_id, knowledge_base_id, document_type), sections(id, document_id),
patterns(id, tenant_id, knowledge_base_id, status), sources(pattern_id, document_id), guard(document_id, tenant_id).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import governance as gv
from docloom.operators.doctypes import EXCLUDED_TYPE, LEGACY_TYPES

ACTIVE, QUARANTINED = "active", "quarantined"


class Tables(NamedTuple):
    documents: DataFrame
    sections: DataFrame
    chunks: DataFrame
    patterns: DataFrame
    sources: DataFrame
    guard: DataFrame

    def supported(self, column: str) -> DataFrame:
        """(pattern_id, document_id, ``column`` of the document) of sources whose document exists."""
        return self.sources.join(self.documents.select(F.col("id").alias("document_id"), column), "document_id")


def _named(**checks: DataFrame) -> DataFrame:
    return gv.audit(**checks).withColumnRenamed("violations", "n")


def invariants(t: Tables) -> DataFrame:
    """All fifteen; each counts rows, or documents where it says so."""
    owned = t.documents.select(F.col("id").alias("document_id"), "tenant_id")
    places = t.sections.select(F.col("id").alias("section_id"), F.col("document_id").alias("_of"))
    in_sections = t.chunks.join(places, "section_id")
    mine = t.patterns.select(F.col("id").alias("pattern_id"), "tenant_id", "knowledge_base_id")

    def differ(column: str) -> DataFrame:
        theirs = t.supported(column).withColumnRenamed(column, "_theirs")
        return theirs.join(mine, "pattern_id").filter(~F.col(column).eqNullSafe(F.col("_theirs")))

    one_owner = t.sections.join(owned, "document_id").groupBy("document_id").agg(F.countDistinct("tenant_id").alias("n")).filter("n <> 1")
    return _named(
        chunk_without_document=gv.orphans(t.chunks, "document_id", t.documents),
        chunk_tenant=gv.mismatches(t.chunks, "document_id", t.documents, "tenant_id"),
        chunk_knowledge_base=gv.mismatches(t.chunks, "document_id", t.documents, "knowledge_base_id"),
        document_in_tenants=gv.several_values(t.chunks, "document_id", "tenant_id"),
        section_without_document=gv.orphans(t.sections, "document_id", t.documents),
        section_owners=one_owner,
        chunk_without_section=gv.orphans(t.chunks.filter("section_id IS NOT NULL"), "section_id", t.sections),
        chunk_in_other_document=in_sections.filter(~F.col("_of").eqNullSafe(F.col("document_id"))),
        source_without_pattern=gv.orphans(t.sources, "pattern_id", t.patterns),
        source_without_document=gv.orphans(t.sources.filter("document_id IS NOT NULL"), "document_id", t.documents),
        pattern_tenant=differ("tenant_id"),
        pattern_knowledge_base=differ("knowledge_base_id"),
        guard_tenant=gv.mismatches(t.guard, "document_id", t.documents, "tenant_id"),
        guard_without_document=gv.orphans(t.guard, "document_id", t.documents),
        guard_repeated=gv.repeated_keys(t.guard, "document_id"),
    )


def manual_items(t: Tables) -> DataFrame:
    """What no rule may repair: unknown owners, orphans, patterns whose documents disagree, documents without a guard."""
    several = t.supported("tenant_id").filter("tenant_id IS NOT NULL").groupBy("pattern_id").agg(F.countDistinct("tenant_id").alias("n")).filter("n > 1")
    ownerless = t.patterns.filter("tenant_id IS NULL").join(several.select(F.col("pattern_id").alias("id")), "id", "left_semi")
    return _named(
        document_without_tenant=t.documents.filter("tenant_id IS NULL"),
        chunk_without_document=gv.orphans(t.chunks, "document_id", t.documents),
        source_without_pattern=gv.orphans(t.sources, "pattern_id", t.patterns),
        section_without_document=gv.orphans(t.sections, "document_id", t.documents),
        pattern_of_several_owners=ownerless,
        guard_missing=t.documents.filter("tenant_id IS NOT NULL").join(t.guard.select(F.col("document_id").alias("id")), "id", "left_anti"),
    )


def trusted_backfills(t: Tables) -> tuple[Tables, DataFrame]:
    """The tables after the four trusted backfills, and (name, n): how many rows each has filled.

    Only nulls are filled, chunks from their document, patterns from their documents where these agree.
    """
    after, counts = t, {}
    chunks, patterns = t.chunks, t.patterns
    for column in ("tenant_id", "knowledge_base_id"):
        was = f"_{column}"
        parents = t.documents.select("id", column)
        of_patterns = t.supported(column).select(F.col("pattern_id").alias("id"), column)
        chunks = gv.backfill(chunks.withColumn(was, F.col(column)), "document_id", parents, column)
        patterns = gv.backfill(patterns.withColumn(was, F.col(column)), "id", of_patterns, column)
        filled = F.col(was).isNull() & F.col(column).isNotNull()
        counts[f"chunk_{column}"], counts[f"pattern_{column}"] = chunks.filter(filled), patterns.filter(filled)
    after = t._replace(chunks=chunks.select(*t.chunks.columns), patterns=patterns.select(*t.patterns.columns))
    return after, _named(**counts)


def quarantine_census(t: Tables) -> DataFrame:
    """Seven counters of excluded documents and the patterns that rest on them; older type names count as the present one."""
    kind = F.trim("document_type")
    legacy = [old for old, new in LEGACY_TYPES.items() if new == EXCLUDED_TYPE]
    rests = gv.tender_only_patterns(t.sources, t.documents.select("id", "document_type"))
    status = t.patterns.select(F.col("id").alias("pattern_id"), "status")
    known = rests.join(status, "pattern_id")
    only = known.filter("kind = 'tender_only'")
    excluded = t.supported("document_type").filter(kind.isin(EXCLUDED_TYPE, *legacy))
    return _named(
        documents_of_older_name=t.documents.filter(kind.isin(*legacy)),
        documents_excluded=t.documents.filter(kind == EXCLUDED_TYPE),
        sources_excluded=excluded,
        patterns_excluded_only=only,
        patterns_mixed=known.filter("kind = 'mixed'"),
        patterns_quarantined_already=only.filter(F.col("status") == QUARANTINED),
        patterns_active=t.patterns.filter(F.col("status") == ACTIVE),
    )


def quarantined(t: Tables) -> tuple[Tables, DataFrame]:
    """The tables with present type names and with patterns set aside that rest on excluded documents alone; (name, n) of changes.

    Running it again changes nothing.
    """
    documents = gv.renamed_types(t.documents)
    patterns = gv.quarantine(t.patterns, t.sources, documents.select("id", "document_type"), QUARANTINED)
    renamed = t.documents.filter(F.trim("document_type").isin(*LEGACY_TYPES))
    before = t.patterns.select("id", F.col("status").alias("_was"))
    moved = patterns.join(before, "id").filter((F.col("status") == QUARANTINED) & ~F.col("_was").eqNullSafe(QUARANTINED))
    return t._replace(documents=documents, patterns=patterns), _named(documents_renamed=renamed, patterns_quarantined=moved)


def verify_quarantine(t: Tables) -> DataFrame:
    """What must be 0 after ``quarantined``: older names, and active patterns that rest on excluded documents alone."""
    only = gv.tender_only_patterns(t.sources, t.documents.select("id", "document_type")).filter("kind = 'tender_only'")
    leaked = t.patterns.filter(F.col("status") == ACTIVE).join(only.select(F.col("pattern_id").alias("id")), "id", "left_semi")
    return _named(documents_of_older_name=t.documents.filter(F.trim("document_type").isin(*LEGACY_TYPES)), patterns_active_excluded_only=leaked)
