"""Queries of the whole audit, the trusted backfills, the quarantine, and reranking by words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import audits as au
from docloom.operators import retrieval as rt
from docloom.plans import queries as q
from docloom.plans import views as v

_VIEWS = ("d_document", "d_guard", "d_chunk", "d_pattern", "d_pattern_source", "d_block")

#: Tables with gaps and strays: lost owners, sections elsewhere, sources of nothing.
_TABLES_SQL = f"""{q._HEADS_SQL},
 doc AS (SELECT id, CASE WHEN id % 23 <> 0 THEN tenant_id END AS tenant_id, knowledge_base_id, document_type FROM d_document),
 sec AS (SELECT document_id * 1000 + section_id AS id, CASE WHEN document_id % 29 = 0 THEN document_id + 500000000 ELSE document_id END AS document_id FROM tree),
 chk AS (
  SELECT id, document_id, CASE WHEN chunk_index % 37 = 1 THEN -5 WHEN chunk_index % 31 = 1 THEN NULL WHEN chunk_index % 41 = 1 THEN 1 ELSE document_id % 1000000000 * 1000 + chunk_index // 4 END AS section_id,
   tenant_id, CASE WHEN id % 43 <> 0 THEN knowledge_base_id END AS knowledge_base_id FROM d_chunk),
 pat AS (SELECT id, CASE WHEN id % 7 <> 0 THEN tenant_id END AS tenant_id, CASE WHEN id % 5 <> 0 THEN knowledge_base_id END AS knowledge_base_id, status FROM d_pattern WHERE id % 19 <> 0),
 src AS (SELECT pattern_id, CASE WHEN pattern_id % 11 <> 0 THEN document_id ELSE document_id + 700000000 END AS document_id FROM d_pattern_source),
 grd AS (SELECT document_id, tenant_id FROM d_guard UNION ALL SELECT document_id + CASE WHEN document_id % 2 = 0 THEN 900000000 ELSE 0 END, tenant_id FROM d_guard WHERE document_id % 17 = 0)"""


def _tables(spark, sf) -> au.Tables:
    def gone(c: str, rule) -> F.Column:
        return F.when(rule, F.col(c)).alias(c)

    i, d, n = F.col("id"), F.col("document_id"), F.col("chunk_index")
    documents = v.d_document(spark, sf).select("id", gone("tenant_id", i % 23 != 0), "knowledge_base_id", "document_type")
    sections = q._tree(spark, sf).select((d * 1000 + F.col("section_id")).alias("id"), F.when(d % 29 == 0, d + 500000000).otherwise(d).alias("document_id"))
    place = F.when(n % 37 == 1, -5).when(n % 31 == 1, None).when(n % 41 == 1, 1).otherwise(d % 1000000000 * 1000 + F.floor(n / 4))
    chunks = v.d_chunk(spark, sf, embeddings=False).select("id", "document_id", place.cast("long").alias("section_id"), "tenant_id", gone("knowledge_base_id", i % 43 != 0))
    patterns = v.d_pattern(spark, sf).filter(i % 19 != 0).select("id", gone("tenant_id", i % 7 != 0), gone("knowledge_base_id", i % 5 != 0), "status")
    p = F.col("pattern_id")
    sources = v.d_pattern_source(spark, sf).select("pattern_id", F.when(p % 11 != 0, d).otherwise(d + 700000000).alias("document_id"))
    guard = v.d_guard(spark, sf).select("document_id", "tenant_id")
    strays = guard.filter(d % 17 == 0).select((d + F.when(d % 2 == 0, 900000000).otherwise(0)).alias("document_id"), "tenant_id")
    return au.Tables(documents, sections, chunks, patterns, sources, guard.unionByName(strays))


def _counts_sql(kind: str, **checks: str) -> str:
    return "\nUNION ALL ".join(f"SELECT '{kind}' AS kind, '{name}' AS name, count(*) AS n FROM {body}" for name, body in checks.items())


def _no(parent: str, rows: str, key: str, where: str = "true", column: str = "id") -> str:
    return f"{rows} c WHERE {where} AND NOT EXISTS (SELECT 1 FROM {parent} x WHERE x.{column} = c.{key})"


def _differs(rows: str, column: str) -> str:
    return f"{rows} c JOIN doc d ON d.id = c.document_id WHERE c.{column} IS DISTINCT FROM d.{column}"


def _pattern_differs(column: str) -> str:
    return f"src s JOIN pat p ON p.id = s.pattern_id JOIN doc d ON d.id = s.document_id WHERE p.{column} IS DISTINCT FROM d.{column}"


_AUDIT = (
    _counts_sql(
        "invariant",
        chunk_without_document=_no("doc", "chk", "document_id"),
        chunk_tenant=_differs("chk", "tenant_id"),
        chunk_knowledge_base=_differs("chk", "knowledge_base_id"),
        document_in_tenants="(SELECT document_id FROM chk GROUP BY 1 HAVING count(DISTINCT tenant_id) > 1)",
        section_without_document=_no("doc", "sec", "document_id"),
        section_owners="(SELECT s.document_id FROM sec s JOIN doc d ON d.id = s.document_id GROUP BY 1 HAVING count(DISTINCT d.tenant_id) <> 1)",
        chunk_without_section=_no("sec", "chk", "section_id", "section_id IS NOT NULL"),
        chunk_in_other_document="chk c JOIN sec s ON s.id = c.section_id WHERE s.document_id IS DISTINCT FROM c.document_id",
        source_without_pattern=_no("pat", "src", "pattern_id"),
        source_without_document=_no("doc", "src", "document_id", "document_id IS NOT NULL"),
        pattern_tenant=_pattern_differs("tenant_id"),
        pattern_knowledge_base=_pattern_differs("knowledge_base_id"),
        guard_tenant=_differs("grd", "tenant_id"),
        guard_without_document=_no("doc", "grd", "document_id"),
        guard_repeated="(SELECT document_id FROM grd GROUP BY 1 HAVING count(*) > 1)",
    )
    + "\nUNION ALL "
    + _counts_sql(
        "manual",
        document_without_tenant="doc WHERE tenant_id IS NULL",
        chunk_without_document=_no("doc", "chk", "document_id"),
        source_without_pattern=_no("pat", "src", "pattern_id"),
        section_without_document=_no("doc", "sec", "document_id"),
        pattern_of_several_owners="pat p WHERE tenant_id IS NULL AND (SELECT count(DISTINCT d.tenant_id) FROM src s JOIN doc d ON d.id = s.document_id WHERE s.pattern_id = p.id) > 1",
        guard_missing=_no("grd", "doc", "id", "tenant_id IS NOT NULL", "document_id"),
    )
)


def _kinds(**parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "name", "n") for kind, df in parts.items()])


@q.query("ownership_audit", v.with_views(*_VIEWS, body=f"{_TABLES_SQL} {_AUDIT}"))
def ownership_audit(spark, sf):
    """All invariants and manual items, on tables with gaps and strays."""
    t = _tables(spark, sf)
    return _kinds(invariant=au.invariants(t), manual=au.manual_items(t))


def _one_sql(column: str) -> str:
    return f"(SELECT s.pattern_id FROM src s JOIN doc d ON d.id = s.document_id WHERE d.{column} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT d.{column}) = 1)"


_BACKFILLED = _counts_sql(
    "filled",
    **{f"chunk_{c}": f"chk c JOIN doc d ON d.id = c.document_id WHERE c.{c} IS NULL AND d.{c} IS NOT NULL" for c in ("tenant_id", "knowledge_base_id")},
    **{f"pattern_{c}": f"pat p WHERE {c} IS NULL AND id IN {_one_sql(c)}" for c in ("tenant_id", "knowledge_base_id")},
) + "\nUNION ALL " + _counts_sql(
    "left",
    **{f"chunk_{c}": f"chk c LEFT JOIN doc d ON d.id = c.document_id WHERE c.{c} IS NULL AND d.{c} IS NULL" for c in ("tenant_id", "knowledge_base_id")},
    **{f"pattern_{c}": f"pat p WHERE {c} IS NULL AND id NOT IN {_one_sql(c)}" for c in ("tenant_id", "knowledge_base_id")},
)


@q.query("ownership_backfill", v.with_views(*_VIEWS, body=f"{_TABLES_SQL} {_BACKFILLED}"))
def ownership_backfill(spark, sf):
    """Rows that the four trusted backfills fill, and the nulls that they leave."""
    after, filled = au.trusted_backfills(_tables(spark, sf))
    left = {f"{name}_{c}": rows.filter(F.col(c).isNull()) for c in ("tenant_id", "knowledge_base_id") for name, rows in (("chunk", after.chunks), ("pattern", after.patterns))}
    return _kinds(filled=filled, left=au._named(**left))


_RESTS = """kinds AS (
  SELECT s.pattern_id, bool_and(t = 'tender') AS only_excluded, bool_or(t = 'tender') AS any_excluded
  FROM src s JOIN (SELECT id, CASE trim(document_type) WHEN 'tender_doc' THEN 'tender' ELSE trim(document_type) END AS t FROM doc) d ON d.id = s.document_id GROUP BY 1),
 rests AS (SELECT p.id, p.status, only_excluded, any_excluded FROM pat p JOIN kinds k ON k.pattern_id = p.id WHERE any_excluded)"""
_QUARANTINE = f"""{_counts_sql(
    "before",
    documents_of_older_name="doc WHERE trim(document_type) = 'tender_doc'",
    documents_excluded="doc WHERE trim(document_type) = 'tender'",
    sources_excluded="src s JOIN doc d ON d.id = s.document_id WHERE trim(document_type) IN ('tender', 'tender_doc')",
    patterns_excluded_only="rests WHERE only_excluded",
    patterns_mixed="rests WHERE NOT only_excluded",
    patterns_quarantined_already="rests WHERE only_excluded AND status = 'quarantined'",
    patterns_active="pat WHERE status = 'active'",
)}
UNION ALL {_counts_sql(
    "changed",
    documents_renamed="doc WHERE trim(document_type) = 'tender_doc'",
    patterns_quarantined="rests WHERE only_excluded AND status <> 'quarantined'",
)}
UNION ALL SELECT 'after', 'documents_of_older_name', 0 UNION ALL SELECT 'after', 'patterns_active_excluded_only', 0
UNION ALL SELECT 'again', 'documents_renamed', 0 UNION ALL SELECT 'again', 'patterns_quarantined', 0"""  # fmt: skip


@q.query("quarantine_run", v.with_views(*_VIEWS, body=f"{_TABLES_SQL}, {_RESTS} {_QUARANTINE}"))
def quarantine_run(spark, sf):
    """Census, changes and verification of one quarantine, and of a second one that changes nothing."""
    t = _tables(spark, sf)
    after, changed = au.quarantined(t)
    _, again = au.quarantined(after)
    return _kinds(before=au.quarantine_census(t), changed=changed, after=au.verify_quarantine(after), again=again)


WORDS = ["the", "un", "der", "and"]


def _bm25_sql() -> str:
    size = "len(list_filter(t, lambda x: x = '{}'))"
    parts = [f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * {size.format(w)} * {rt.BM25_K + 1} / ({size.format(w)} + {rt.BM25_K} * (1 - {rt.BM25_B} + {rt.BM25_B} * (len(t) / mean)))" for i, w in enumerate(WORDS)]
    counts = ", ".join(f"count(*) FILTER (list_contains(t, '{w}'))::DOUBLE AS d{i}" for i, w in enumerate(WORDS))
    return f"""{q._VISIBLE},
 listed AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM visible),
 stats AS (SELECT count(*)::DOUBLE AS n, sum(len(t))::DOUBLE / count(*) AS mean, {counts} FROM listed)
SELECT id, round({" + ".join(parts)}, 6) AS score FROM listed, stats ORDER BY score DESC, id LIMIT 20"""


@q.query("rerank_bm25", v.with_views("d_chunk", "d_guard", body=_bm25_sql()))
def rerank_bm25(spark, sf):
    """Visible chunks by how well their words fit a query's, with the statistics of all visible chunks."""
    rows = rt.visible_chunks(v.d_chunk(spark, sf, embeddings=False), v.d_guard(spark, sf), q.TENANT)
    return rt.rerank(rows, F.col("content"), rt.bm25(rows, "content", WORDS), 20).select("id", "score")
