"""Queries over a published store: ingest in phases with two writers, saved patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import ingest as ig
from docloom.operators import patterns as pt
from docloom.plans import queries as q
from docloom.plans import views as v
from docloom.session import shared_path
from docloom.sources import tables as tb
from docloom.sources.publish import Store

DIM = 4
BUCKETS = 8
OLD_SECTION = 1000


def cross_check_embedder(dim: int = DIM):
    """A stand-in whose vectors count characters; texts with an at sign get one number too many."""

    def factory():
        return lambda texts: [[float(len(t) % (k + 2)) for k in range(dim + ("@" in t))] for t in texts]

    return factory


def _guard(spark, sf) -> DataFrame:
    """The guard; what has no version has no hash either."""
    g = v.d_guard(spark, sf)
    return g.withColumn("index_input_hash", F.when(F.col("current_index_version").isNotNull(), F.col("index_input_hash")))


def _parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Sections (temporary ids from 0 in preorder) and chunks, each line with the section of its heading."""
    sections = q._tree(spark, sf).select("document_id", F.col("section_id").alias("id"), "parent_id", "title", "level")
    lines = v.d_lines(spark, sf)
    chunks = lines.select("document_id", F.floor(F.col("pos") / 4).cast("int").alias("section_id"), F.col("pos").alias("chunk_index"), F.col("text").alias("content"))
    return sections, chunks


def filled_store(spark, sf) -> Store:
    """A store with a guard, a section and a chunk for each guarded document, and jobs."""
    store = Store(spark, shared_path(spark, "store"), BUCKETS)
    guard = _guard(spark, sf)
    i = F.col("document_id")
    section = guard.select(i.alias("id"), i, F.lit("old").alias("title")).withColumn("id", F.col("id") + OLD_SECTION)
    chunk = guard.select((i * 2 + 1).alias("id"), i, "tenant_id", F.lit("old").alias("content"), F.lit(0).alias("chunk_index"))
    tables = {"guard": guard, "section": section, "chunk": chunk, "job": q._jobs(spark, sf)}
    store.publish({n: tb.fitted(t, tb.TABLES[n]) for n, t in tables.items()}, tb.TABLES)
    return store


def _requests(spark, sf, offset: int) -> DataFrame:
    """Requests for every document but those of one remainder; versions go up and down with the offset."""
    i = F.col("id")
    asked = v.d_document(spark, sf).filter(i % 4 != offset)
    wrong = i % 9 == 0
    return asked.select(
        (i * 2 + offset).alias("request_id"), i.alias("document_id"), F.when(wrong, F.lit(99)).otherwise(F.col("tenant_id")).cast("long").alias("tenant_id"), ((i + offset * 3) % 7 + 1).alias("index_version"),
        F.md5(F.when(i % 8 == 0, F.lit("x")).otherwise(i.cast("string"))).alias("input_hash"), "document_type",
    )


def _decide_sql(guard: str) -> str:
    return f"""CASE WHEN g.document_id IS NULL THEN 'APPLY' WHEN g.tenant_id <> a.tenant_id THEN 'REJECT_TENANT_MISMATCH'
   WHEN lifecycle_status = 'DELETED' THEN 'REJECT_DELETED' WHEN lifecycle_status <> 'ACTIVE' THEN 'REJECT_QUARANTINED'
   WHEN current_index_version IS NULL THEN 'APPLY' WHEN index_version < current_index_version THEN 'REJECT_STALE'
   WHEN index_version > current_index_version THEN 'APPLY' WHEN input_hash = index_input_hash THEN 'IDEMPOTENT'
   ELSE 'REJECT_VERSION_MISMATCH' END AS decision
  FROM {guard} g RIGHT JOIN a USING (document_id)"""


def _asked_sql(offset: int) -> str:
    return f"""SELECT id AS document_id, CASE WHEN id % 9 = 0 THEN 99 ELSE tenant_id END AS tenant_id, (id + {offset * 3}) % 7 + 1 AS index_version,
   md5(CASE WHEN id % 8 = 0 THEN 'x' ELSE id::VARCHAR END) AS input_hash FROM d_document WHERE id % 4 <> {offset}"""


def _after_sql(guard: str, applied: str) -> str:
    return f"""SELECT coalesce(a.document_id, g.document_id) AS document_id, coalesce(g.tenant_id, a.tenant_id) AS tenant_id,
   CASE WHEN a.document_id IS NULL THEN lifecycle_status ELSE 'ACTIVE' END AS lifecycle_status,
   CASE WHEN a.document_id IS NULL THEN current_index_version ELSE a.index_version END AS current_index_version,
   CASE WHEN a.document_id IS NULL THEN index_input_hash ELSE a.input_hash END AS index_input_hash
  FROM {guard} g FULL JOIN {applied} a ON a.document_id = g.document_id"""


def _finish_sql(name: str, first: str, guard: str) -> str:
    """What a writer's last phase decides for the requests that its first phase let through."""
    return f"""{name}_open AS (SELECT a.* FROM {first} f JOIN {name}_asked a USING (document_id) WHERE f.decision = 'APPLY'),
 {name}_again AS (SELECT a.document_id, a.tenant_id, a.index_version, a.input_hash, {_decide_sql(guard).replace(" a USING", f" {name}_open a USING")}),
 {name}_final AS (SELECT document_id, tenant_id, index_version, input_hash,
   CASE WHEN decision = 'APPLY' AND document_id IN (SELECT document_id FROM wrong) THEN 'REJECT_VECTORS' ELSE decision END AS decision FROM {name}_again),
 {name}_applied AS (SELECT * FROM {name}_final WHERE decision = 'APPLY')"""


def _first_sql(name: str, offset: int) -> str:
    return f"""{name}_asked AS ({_asked_sql(offset)}),
 {name}_first AS (SELECT a.document_id, {_decide_sql("guard0").replace(" a USING", f" {name}_asked a USING")})"""


def _numbered_sql(name: str, rows: str, order: str, applied: str, start: str) -> str:
    return f"{name} AS (SELECT *, {start} + row_number() OVER (ORDER BY document_id, {order}) AS id FROM {rows} WHERE document_id IN (SELECT document_id FROM {applied}))"


_TWO_WRITERS = f"""guard0 AS (SELECT * REPLACE (CASE WHEN current_index_version IS NOT NULL THEN index_input_hash END AS index_input_hash) FROM d_guard),
 wrong AS (SELECT DISTINCT document_id FROM d_lines WHERE contains(text, '@')),
 {_first_sql("slow", 3)}, {_first_sql("fast", 1)},
 {_finish_sql("fast", "fast_first", "guard0")},
 guard1 AS ({_after_sql("guard0", "fast_applied")}),
 {_finish_sql("slow", "slow_first", "guard1")},
 guard2 AS ({_after_sql("guard1", "slow_applied")}),
 {_numbered_sql("fast_section", "tree", "section_id", "fast_applied", f"(SELECT max(document_id) + {OLD_SECTION} FROM guard0)")},
 {_numbered_sql("slow_section", "tree", "section_id", "slow_applied", f"coalesce((SELECT max(id) FROM fast_section), (SELECT max(document_id) + {OLD_SECTION} FROM guard0))")},
 {_numbered_sql("fast_chunk", "d_lines", "pos", "fast_applied", "(SELECT max(document_id) * 2 + 1 FROM guard0)")},
 {_numbered_sql("slow_chunk", "d_lines", "pos", "slow_applied", "coalesce((SELECT max(id) FROM fast_chunk), (SELECT max(document_id) * 2 + 1 FROM guard0))")},
 section AS (
  SELECT document_id, id, NULL AS parent FROM (SELECT document_id, document_id + {OLD_SECTION} AS id FROM guard0)
   WHERE document_id NOT IN (SELECT document_id FROM fast_applied) AND document_id NOT IN (SELECT document_id FROM slow_applied)
  UNION ALL SELECT s.document_id, s.id, p.id FROM fast_section s LEFT JOIN fast_section p ON p.document_id = s.document_id AND p.section_id = s.parent_id
   WHERE s.document_id NOT IN (SELECT document_id FROM slow_applied)
  UNION ALL SELECT s.document_id, s.id, p.id FROM slow_section s LEFT JOIN slow_section p ON p.document_id = s.document_id AND p.section_id = s.parent_id),
 chunk AS (
  SELECT document_id, document_id * 2 + 1 AS id, NULL AS section, NULL AS place FROM guard0
   WHERE document_id NOT IN (SELECT document_id FROM fast_applied) AND document_id NOT IN (SELECT document_id FROM slow_applied)
  UNION ALL SELECT c.document_id, c.id, s.id, c.pos FROM fast_chunk c LEFT JOIN fast_section s ON s.document_id = c.document_id AND s.section_id = c.pos // 4
   WHERE c.document_id NOT IN (SELECT document_id FROM slow_applied)
  UNION ALL SELECT c.document_id, c.id, s.id, c.pos FROM slow_chunk c LEFT JOIN slow_section s ON s.document_id = c.document_id AND s.section_id = c.pos // 4),
 sections AS (SELECT document_id, count(*) AS n_sections, sum(id)::BIGINT AS section_ids, coalesce(sum(parent), 0)::BIGINT AS parent_ids FROM section GROUP BY 1),
 chunks AS (SELECT document_id, count(*) AS n_chunks, sum(id)::BIGINT AS chunk_ids, coalesce(sum(section), 0)::BIGINT AS chunk_sections FROM chunk GROUP BY 1)
SELECT document_id, tenant_id, lifecycle_status, coalesce(current_index_version, -1) AS version,
 coalesce(fast_final.decision, fast_first.decision, 'NONE') AS fast, coalesce(slow_final.decision, slow_first.decision, 'NONE') AS slow,
 coalesce(n_sections, 0) AS n_sections, coalesce(section_ids, 0) AS section_ids, coalesce(parent_ids, 0) AS parent_ids,
 coalesce(n_chunks, 0) AS n_chunks, coalesce(chunk_ids, 0) AS chunk_ids, coalesce(chunk_sections, 0) AS chunk_sections
FROM guard2 LEFT JOIN (SELECT document_id, decision FROM fast_final) fast_final USING (document_id) LEFT JOIN fast_first USING (document_id)
 LEFT JOIN (SELECT document_id, decision FROM slow_final) slow_final USING (document_id) LEFT JOIN slow_first USING (document_id)
 LEFT JOIN sections USING (document_id) LEFT JOIN chunks USING (document_id)"""


@q.query("two_writers", v.with_views("d_document", "d_guard", "d_block", body=f"{q._HEADS_SQL}, {_TWO_WRITERS}"))
def two_writers(spark, sf):
    """Two ingests of nearly all documents, begun at the same version; the second to finish meets what the first published.

    Sections and chunks of the store after both, by document: how many, and sums of their ids, parents and sections.
    """
    store = filled_store(spark, sf)
    sections, chunks = _parts(spark, sf)
    slow = ig.begin(store, _requests(spark, sf, 3))
    fast = ig.begin(store, _requests(spark, sf, 1))
    first = ig.finish(store, ig.embed_parts(store, fast, sections, chunks, cross_check_embedder(), DIM))
    second = ig.finish(store, ig.embed_parts(store, slow, sections, chunks, cross_check_embedder(), DIM))
    at = store.pin()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    per_section = store.read("section", at, tb.SECTION).groupBy("document_id").agg(F.count("*").alias("n_sections"), total("id").alias("section_ids"), total("parent_id").alias("parent_ids"))
    per_chunk = store.read("chunk", at, tb.CHUNK).groupBy("document_id").agg(F.count("*").alias("n_chunks"), total("id").alias("chunk_ids"), total("section_id").alias("chunk_sections"))
    out = store.read("guard", at, tb.GUARD).select("document_id", "tenant_id", "lifecycle_status", F.coalesce("current_index_version", F.lit(-1)).alias("version"))
    for name, done in (("fast", first), ("slow", second)):
        out = out.join(done.decisions.select("document_id", F.col("decision").alias(name)), "document_id", "left")
    out = out.join(per_section, "document_id", "left").join(per_chunk, "document_id", "left")
    zero = ["n_sections", "section_ids", "parent_ids", "n_chunks", "chunk_ids", "chunk_sections"]
    return out.fillna(0, zero).fillna("NONE", ["fast", "slow"])


def _candidates(spark, sf) -> DataFrame:
    """A pattern for each fourth line of every document, described by its text; types, owners and versions as they come."""
    i = F.col("document_id")
    d = v.d_document(spark, sf).select(F.col("id").alias("document_id"), "tenant_id", "document_type")
    g = v.d_guard(spark, sf).select("document_id", F.col("current_index_version").alias("held"))
    lines = v.d_lines(spark, sf).filter("pos % 4 = 0 AND trim(text) <> ''")
    return lines.join(d, "document_id").join(g, "document_id", "left").select(
        i, "tenant_id", (F.coalesce("held", F.lit(1)) + F.when(i % 14 == 1, 1).otherwise(0)).alias("index_version"), F.concat(F.lit("w"), F.when(i % 10 == 0, 9).otherwise(i % 3).cast("string")).alias("owner_id"),
        "document_type", F.col("pos").cast("long").alias("section_id"), F.lit("SP").alias("code"), F.substring("text", 1, 20).alias("name"), F.col("text").alias("summary"), F.col("pos").alias("page_start"), F.col("pos").alias("page_end"),
    )


def _pattern_store(spark, sf) -> Store:
    """A store whose patterns are the first lines of every fifth document, some quarantined, with running jobs."""
    store = Store(spark, shared_path(spark, "store"), BUCKETS)
    i = F.col("document_id")
    lines = v.d_lines(spark, sf).filter("pos = 0 AND document_id % 5 = 0 AND trim(text) <> ''")
    pattern = lines.select((i + 1).alias("id"), (i % 3 + 1).alias("tenant_id"), F.lit("old").alias("name"), F.sha1(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("fingerprint"), F.when(i % 15 == 0, "quarantined").otherwise("active").alias("status"))
    source = lines.select((i + 1).alias("pattern_id"), i, F.lit(0).cast("long").alias("section_id"))
    jobs = _guard(spark, sf).filter("current_index_version IS NOT NULL").select("document_id", "tenant_id", F.col("current_index_version").alias("index_version"), F.when(i % 6 == 0, "PENDING").otherwise("RUNNING").alias("state"), F.concat(F.lit("w"), (i % 3).cast("string")).alias("owner_id"))
    tables = {"guard": _guard(spark, sf), "pattern": pattern, "pattern_source": source, "job": jobs}
    store.publish({n: tb.fitted(t, tb.TABLES[n]) for n, t in tables.items()}, tb.TABLES)
    return store


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_SAVED = f"""asked AS (
  SELECT l.document_id, d.tenant_id, l.pos AS section_id, d.document_type, sha1({_STRIPPED}) AS fingerprint,
   coalesce(g.current_index_version, 1) + (l.document_id % 14 = 1)::INT AS index_version, g.current_index_version AS held, g.lifecycle_status,
   l.document_id % 10 <> 0 AND l.document_id % 6 <> 0 AS owned
  FROM d_lines l JOIN (SELECT id, tenant_id, document_type FROM d_document) d ON d.id = l.document_id LEFT JOIN d_guard g ON g.document_id = l.document_id WHERE l.pos % 4 = 0 AND trim(l.text) <> ''),
 gated AS (
  SELECT *, CASE WHEN trim(document_type) IN ('tender', 'tender_doc') OR trim(document_type) NOT IN ({", ".join(f"'{t}'" for t in v.RAW_TYPES)}) THEN 'REJECT_TYPE'
   WHEN held IS NULL OR held <> index_version OR lifecycle_status <> 'ACTIVE' OR NOT owned THEN 'REJECT_JOB' END AS refused FROM asked),
 good AS (SELECT * FROM gated WHERE refused IS NULL),
 old AS (
  SELECT document_id + 1 AS id, document_id % 3 + 1 AS tenant_id, sha1({_STRIPPED}) AS fingerprint, CASE WHEN document_id % 15 = 0 THEN 'quarantined' ELSE 'active' END AS status
  FROM d_lines WHERE pos = 0 AND document_id % 5 = 0 AND trim(text) <> ''),
 adopted AS (SELECT tenant_id, fingerprint, min(id) AS id FROM old WHERE status = 'active' GROUP BY 1, 2),
 firsts AS (
  SELECT * FROM good g QUALIFY row_number() OVER (PARTITION BY tenant_id, fingerprint ORDER BY document_id, section_id) = 1),
 fresh AS (
  SELECT tenant_id, fingerprint, (SELECT max(id) FROM old) + row_number() OVER (ORDER BY document_id, section_id) AS id
  FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM adopted a WHERE a.tenant_id = f.tenant_id AND a.fingerprint = f.fingerprint)),
 ids AS (SELECT tenant_id, fingerprint, id FROM adopted UNION ALL SELECT tenant_id, fingerprint, id FROM fresh),
 source AS (
  SELECT id AS pattern_id, id - 1 AS document_id, 0 AS section_id FROM old
  UNION SELECT ids.id, g.document_id, g.section_id FROM good g JOIN ids USING (tenant_id, fingerprint)),
 per_pattern AS (SELECT pattern_id, count(*) AS n_sources, sum(document_id)::BIGINT AS documents, sum(section_id)::BIGINT AS sections FROM source GROUP BY 1),
 job AS (
  SELECT CASE WHEN document_id % 6 = 0 THEN 'PENDING' WHEN document_id IN (SELECT document_id FROM good) THEN 'COMPLETED' ELSE 'RUNNING' END AS state
  FROM d_guard WHERE current_index_version IS NOT NULL)
SELECT 'pattern' AS kind, p.id, p.tenant_id, p.fingerprint AS what, p.status AS state, n_sources AS n, documents, sections
FROM (SELECT * FROM old UNION ALL SELECT id, tenant_id, fingerprint, 'active' FROM fresh) p JOIN per_pattern ON pattern_id = p.id
UNION ALL SELECT 'candidate', -1, -1, coalesce(refused, 'SAVED'), '', count(*), -1, -1 FROM gated GROUP BY refused
UNION ALL SELECT 'job', -1, -1, 'pattern', state, count(*), -1, -1 FROM job GROUP BY state"""


@q.query("pattern_save", v.with_views("d_document", "d_guard", "d_lines", body=_SAVED))
def pattern_save(spark, sf):
    """Every stored pattern after one call over all documents' candidates, what became of these, and the jobs."""
    store = _pattern_store(spark, sf)
    saved = pt.save(store, _candidates(spark, sf))
    at = store.pin()
    per = store.read("pattern_source", at, tb.PATTERN_SOURCE).groupBy("pattern_id").agg(F.count("*").alias("n"), F.sum("document_id").alias("documents"), F.sum("section_id").alias("sections"))
    patterns = store.read("pattern", at, tb.PATTERN).join(per, F.col("id") == F.col("pattern_id")).select(F.lit("pattern").alias("kind"), "id", "tenant_id", F.col("fingerprint").alias("what"), F.col("status").alias("state"), "n", "documents", "sections")
    none = F.lit(-1).cast("long")

    def counted(rows: DataFrame, kind: str, what: F.Column, state: F.Column) -> DataFrame:
        grouped = rows.select(what.alias("what"), state.alias("state")).groupBy("what", "state").agg(F.count("*").alias("n"))
        return grouped.select(F.lit(kind).alias("kind"), none.alias("id"), none.alias("tenant_id"), "what", "state", "n", none.alias("documents"), none.alias("sections"))

    verdict = F.when(F.col("verdict").isin(pt.INSERTED, pt.ADOPTED, pt.MERGED), "SAVED").otherwise(F.col("verdict"))
    candidates = counted(saved.verdicts, "candidate", verdict, F.lit(""))
    return patterns.unionByName(candidates).unionByName(counted(store.read("job", at, tb.JOB), "job", F.lit("pattern"), F.col("state")))
