"""Queries of the composed operations: a whole retrieval request, guarded ingest, deletion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import doctypes as dt
from docloom.operators import ingest as ig
from docloom.operators import rag
from docloom.plans import queries as q
from docloom.plans import views as v

FACTS = ["qualification", "project_case"]
TYPED = ["pattern_kind_4", "pattern_kind_8", "pattern_kind_11"]


def _request(spark, sf: str) -> dict:
    chunks = v.d_chunk(spark, sf).withColumn("section_id", F.floor(F.col("chunk_index") / 4) + 1)
    sections = q._tree(spark, sf).select("document_id", F.col("section_id").alias("id"), "parent_id")
    index = rag.Index(chunks, v.d_guard(spark, sf), v.d_document(spark, sf).drop("text"), sections, v.d_pattern(spark, sf), v.d_pattern_source(spark, sf))
    asked = rag.Request(q._query_vector(spark, sf), q.KEYWORD, pattern_types=TYPED, pattern_document_types=q._SCOPE, fact_types=FACTS)
    return rag.run(index, q.TENANT, asked)


def _hybrid_sql(name: str, where: str, k: int) -> str:
    """Common table expressions that end in ``name``: id, document_id, chunk_index, content, rank."""
    return f"""{name}_rows AS (SELECT * FROM visible WHERE {where}),
 {name}_v AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) - 1 AS v_rank FROM (SELECT id, {q._SIM} AS similarity FROM {name}_rows WHERE embedding IS NOT NULL ORDER BY similarity DESC, id LIMIT 60)),
 {name}_k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k_rank FROM (SELECT id FROM {name}_rows WHERE content ILIKE '%{q.KEYWORD}%' ORDER BY id LIMIT 60)),
 {name}_f AS (
  SELECT coalesce(a.id, b.id) AS id, v_rank, k_rank,
   round(coalesce(1.0::DOUBLE / (v_rank + 61), 0) + coalesce(1.0::DOUBLE / (k_rank + 61), 0), 9) AS score
  FROM {name}_v a FULL JOIN {name}_k b ON a.id = b.id),
 {name} AS (
  SELECT r.id, r.document_id, r.chunk_index, r.content, rank
  FROM (SELECT id, row_number() OVER (ORDER BY score DESC, v_rank NULLS LAST, k_rank) AS rank FROM {name}_f) JOIN {name}_rows r USING (id)
  WHERE rank <= {k})"""


_CHANNELS = f"{q._VISIBLE},\n {_hybrid_sql('evidence', 'true', 10)},\n {_hybrid_sql('fact', f'document_type IN ({str(FACTS)[1:-1]})', 5)}"
_FOUND = f"""live AS (SELECT id, type, fingerprint, {q._SIM} AS similarity FROM allowed WHERE status = 'active' AND embedding IS NOT NULL),
 typed AS (SELECT * FROM live WHERE type IN ({str(TYPED)[1:-1]}) ORDER BY similarity DESC, id LIMIT 5),
 untyped AS (SELECT * FROM live ORDER BY similarity DESC, id LIMIT 5),
 found AS (SELECT * FROM typed UNION ALL SELECT * FROM untyped WHERE NOT EXISTS (SELECT 1 FROM typed)),
 pattern AS (
  SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS rank
  FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY similarity DESC, id) = 1))"""
_SECTIONS = """hit AS (SELECT DISTINCT document_id, chunk_index // 4 + 1 AS section_id FROM evidence),
 near AS (SELECT * FROM tree WHERE document_id IN (SELECT document_id FROM hit)),
 up AS (SELECT DISTINCT document_id, parent_id FROM near JOIN hit USING (document_id, section_id) WHERE coalesce(parent_id, 0) <> 0),
 section AS (
  SELECT document_id, section_id AS id FROM near
  WHERE (document_id, section_id) IN (SELECT document_id, section_id FROM hit)
   OR (document_id, section_id) IN (SELECT document_id, parent_id FROM up)
   OR (document_id, parent_id) IN (SELECT document_id, parent_id FROM up))"""
_TRACE = """SELECT 'evidence' AS layer, document_id, id, rank FROM evidence
UNION ALL SELECT 'enterprise_fact', document_id, id, rank FROM fact
UNION ALL SELECT 'section', document_id, id, 0 FROM section
UNION ALL SELECT 'pattern', -1, id, rank FROM pattern"""


@q.query("rag_request_trace", v.with_views("d_block", "d_chunk", *q._PV, body=f"{q._HEADS_SQL}, {_CHANNELS}, {q._ALLOWED}, {_FOUND}, {_SECTIONS} {_TRACE}"))
def rag_request_trace(spark, sf):
    """What one request used, layer by layer."""
    return _request(spark, sf)["trace"].select("layer", F.coalesce("document_id", F.lit(-1)).alias("document_id"), "id", "rank")


_BLOCK = "'[' || rank || '] ' || CASE WHEN length(content) > 3000 THEN left(content, 3000) || '...' ELSE content END"
_CONTEXT = f"""SELECT layer, sha256(string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank)) AS text_hash
FROM (SELECT 'evidence' AS layer, rank, content FROM evidence UNION ALL SELECT 'enterprise_fact', rank, content FROM fact) GROUP BY 1"""


@q.query("rag_request_context", v.with_views("d_chunk", "d_guard", body=f"{_CHANNELS} {_CONTEXT}"))
def rag_request_context(spark, sf):
    """The numbered text that the request gives to the model, by layer."""
    return _request(spark, sf)["context"].select("layer", F.sha2("evidence", 256).alias("text_hash"))


_DECIDED = """asked AS (
  SELECT id AS document_id, CASE WHEN id % 9 = 0 THEN 99 ELSE tenant_id END AS tenant_id, id % 7 + 1 AS index_version,
   md5(CASE WHEN id % 8 = 0 THEN 'x' ELSE id::VARCHAR END) AS input_hash
  FROM d_document WHERE id % 4 < 3),
 decided AS (
  SELECT a.*, CASE WHEN g.document_id IS NULL THEN 'APPLY' WHEN g.tenant_id <> a.tenant_id THEN 'REJECT_TENANT_MISMATCH'
   WHEN lifecycle_status = 'DELETED' THEN 'REJECT_DELETED' WHEN lifecycle_status <> 'ACTIVE' THEN 'REJECT_QUARANTINED'
   WHEN current_index_version IS NULL THEN 'APPLY' WHEN index_version < current_index_version THEN 'REJECT_STALE'
   WHEN index_version > current_index_version THEN 'APPLY' WHEN input_hash = index_input_hash THEN 'IDEMPOTENT'
   ELSE 'REJECT_VERSION_MISMATCH' END AS decision
  FROM asked a LEFT JOIN d_guard g USING (document_id)),
 applied AS (SELECT * FROM decided WHERE decision = 'APPLY'),
 after AS (
  SELECT coalesce(a.document_id, g.document_id) AS document_id, coalesce(g.tenant_id, a.tenant_id) AS tenant_id,
   CASE WHEN a.document_id IS NULL THEN lifecycle_status ELSE 'ACTIVE' END AS lifecycle_status,
   CASE WHEN a.document_id IS NULL THEN current_index_version ELSE a.index_version END AS version
  FROM d_guard g FULL JOIN applied a ON a.document_id = g.document_id),
 chunk AS (
  SELECT document_id, id FROM d_chunk WHERE document_id NOT IN (SELECT document_id FROM applied)
  UNION ALL SELECT document_id, id + 7 FROM d_chunk WHERE document_id IN (SELECT document_id FROM applied) AND chunk_index % 2 = 0),
 counted AS (SELECT document_id, count(*) AS n_chunks, sum(id)::BIGINT AS ids FROM chunk GROUP BY 1),
 job AS (
  SELECT j.document_id, CASE WHEN (j.index_version < a.version AND state NOT IN ('COMPLETED', 'OBSOLETE'))
   OR (a.lifecycle_status = 'DELETED' AND state IN ('PENDING', 'RUNNING')) THEN 'OBSOLETE' ELSE state END AS state
  FROM jobs j LEFT JOIN after a USING (document_id))
SELECT a.document_id, coalesce(decision, 'NONE') AS decision, a.tenant_id, a.lifecycle_status, coalesce(version, -1) AS version,
 coalesce(n_chunks, 0) AS n_chunks, coalesce(ids, 0) AS ids, coalesce(state, 'NONE') AS state
FROM after a LEFT JOIN decided d USING (document_id) LEFT JOIN counted USING (document_id) LEFT JOIN job USING (document_id)"""


@q.query("guarded_ingest", v.with_views("d_document", "d_guard", "d_chunk", body=f"{q._JOBS}, {_DECIDED}"))
def guarded_ingest(spark, sf):
    """Documents of the guard after one ingest: decision, version, chunks and the state of their job."""
    i = F.col("id")
    asked = v.d_document(spark, sf).filter("id % 4 < 3").select(
        i.alias("request_id"), i.alias("document_id"), F.when(i % 9 == 0, F.lit(99)).otherwise(F.col("tenant_id")).cast("long").alias("tenant_id"), (i % 7 + 1).alias("index_version"), F.md5(F.when(i % 8 == 0, "x").otherwise(i.cast("string"))).alias("input_hash")
    )
    chunks = v.d_chunk(spark, sf, embeddings=False).select("document_id", "id", "chunk_index")
    staged = chunks.filter("chunk_index % 2 = 0").withColumn("id", i + 7)
    done = ig.ingest(asked, staged, v.d_guard(spark, sf), chunks, q._jobs(spark, sf))
    counted = done.chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum("id").alias("ids"))
    out = done.guard.join(done.decisions.select("document_id", "decision"), "document_id", "left").join(counted, "document_id", "left").join(done.jobs.select("document_id", "state"), "document_id", "left")
    none = lambda c: F.coalesce(c, F.lit("NONE")).alias(c)
    return out.select("document_id", none("decision"), "tenant_id", "lifecycle_status", F.coalesce("current_index_version", F.lit(-1)).alias("version"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("ids", F.lit(0)).alias("ids"), none("state"))


_REMOVED = """asked AS (SELECT id AS document_id, CASE WHEN id % 20 = 4 THEN 99 ELSE tenant_id END AS tenant_id FROM d_document WHERE id % 10 = 4),
 mine AS (SELECT document_id, lifecycle_status FROM d_guard JOIN asked USING (document_id, tenant_id)),
 gone AS (SELECT * FROM d_pattern_source WHERE document_id IN (SELECT document_id FROM mine)),
 kept AS (SELECT * FROM d_pattern_source WHERE document_id NOT IN (SELECT document_id FROM mine)),
 job AS (
  SELECT CASE WHEN (j.index_version < g.current_index_version AND state NOT IN ('COMPLETED', 'OBSOLETE'))
   OR ((g.lifecycle_status = 'DELETED' OR document_id IN (SELECT document_id FROM mine)) AND state IN ('PENDING', 'RUNNING')) THEN 'OBSOLETE' ELSE state END AS state
  FROM jobs j LEFT JOIN d_guard g USING (document_id))
SELECT 'documents' AS name, count(*) AS n FROM mine WHERE lifecycle_status <> 'DELETED'
UNION ALL SELECT 'chunks', count(*) FROM d_chunk WHERE document_id IN (SELECT document_id FROM mine)
UNION ALL SELECT 'sources', count(*) FROM gone
UNION ALL SELECT 'patterns', count(DISTINCT pattern_id) FROM gone WHERE pattern_id NOT IN (SELECT pattern_id FROM kept) AND pattern_id IN (SELECT id FROM d_pattern)
UNION ALL SELECT 'jobs ' || state, count(*) FROM job GROUP BY state"""


@q.query("guarded_delete", v.with_views("d_document", "d_guard", "d_chunk", "d_pattern", "d_pattern_source", body=f"{q._JOBS}, {_REMOVED}"))
def guarded_delete(spark, sf):
    """Counters of one deletion, and the jobs by state after it."""
    i = F.col("id")
    asked = v.d_document(spark, sf).filter("id % 10 = 4").select(i.alias("document_id"), F.when(i % 20 == 4, F.lit(99)).otherwise(F.col("tenant_id")).cast("long").alias("tenant_id"))
    chunks = v.d_chunk(spark, sf, embeddings=False).select("document_id", "id")
    done = ig.delete_documents(asked, v.d_guard(spark, sf), chunks, v.d_pattern(spark, sf).select("id"), v.d_pattern_source(spark, sf), q._jobs(spark, sf))
    jobs = done.jobs.groupBy("state").agg(F.count("*").alias("n")).select(F.concat(F.lit("jobs "), "state").alias("name"), "n")
    return done.counters.unionByName(jobs)


QUESTION = "How to plan for keit and ouan?"
#: What the rules say to the question.
_ASKED_TYPES = [t for _, _, words, types in q.INTENTS if any(w in QUESTION.lower() for w in words) for t in types]
_MARK = "tion"
_SCORES = [(1, "Price", "forty points", 3), (2, "", "sixty points", None)]


def requirement_reader():
    """A stand-in that takes every line of some length as a requirement, with its number as page."""
    import json

    def read(text: str) -> str:
        lines = [(n, x) for n, x in enumerate(text.split("\n")) if len(x) >= 20]
        return json.dumps([{"title": f"R{n}", "text": x[:50], "page": str(n)} for n, x in lines])

    return lambda texts: [read(t) for t in texts]


def counting_writer():
    """A stand-in whose answer says how long the prompt was, and in how many lines."""
    return lambda prompt: f"answer to {len(prompt)} in {prompt.count(chr(10))}"


_TENDER = f"""tender AS (SELECT min(id) AS id FROM d_document WHERE tenant_id = 1 AND {q._TYPE_SQL} = 'tender'),
 item AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS item_no, pos, regexp_replace(left(text, 50), '^\\s+|\\s+$', '', 'g') AS text FROM d_lines WHERE document_id = (SELECT id FROM tender) AND length(text) >= 20),
 requirement AS (SELECT row_number() OVER (ORDER BY item_no) AS n, 'R' || pos AS title, text, pos AS page FROM item WHERE NOT contains(text, '{_MARK}') AND text <> '')"""
_ANSWERED = f"""material AS (
  SELECT 1 AS place, 'requirement' AS layer, string_agg(n || '. ' || title || ': ' || text || ' (page ' || page || ')', chr(10) ORDER BY n) AS text FROM requirement HAVING count(*) > 0
  UNION ALL SELECT 2, 'score', '1. Price: forty points (page 3)' || chr(10) || '2. sixty points'
  UNION ALL SELECT CASE layer WHEN 'evidence' THEN 3 ELSE 4 END, layer, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank)
   FROM (SELECT 'evidence' AS layer, rank, content FROM evidence UNION ALL SELECT 'enterprise_fact', rank, content FROM fact) GROUP BY layer),
 prompt AS (SELECT string_agg('## ' || layer || chr(10) || text, chr(10) || chr(10) ORDER BY place) || chr(10) || chr(10) || '## question' || chr(10) || '{QUESTION}' AS prompt FROM material)
SELECT 'answer' AS kind, 'answer to ' || length(prompt) || ' in ' || length(regexp_replace(prompt, '[^\n]', '', 'g')) AS text, -1 AS id FROM prompt
UNION ALL SELECT 'prompt', sha256(prompt), -1 FROM prompt
UNION ALL SELECT 'intent', 'schedule,security: {",".join(dict.fromkeys(_ASKED_TYPES))}', -1
UNION ALL SELECT 'requirement', title, n FROM requirement
UNION ALL SELECT 'pattern', '', id FROM pattern"""


@q.query("rag_answer", v.with_views("d_chunk", "d_lines", *q._PV, body=f"{_CHANNELS}, {q._ALLOWED}, {_FOUND.replace(str(TYPED)[1:-1], str(_ASKED_TYPES)[1:-1])}, {_TENDER}, {_ANSWERED}"))
def rag_answer(spark, sf):
    """One question with its intent, the requirements of a tender, retrieval, prompt and answer."""
    chunks = v.d_chunk(spark, sf).withColumn("section_id", F.floor(F.col("chunk_index") / 4) + 1)
    sections = q._tree(spark, sf).select("document_id", F.col("section_id").alias("id"), "parent_id")
    documents = v.d_document(spark, sf)
    index = rag.Index(chunks, v.d_guard(spark, sf), documents.drop("text"), sections, v.d_pattern(spark, sf), v.d_pattern_source(spark, sf))
    tender = documents.filter((F.col("tenant_id") == 1) & dt.is_excluded(F.col("document_type"))).orderBy("id").limit(1).select("text")
    rules = spark.createDataFrame(q.INTENTS, "rule_order int, domain string, keywords array<string>, pattern_types array<string>")
    question = rag.Question(QUESTION, rules, q.TASK_WORDS, scores=spark.createDataFrame(_SCORES, rag.ITEM), tender=tender, extract=requirement_reader, score_marks=[_MARK])
    asked = rag.Request(q._query_vector(spark, sf), q.KEYWORD, pattern_document_types=q._SCOPE, fact_types=FACTS)
    done = rag.ask(index, q.TENANT, question, asked, counting_writer, expand=False)
    none = F.lit(-1).cast("long").alias("id")
    intent = done["intent"].select(F.lit("intent").alias("kind"), F.concat(F.array_join("domains", ","), F.lit(": "), F.array_join("pattern_types", ",")).alias("text"), none)
    n = F.row_number().over(Window.orderBy("item_no", "text")).cast("long").alias("id")
    items = done["requirements"].select(F.lit("requirement").alias("kind"), F.col("title").alias("text"), n)
    patterns = done["patterns"].select(F.lit("pattern").alias("kind"), F.lit("").alias("text"), "id")
    answer = done["answer"].select(F.lit("answer").alias("kind"), F.col("answer").alias("text"), none)
    prompt = done["prompt"].select(F.lit("prompt").alias("kind"), F.sha2("prompt", 256).alias("text"), none)
    return answer.unionByName(prompt).unionByName(intent).unionByName(items).unionByName(patterns)
