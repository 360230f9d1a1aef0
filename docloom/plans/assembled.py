"""Queries of records, labels, prompts, nested output, totals, task queues and the way from blocks to chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.context import TenantContext
from docloom.functions import scalar as s
from docloom.operators import assembly as asm
from docloom.operators import chunking as ck
from docloom.operators import evidence as ev
from docloom.operators import extraction as ex
from docloom.operators import lifecycle as lc
from docloom.operators import retrieval as rt
from docloom.operators import structure as st
from docloom.plans import queries as q
from docloom.plans import views as v
from docloom.session import shared_path
from docloom.sources import files
from docloom.streaming import handlers as hd
from docloom.streaming import tasks

_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _documents(spark, sf):
    return v.t(spark, sf, "documents")


def _hash(c: F.Column) -> F.Column:
    return F.sha2(c, 256)


@q.query(
    "embedding_text",
    """SELECT doc_id, sha256('name: P' || doc_id || chr(10) || 'language: ' || coalesce(lang, '') || chr(10) || 'summary: ' || coalesce(text, '')
 || CASE WHEN doc_id % 3 <> 0 THEN coalesce(chr(10) || 'lines:' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: '- ' || x), chr(10)), '') ELSE '' END) AS text_hash
FROM documents""",
)
def embedding_text(spark, sf):
    lines = F.when(F.col("doc_id") % 3 != 0, F.split("text", "\n"))
    fields = {"name": F.concat(F.lit("P"), F.col("doc_id").cast("string")), "language": F.col("lang"), "summary": F.col("text")}
    return _documents(spark, sf).select("doc_id", _hash(asm.labelled_text(fields, {"lines": lines})).alias("text_hash"))


@q.query("vector_text", "SELECT vec_id, CASE WHEN vec_id % 10 <> 0 THEN len(embedding) ELSE -1 END AS n, vec_id % 10 <> 0 AS same FROM embeddings")
def vector_text(spark, sf):
    """Vectors to text and back; of every tenth the text lacks the last number, which makes it no vector."""
    e = v.t(spark, sf, "embeddings")
    short = F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", F.lit(1), F.size("embedding") - 1)).otherwise(F.col("embedding"))
    back = asm.parse_vector(asm.vector_text(short), q.DIM)
    same = F.coalesce(back.cast("array<float>") == F.col("embedding").cast("array<float>"), F.lit(False))
    return e.select("vec_id", F.coalesce(F.size(back), F.lit(-1)).alias("n"), same.alias("same"))


def _sections(spark, sf):
    i = F.col("section_id")
    return q._tree(spark, sf).select("document_id", i.alias("id"), F.when(i % 6 != 0, 100 - i).alias("sort_order"))


_PLACED = f"""{q._HEADS_SQL}, placed AS (
 SELECT document_id, section_id AS id, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN section_id % 6 <> 0 THEN 100 - section_id ELSE 0 END, section_id) AS place FROM h)"""


@q.query("section_order", v.with_views("d_block", body=f"{_PLACED} SELECT * FROM placed"))
def section_order(spark, sf):
    return asm.in_reading_order(_sections(spark, sf)).select("document_id", "id", "place")


@q.query("section_preview", v.with_views("d_block", body=f"{_PLACED} SELECT * FROM placed WHERE place <= 10"))
def section_preview(spark, sf):
    return asm.preview(_sections(spark, sf)).select("document_id", "id", "place")


@q.query(
    "chunk_section_ids",
    v.with_views(
        "d_chunk",
        "d_block",
        body=f"{q._HEADS_SQL} SELECT c.id, coalesce(h.document_id * 100000 + h.pos, -1) AS section_id FROM d_chunk c LEFT JOIN h ON h.document_id = c.document_id AND h.section_id = c.chunk_index // 4 AND h.section_id % 7 <> 3",
    ),
)
def chunk_section_ids(spark, sf):
    """Chunks with the stored ids of their sections; every seventh section has none."""
    chunks = v.d_chunk(spark, sf, embeddings=False).select("id", "document_id", F.floor(F.col("chunk_index") / 4).alias("section_id"))
    stored = q._tree(spark, sf).filter("section_id % 7 <> 3").select("document_id", F.col("section_id").alias("temporary_id"), (F.col("document_id") * v.LINE_SPACE + F.col("pos")).alias("real_id"))
    return asm.real_ids(chunks, stored).select("id", F.coalesce("section_id", F.lit(-1)).alias("section_id"))


_STOCK = """n AS (SELECT document_id, count(*) AS n_embedded FROM d_chunk WHERE embedding IS NOT NULL GROUP BY 1)
SELECT d.tenant_id, d.id AS document_id, n_embedded FROM d_document d JOIN n ON n.document_id = d.id
WHERE EXISTS (SELECT 1 FROM d_block b WHERE b.document_id = d.id AND b.kind = 'heading')
 AND EXISTS (SELECT 1 FROM d_pattern_source s JOIN d_pattern p ON p.id = s.pattern_id WHERE s.document_id = d.id AND p.fingerprint IS NOT NULL AND p.tenant_id = d.tenant_id)
QUALIFY row_number() OVER (PARTITION BY d.tenant_id ORDER BY n_embedded DESC, d.id) <= 3"""


@q.query("best_stocked", v.with_views("d_document", "d_chunk", "d_block", "d_pattern", "d_pattern_source", body=_STOCK))
def best_stocked(spark, sf):
    return asm.best_stocked(v.d_document(spark, sf), v.d_chunk(spark, sf), q._tree(spark, sf), v.d_pattern_source(spark, sf), v.d_pattern(spark, sf), 3)


_SNAPSHOT = ("d_document", "d_chunk", "d_pattern", "d_pattern_source", "d_guard")


@q.query("table_snapshot", v.with_views(*_SNAPSHOT, "d_block", body="\nUNION ALL ".join([f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _SNAPSHOT] + ["SELECT 'section', count(*) FROM d_block WHERE kind = 'heading'"])))
def table_snapshot(spark, sf):
    return asm.table_counts(**{n: getattr(v, n)(spark, sf) for n in _SNAPSHOT}, section=q._tree(spark, sf))


@q.query("label_merge", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'quality' WHEN 3 THEN 'training' ELSE CASE WHEN contains(text, 'ing') THEN 'by_rule' ELSE 'other' END END AS label FROM documents")
def label_merge(spark, sf):
    k = F.col("doc_id") % 4
    model = F.when(k == 0, " Quality\n").when(k == 1, "no such label").when(k == 3, "TRAINING")
    rule = F.when(F.contains("text", F.lit("ing")), "by_rule").otherwise("other")
    return _documents(spark, sf).select("doc_id", asm.model_or_rule(model, rule, tuple(q.BID_RULES)).alias("label"))


_PATTERNS = f"""SELECT doc_id, 'SP' || lpad(doc_id::VARCHAR, greatest(3, length(doc_id::VARCHAR))::INT, '0') AS code, 'P' || doc_id AS name,
 CASE doc_id % 4 WHEN 0 THEN 'pattern_kind_4' WHEN 1 THEN 'pattern_kind_8' ELSE 'pattern_kind_0' END AS type,
 sha256({_STRIPPED.format("coalesce(text, '')")}) AS summary_hash, CASE WHEN doc_id % 2 = 0 THEN 'a|' || doc_id ELSE '' END AS structure
FROM documents WHERE doc_id % 9 <> 0"""


@q.query("pattern_extract", _PATTERNS)
def pattern_extract(spark, sf):
    """Patterns from a model's answers: codes are given before, answers that are no JSON are dropped."""
    i = F.col("doc_id")
    said = F.when(i % 4 == 0, "Pattern-Kind 4").when(i % 4 == 1, "eighth").when(i % 4 == 2, "unheard of")
    listed = F.to_json(F.array(F.lit(" a"), F.lit(" "), i.cast("string")))
    fields = F.to_json(F.struct(F.concat(F.lit(" P"), i.cast("string")).alias("name"), said.alias("type"), F.col("text").alias("summary")))
    whole = F.concat(F.left(fields, F.length(fields) - 1), F.lit(', "structure": '), F.when(i % 2 == 0, listed).otherwise('"no list"'), F.lit("}"))
    answer = F.when(i % 9 == 0, "sorry, no JSON").when(i % 9 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    rows = _documents(spark, sf).select("doc_id", s.code("SP", i).alias("code"), answer.alias("answer"))
    out = asm.pattern_records(rows, F.col("answer"), v.PATTERN_TYPES, {"eighth": "pattern_kind_8"}, "pattern_kind_0")
    return out.select("doc_id", "code", "name", "type", _hash(F.col("summary")).alias("summary_hash"), F.array_join("structure", "|").alias("structure"))


_CUT = "CASE WHEN length({0}) > {1} THEN left({0}, {1}) || '...' ELSE {0} END"


@q.query(
    "pattern_context",
    f"""SELECT doc_id, sha256('[' || doc_id || '] P' || doc_id || CASE WHEN doc_id % 3 > 1 THEN chr(10) || 'used: ' || doc_id % 3 ELSE '' END
 || CASE WHEN lang <> '' THEN chr(10) || 'language: ' || lang ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'structure: a / b' ELSE '' END
 || CASE WHEN text <> '' THEN chr(10) || 'text:' || chr(10) || {_CUT.format("text", 3000)} ELSE '' END) AS block_hash
FROM documents""",
)
def pattern_context(spark, sf):
    i = F.col("doc_id")
    structure = F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    block = asm.pattern_block(i, F.concat(F.lit("P"), i.cast("string")), i % 3, {"language": F.col("lang")}, structure, F.col("text"))
    return _documents(spark, sf).select("doc_id", _hash(block).alias("block_hash"))


@q.query(
    "section_context",
    v.with_views(
        "d_block",
        body=f"""{q._HEADS_SQL}, own AS (
 SELECT b.document_id, b.section_id, string_agg(text, chr(10) ORDER BY pos) AS content
 FROM (SELECT *, greatest(sum((kind = 'heading')::INT) OVER (PARTITION BY document_id ORDER BY pos) - 1, 0) AS section_id FROM d_block) b
 WHERE kind NOT IN ('heading', 'image') AND text <> '' GROUP BY 1, 2),
 line AS (
 SELECT h.document_id, h.section_id, repeat('  ', h.level - 1) AS indent, h.text AS title, {_STRIPPED.format("coalesce(content, '')")} AS content
 FROM h LEFT JOIN own USING (document_id, section_id))
SELECT document_id, section_id, sha256(indent || section_id || CASE WHEN title <> '' THEN ' ' || title ELSE '' END || ' (other)'
 || CASE WHEN content <> '' THEN chr(10) || indent || '  > ' || {_CUT.format("content", 600)} ELSE '' END) AS block_hash FROM line""",
    ),
)
def section_context(spark, sf):
    """Sections as a prompt shows them: head with number and type, and the start of their own text."""
    tree = q._tree(spark, sf).join(st.own_content(v.d_block(spark, sf)), ["document_id", "section_id"], "left")
    block = asm.section_block(F.col("level"), F.col("section_id").cast("string"), F.col("title"), F.lit("other"), F.col("content"))
    return tree.select("document_id", "section_id", _hash(block).alias("block_hash"))


@q.query("chunk_contract", v.with_views("d_chunk", body='SELECT id, document_id, chunk_index, document_type, document_id AS "documentId", chunk_index AS "chunkIndex", document_type AS "documentType" FROM d_chunk'))
def chunk_contract(spark, sf):
    return asm.both_spellings(v.d_chunk(spark, sf, embeddings=False).select("id", "document_id", "chunk_index", "document_type"))


_NESTED = """p AS (SELECT s.document_id, list({'id': p.id, 'type': p.type} ORDER BY p.id, p.type) AS l FROM d_pattern_source s JOIN d_pattern p ON p.id = s.pattern_id GROUP BY 1),
 r AS (SELECT document_id, list({'source': pattern_id, 'target': document_id} ORDER BY pattern_id) AS l FROM d_pattern_source WHERE pattern_id <> document_id GROUP BY 1)
SELECT d.id AS document_id, '{"document":' || to_json({'document_id': d.id, 'file_hash': d.file_hash}) || ',"patterns":' || coalesce(to_json(p.l)::VARCHAR, '[]') || ',"relations":' || coalesce(to_json(r.l)::VARCHAR, '[]') || '}' AS json
FROM d_document d LEFT JOIN p ON p.document_id = d.id LEFT JOIN r ON r.document_id = d.id"""


@q.query("nested_output", v.with_views("d_document", "d_pattern", "d_pattern_source", body=_NESTED))
def nested_output(spark, sf):
    """Documents as JSON with the patterns they are a source of and the patterns that name them besides their own."""
    documents = v.d_document(spark, sf).select(F.col("id").alias("document_id"), "file_hash")
    sources = v.d_pattern_source(spark, sf)
    patterns = sources.join(v.d_pattern(spark, sf).select(F.col("id").alias("pattern_id"), "type"), "pattern_id").select("document_id", F.col("pattern_id").alias("id"), "type")
    relations = sources.filter("pattern_id <> document_id").select("document_id", F.col("pattern_id").alias("source"), F.col("document_id").alias("target"))
    return asm.nested_json(documents, patterns, relations)


_ANALYSIS = f"""item AS ({q.ORACLE_SQL["coerce_json_records"]}),
 b AS (SELECT document_id, count(*) AS n_blocks, count(*) FILTER (kind = 'heading') AS n_sections, sum(length(text))::BIGINT AS n_chars FROM d_block GROUP BY 1),
 i AS (SELECT doc_id AS document_id, count(*) AS n_requirements, count(*) FILTER (doc_id % 2 = 0) AS n_scores, count(*) FILTER (doc_id % 3 = 0) AS n_risks, sum(score) FILTER (doc_id % 2 = 0) AS total_score FROM item GROUP BY 1)
SELECT b.*, coalesce(n_requirements, 0) AS n_requirements, coalesce(n_scores, 0) AS n_scores, coalesce(n_risks, 0) AS n_risks, coalesce(total_score, 0)::DOUBLE AS total_score
FROM b LEFT JOIN i USING (document_id)"""


@q.query("tender_analysis", v.with_views("d_block", body=_ANALYSIS))
def tender_analysis(spark, sf):
    """Items of three extractors counted for each document, with its blocks, sections and characters."""
    found = ex.records(q._answers(spark, sf), F.col("answer"), ["doc_id"]).withColumnRenamed("doc_id", "document_id")
    head = F.col("kind") == "heading"
    stats = v.d_block(spark, sf).groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.count_if(head).alias("n_sections"), F.sum(F.length("text")).alias("n_chars"))
    return asm.analysis_summary(found, found.filter("document_id % 2 = 0"), found.filter("document_id % 3 = 0"), stats)


@q.query(
    "job_finish",
    v.with_views(
        "d_guard",
        body=f"""{q._JOBS}, x AS (SELECT *, document_id % 2 = 0 AND owner_id = 'w1' AND state = 'RUNNING' AS mine, document_id % 4 = 0 AS bad FROM jobs)
SELECT document_id, CASE WHEN mine AND bad THEN 'FAILED' WHEN mine THEN 'COMPLETED' ELSE state END AS state, CASE WHEN mine AND bad THEN 1024 ELSE 0 END AS n_error FROM x""",
    ),
)
def job_finish(spark, sf):
    """Jobs after worker w1 said it was done with those of even documents; errors are cut."""
    jobs = q._jobs(spark, sf).withColumn("error_message", F.lit(None).cast("string"))
    said = jobs.filter("document_id % 2 = 0").select("tenant_id", "document_id", "index_version", F.lit("w1").alias("owner_id"), F.when(F.col("document_id") % 4 == 0, F.repeat(F.lit("e"), F.lit(2000))).alias("error"))
    return lc.finish_jobs(jobs, said).select("document_id", "state", F.coalesce(F.length("error_message"), F.lit(0)).alias("n_error"))


@q.query("list_text", "SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN doc_id % 2 = 0 THEN '1. ' ELSE '- ' END || x), chr(10))) AS text_hash FROM documents")
def list_text(spark, sf):
    return _documents(spark, sf).select("doc_id", _hash(ck.list_text(F.split("text", "\n"), F.col("doc_id") % 2 == 0)).alias("text_hash"))


@q.query("style_levels", v.with_views("d_lines", body="SELECT document_id, pos, CASE WHEN pos % 3 = 0 THEN 1 ELSE substr((pos % 12)::VARCHAR, 1, 1)::INT END AS level FROM d_lines"))
def style_levels(spark, sf):
    style = F.when(F.col("pos") % 3 == 0, "Title").otherwise(F.concat(F.lit("Heading "), (F.col("pos") % 12).cast("string")))
    return v.d_lines(spark, sf).select("document_id", "pos", st.style_level(style).alias("level"))


@q.query("box_order", v.with_views("d_lines", body="SELECT document_id, pos, row_number() OVER (PARTITION BY document_id ORDER BY round_even(pos * 70 % 230 / 20.0, 0), pos * 37 % 100, pos) AS place FROM d_lines"))
def box_order(spark, sf):
    """Recognised boxes in the order they are read: line bands, then from left to right."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy(*files.reading_order(F.col("pos") * 37 % 100, F.col("pos") * 70 % 230), "pos")
    return v.d_lines(spark, sf).select("document_id", "pos", F.row_number().over(order).alias("place"))


SCOPED = TenantContext(1, knowledge_base_id=1002)
SCOPED_TYPES = ["qualification", "project_case", "tender"]


@q.query("scoped_chunks", v.with_views("d_chunk", "d_guard", body=f"{q._VISIBLE} SELECT id, document_id FROM visible WHERE knowledge_base_id = 1002 AND document_type IN ({str(SCOPED_TYPES)[1:-1]})"))
def scoped_chunks(spark, sf):
    """What a request may see that names a knowledge base and document types."""
    return rt.visible_chunks(v.d_chunk(spark, sf, embeddings=False), v.d_guard(spark, sf), SCOPED, SCOPED_TYPES).select("id", "document_id")


@q.query("given_requirements", f"SELECT doc_id, text FROM ({q.ORACLE_SQL['coerce_json_records']}) WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 'given' FROM documents WHERE doc_id % 3 = 0")
def given_requirements(spark, sf):
    """Requirements that came with the request, else those found in the text."""
    given = _documents(spark, sf).filter("doc_id % 3 = 0").select("doc_id", F.lit("given").alias("text"))
    found = ex.records(q._answers(spark, sf), F.col("answer"), ["doc_id"]).select("doc_id", "text")
    return ev.given_or_extracted(given, found, "doc_id")


def _with_tables(spark, sf):
    """Blocks of which some paragraphs are tables of one column, a word for each row."""
    table = (F.col("kind") == "paragraph") & (F.col("pos") % 11 == 5)
    words = F.transform(F.split("text", " "), lambda w: F.array(w))
    return v.d_block(spark, sf).withColumn("rows", F.when(table, words)).withColumn("kind", F.when(table, "table").otherwise(F.col("kind")))


@q.query("document_pipeline")
def document_pipeline(spark, sf):
    """Blocks to sections to chunks in one go (compared with a plain fold in the tests)."""
    chunks = ck.document_chunks(st.assign_sections(_with_tables(spark, sf)))
    return chunks.select("document_id", "section_id", "chunk_index", "chunk_type", _hash(F.col("content")).alias("content_hash"))


_ROUTED = """m AS (SELECT event_id, event_type, CASE WHEN event_id % 50 <> 0 THEN user_id END AS document_id FROM events),
 good AS (SELECT * FROM m WHERE document_id IS NOT NULL)
SELECT 'parse' AS queue, document_id, event_id AS id, n FROM good JOIN (SELECT document_id, count(*) AS n FROM d_block GROUP BY 1) USING (document_id) WHERE event_type = 'view'
UNION ALL SELECT 'embedding', document_id, c.id, 8 FROM d_chunk c WHERE c.document_id IN (SELECT document_id FROM good WHERE event_type = 'click') AND c.document_id IN (SELECT document_id FROM d_guard WHERE lifecycle_status = 'ACTIVE')
UNION ALL SELECT 'analysis', document_id, event_id, 0 FROM good WHERE event_type = 'purchase'
UNION ALL SELECT '_rejected', coalesce(document_id, -1), event_id, 0 FROM m WHERE document_id IS NULL OR event_type NOT IN ('view', 'click', 'purchase')"""


@q.query("task_router_stream", v.with_views("d_block", "d_chunk", "d_guard", body=_ROUTED))
def task_router_stream(spark, sf):
    """Messages as a stream over three queues, in one go; what no queue takes is in _rejected."""
    base = shared_path(spark, "task-router")
    i, kind = F.col("event_id"), F.col("event_type")
    queue = F.when(kind == "view", "parse").when(kind == "click", "embedding").when(kind == "purchase", "analysis").otherwise(kind)
    payload = F.when(kind == "purchase", F.concat(F.lit('{"title": "'), i.cast("string"), F.lit('", "text": "bought"}'))).otherwise(i.cast("string"))
    v.t(spark, sf, "events").select(queue.alias("queue"), F.when(i % 50 != 0, F.col("user_id")).cast("bigint").alias("document_id"), payload.alias("payload"), i.alias("id")).write.parquet(f"{base}/in")
    messages = spark.readStream.schema(f"{tasks.MESSAGE}, id bigint").parquet(f"{base}/in")
    queues = {
        "parse": hd.parse_handler(v.d_block(spark, sf)),
        "embedding": hd.embedding_handler(v.d_chunk(spark, sf, embeddings=False), v.d_guard(spark, sf), 8),
        "analysis": hd.analysis_handler(),
    }
    tasks.run_queues(messages, queues, f"{base}/out", f"{base}/log").awaitTermination()
    read = lambda name: spark.read.parquet(f"{base}/out/{name}")
    row = lambda name, id_, n: read(name).select(F.lit(name).alias("queue"), F.coalesce("document_id", F.lit(-1)).alias("document_id"), id_.cast("bigint").alias("id"), n.cast("bigint").alias("n"))
    out = row("parse", F.col("payload"), F.col("n_blocks")).unionByName(row("embedding", F.col("id"), F.size("embedding")))
    return out.unionByName(row("analysis", F.col("title"), F.lit(0))).unionByName(row("_rejected", F.col("id"), F.lit(0)))
