"""One query per operator with its SQL; ``register`` puts both into the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.context import TenantContext
from docloom.functions import scalar as s
from docloom.operators import chunking as ck
from docloom.operators import doctypes as dt
from docloom.operators import evidence as ev
from docloom.operators import extraction as ex
from docloom.operators import governance as gv
from docloom.operators import lifecycle as lc
from docloom.operators import retrieval as rt
from docloom.operators import structure as st
from docloom.plans import views as v
from docloom.session import shared_path
from docloom.sources import files
from docloom.streaming.versions import version_stream

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


TENANT = TenantContext(1)
KEYWORD = "the"
DIM = 64


def _query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> F.Column:
    """The query: one stored vector, sent as a literal (64 numbers)."""
    row = v.t(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return F.array(*(F.lit(float(x)) for x in row[0]))


_VISIBLE = "visible AS (SELECT c.* FROM d_chunk c WHERE tenant_id = 1 AND EXISTS (SELECT 1 FROM d_guard g WHERE g.document_id = c.document_id AND lifecycle_status = 'ACTIVE'))"
_SIM = "round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt((SELECT list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) FROM embeddings WHERE vec_id = 0))), 6)"


def _visible(spark, sf):
    return rt.visible_chunks(v.d_chunk(spark, sf), v.d_guard(spark, sf), TENANT)


@query("vector_topk", v.with_views("d_chunk", "d_guard", body=f"{_VISIBLE} SELECT id, document_id, {_SIM} AS similarity FROM visible WHERE embedding IS NOT NULL ORDER BY similarity DESC, id LIMIT 10"))
def vector_topk(spark, sf):
    return rt.vector_search(_visible(spark, sf), _query_vector(spark, sf)).select("id", "document_id", "similarity")


_SIM_MANY = "round(list_inner_product(embedding::DOUBLE[], query::DOUBLE[]) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(query::DOUBLE[], query::DOUBLE[]))), 6)"


@query("vector_topk_all", v.with_views("d_chunk", "d_guard", body=f"{_VISIBLE}, asked AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0), scored AS (SELECT query_id, id, document_id, {_SIM_MANY} AS similarity FROM visible, asked WHERE embedding IS NOT NULL) SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10"))
def vector_topk_all(spark, sf):
    """Every stored vector whose id 50 divides as a query."""
    asked = v.t(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rt.vector_search_many(_visible(spark, sf), asked).select("query_id", "id", "document_id", "similarity")


@query("keyword_search", v.with_views("d_chunk", "d_guard", body=f"{_VISIBLE} SELECT id, document_id, content, 1.0::DOUBLE AS score FROM visible WHERE content ILIKE '%{KEYWORD}%' ORDER BY id LIMIT 10"))
def keyword_search(spark, sf):
    rows = rt.visible_chunks(v.d_chunk(spark, sf, embeddings=False), v.d_guard(spark, sf), TENANT)
    return rt.keyword_search(rows, KEYWORD).select("id", "document_id", "content", "score")


_HYBRID = f"""{_VISIBLE},
 vr AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) - 1 AS v_rank FROM (SELECT id, {_SIM} AS similarity FROM visible WHERE embedding IS NOT NULL ORDER BY similarity DESC, id LIMIT 60)),
 kr AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k_rank FROM (SELECT id FROM visible WHERE content ILIKE '%{KEYWORD}%' ORDER BY id LIMIT 60))
SELECT coalesce(vr.id, kr.id) AS id, similarity, round(coalesce(1.0::DOUBLE / (v_rank + 61), 0) + coalesce(1.0::DOUBLE / (k_rank + 61), 0), 9) AS score
FROM vr FULL JOIN kr ON vr.id = kr.id ORDER BY score DESC, v_rank NULLS LAST, k_rank LIMIT 10"""


@query("hybrid_rrf", v.with_views("d_chunk", "d_guard", body=_HYBRID))
def hybrid_rrf(spark, sf):
    return rt.hybrid_search(_visible(spark, sf), _query_vector(spark, sf), KEYWORD).select("id", "similarity", "score")


_TYPE_SQL = "CASE trim(document_type) WHEN 'tender_doc' THEN 'tender' ELSE trim(document_type) END"


@query("doc_type_normalize", v.with_views("d_document", body=f"SELECT {_TYPE_SQL} AS document_type, count(*) AS n, bool_or({_TYPE_SQL} = 'tender') AS excluded, bool_or({_TYPE_SQL} <> 'tender') AS eligible FROM d_document GROUP BY 1"))
def doc_type_normalize(spark, sf):
    d = v.d_document(spark, sf).select("document_type")
    kind = dt.normalised_type(F.col("document_type"))
    return d.groupBy(kind.alias("document_type")).agg(F.count("*").alias("n"), F.bool_or(dt.is_excluded(F.col("document_type"))).alias("excluded"), F.bool_or(dt.may_have_patterns(F.col("document_type"))).alias("eligible"))


@query("qa_scope_filter", v.with_views("d_document", body=f", asked AS (SELECT id, CASE id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [{_TYPE_SQL}, 'regulation'] ELSE [{_TYPE_SQL}] END AS a FROM d_document), kept AS (SELECT id, list_filter({v._list(dt.QA_TYPES)}, lambda x: list_contains(a, x)) AS k FROM asked) SELECT id, array_to_string(CASE WHEN len(k) = 0 THEN {v._list(dt.QA_TYPES)} ELSE k END, ',') AS scope FROM kept".lstrip(", ")))
def qa_scope_filter(spark, sf):
    d = v.d_document(spark, sf)
    asked = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).when(F.col("id") % 3 == 1, F.array("document_type", F.lit("regulation"))).otherwise(F.array("document_type"))
    return d.select("id", F.array_join(dt.qa_types(asked), ",").alias("scope"))


# Rule tables are the caller's data; these use words of the test texts.
INTENTS = [(0, "quality", ["thth", "qualit"], ["pattern_kind_3", "pattern_kind_6"]), (1, "schedule", ["ering", "keit"], ["pattern_kind_4", "pattern_kind_5"]), (2, "security", ["ouan", "ción"], ["pattern_kind_8", "pattern_kind_6"]), (3, "training", ["eaux", "heit"], ["pattern_kind_11"])]
TASK_WORDS = ["how", "und", "tion"]


def _intent_sql() -> str:
    hit = lambda words: "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"
    domains = ", ".join(f"CASE WHEN {hit(w)} THEN '{d}' END" for _, d, w, _ in INTENTS)
    types = ", ".join(f"CASE WHEN {hit(w)} THEN {v._list(p)} ELSE []::VARCHAR[] END" for _, _, w, p in INTENTS)
    return f"""WITH qs AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user'),
 h AS (SELECT conv_id, turn, q, list_filter([{domains}], lambda x: x IS NOT NULL) AS domains, flatten([{types}]) AS types FROM qs)
SELECT conv_id, turn, array_to_string(domains, ',') AS domains, array_to_string(list_filter(types, lambda x, i: list_position(types, x) = i), ',') AS pattern_types, CASE WHEN {hit(TASK_WORDS)} THEN 'solution_generation' ELSE 'qa' END AS task FROM h"""


@query("intent_rules", _intent_sql())
def intent_rules(spark, sf):
    rules = spark.createDataFrame(INTENTS, "rule_order int, domain string, keywords array<string>, pattern_types array<string>")
    qs = v.t(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    out = rt.classify_queries(qs, rules, TASK_WORDS)
    return out.select("conv_id", "turn", F.array_join("domains", ",").alias("domains"), F.array_join("pattern_types", ",").alias("pattern_types"), "task")


BID_RULES = {"qualification": ["thea", "keit"], "quality": ["ing", "ción"], "training": ["eau"]}
TENDER_RULES = {"score_criteria": ["tion"], "contract_requirement": ["er"]}


def _case(rules: dict) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(text, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in rules.items()) + " ELSE 'other' END"


def _titles(spark, sf):
    docs = v.d_document(spark, sf).select(F.col("id").alias("document_id"), "document_type")
    return v.d_block(spark, sf).filter("kind = 'heading'").join(docs, "document_id").select("document_id", "pos", "level", F.col("text").alias("title"), F.when(F.col("document_type") == "tender", "tender").otherwise("bid").alias("rule_set"))


def _rules(spark):
    return spark.createDataFrame(st.rule_rows("bid", BID_RULES) + st.rule_rows("tender", TENDER_RULES), st.RULE_SCHEMA)


@query("section_classify", v.with_views("d_document", "d_block", body=f"SELECT b.document_id, b.pos, CASE WHEN document_type = 'tender' THEN {_case(TENDER_RULES)} ELSE {_case(BID_RULES)} END AS section_type FROM (SELECT document_id, pos, text, kind FROM d_block) b JOIN (SELECT id, document_type FROM d_document) d ON d.id = b.document_id WHERE kind = 'heading'"))
def section_classify(spark, sf):
    return st.classify_titles(_titles(spark, sf), _rules(spark)).select("document_id", "pos", "section_type")


@query("fingerprint_sha1", "SELECT doc_id, sha1(CASE WHEN text <> '' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE source END) AS fingerprint, substr(sha1(source || chr(10) || text), 1, 16) AS cache_key FROM documents")
def fingerprint_sha1(spark, sf):
    return v.t(spark, sf, "documents").select("doc_id", s.fingerprint(F.col("text"), F.col("source")).alias("fingerprint"), s.cache_key(F.col("source"), F.col("text")).alias("cache_key"))


@query("input_hash_sha256", v.with_views("d_document", body="SELECT id, sha256('file_hash=' || file_hash || chr(10) || 'document_type=' || document_type || chr(10) || 'knowledge_base_id=' || knowledge_base_id || chr(10) || 'parser=' || chr(10) || 'chunk_max_chars=1200' || chr(10) || 'extra.a=1' || chr(10) || 'extra.b=' || tenant_id) AS input_hash FROM d_document"))
def input_hash_sha256(spark, sf):
    fields = {"file_hash": F.col("file_hash"), "document_type": F.col("document_type"), "knowledge_base_id": F.col("knowledge_base_id"), "parser": F.lit(None), "chunk_max_chars": F.lit(ck.MAX_CHARS)}
    return v.d_document(spark, sf).select("id", s.input_hash(fields, {"b": F.col("tenant_id"), "a": F.lit(1)}).alias("input_hash"))


@query("hash_embedding", "WITH r AS (SELECT doc_id, [(('0x' || substr(md5(text || ':' || i), 1, 2))::INT - 128) / 128.0::DOUBLE for i in range(16)] AS e FROM documents) SELECT doc_id, round(e[1] / sqrt(list_inner_product(e, e)), 9) AS x0, round(e[16] / sqrt(list_inner_product(e, e)), 9) AS x15 FROM r")
def hash_embedding(spark, sf):
    e = s.hash_embedding(F.col("text"), 16)
    return v.t(spark, sf, "documents").select("doc_id", e.alias("e")).select("doc_id", F.round(F.get("e", F.lit(0)), 9).alias("x0"), F.round(F.get("e", F.lit(15)), 9).alias("x15"))


@query("hash_embedding_whole", "WITH r AS (SELECT doc_id, [(('0x' || substr(md5(text || ':' || i), 1, 2))::INT - 128) / 128.0::DOUBLE for i in range(16)] AS e FROM documents) SELECT doc_id, " + ", ".join(f"round(e[{i + 1}] / sqrt(list_inner_product(e, e)), 9) AS x{i}" for i in range(16)) + " FROM r")
def hash_embedding_whole(spark, sf):
    """All dimensions, over the whole text."""
    rows = v.t(spark, sf, "documents").select("doc_id", s.hash_embedding(F.col("text"), 16).alias("e"))
    return rows.select("doc_id", *(F.round(F.get("e", F.lit(i)), 9).alias(f"x{i}") for i in range(16)))


UNITS, SUFFIXES = ["th", "st", "er", "chars", "%"], ["tion", "ment", "keit"]
DATES = [(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>"), (r"[0-9]{4}-[0-9]{2}", "<month>"), (r"[0-9]{4}/", "<year>/")]


@query("redact_facts", r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' 2024-05-17 2023-11 12.5% ' || n_chars || 'chars', '[0-9]{4}-[0-9]{2}-[0-9]{2}', '<date>', 'g'), '[0-9]{4}-[0-9]{2}', '<month>', 'g'), '[0-9]{4}/', '<year>/', 'g'), '[0-9]+(?:\.[0-9]+)?(th|st|er|chars|%)', '<n>\1', 'g'), '[A-Za-z]{2,12}(?:tion|ment|keit)', '<name>', 'g')) AS redacted FROM documents")
def redact_facts(spark, sf):
    text = F.concat(F.col("text"), F.lit(" 2024-05-17 2023-11 12.5% "), F.col("n_chars").cast("string"), F.lit("chars"))
    return v.t(spark, sf, "documents").select("doc_id", F.sha2(s.redact(text, DATES, UNITS, "<n>", "[A-Za-z]", SUFFIXES, "<name>"), 256).alias("redacted"))


def _answers(spark, sf):
    i = F.col("doc_id")
    body = F.concat(F.lit('[{"title": " Item '), i.cast("string"), F.lit('", "text": "need '), i.cast("string"), F.lit('", "page": "p. '), (i % 90).cast("string"), F.lit('", "section": " s'), (i % 7).cast("string"), F.lit(' ", "score": "'), (i % 11).cast("string"), F.lit('.5"}, {"title": "empty", "text": "", "page": "x"}]'))
    answer = F.when(i % 10 == 0, F.lit("no json")).when(i % 10 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 10 == 2, F.concat(F.lit('{"title": "one", "text": "single", "page": "'), i.cast("string"), F.lit('"}'))).otherwise(body)
    return v.t(spark, sf, "documents").select("doc_id", answer.alias("answer"))


@query("coerce_json_records", "SELECT doc_id, 0 AS item_no, CASE WHEN doc_id % 10 = 2 THEN 'one' ELSE 'Item ' || doc_id END AS title, CASE WHEN doc_id % 10 = 2 THEN 'single' ELSE 'need ' || doc_id END AS text, CASE WHEN doc_id % 10 = 2 THEN doc_id ELSE doc_id % 90 END AS page, CASE WHEN doc_id % 10 <> 2 THEN 's' || (doc_id % 7) END AS section, CASE WHEN doc_id % 10 <> 2 THEN doc_id % 11 + 0.5::DOUBLE END AS score FROM documents WHERE doc_id % 10 <> 0")
def coerce_json_records(spark, sf):
    return ex.records(_answers(spark, sf), F.col("answer"), ["doc_id"])


HEADS = [(r"^[A-Z][a-z]+ [a-z]+ of ", 1), (r"^(?:The|Der|La) ", 2)]


@query("heading_detect", v.with_views("d_lines", body=r"SELECT coalesce(level, -1) AS level, count(*) AS n, count(DISTINCT section_no) AS n_numbers FROM (SELECT CASE WHEN regexp_matches(t, '^[A-Z][a-z]+ [a-z]+ of ') THEN 1 WHEN regexp_matches(t, '^(?:The|Der|La) ') THEN 2 WHEN n <> '' THEN least(length(n) - length(replace(n, '.', '')) + 1, 4) END::INT AS level, nullif(regexp_extract(t, '^([0-9]+(?:\.[0-9]+)*)(?:[\s.]|$)', 1), '') AS section_no FROM (SELECT t, regexp_extract(t, '^([0-9]+(?:\.[0-9]+){0,2})\s+\S', 1) AS n FROM (SELECT regexp_replace(CASE WHEN pos % 5 = 0 THEN (pos % 7) || '.' || (pos % 3) || ' ' || text ELSE text END, '^\s+|\s+$', '', 'g') AS t FROM d_lines))) GROUP BY 1"))
def heading_detect(spark, sf):
    none = F.lit(-1)
    text = F.when(F.col("pos") % 5 == 0, F.concat((F.col("pos") % 7).cast("string"), F.lit("."), (F.col("pos") % 3).cast("string"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    rows = v.d_lines(spark, sf).select(F.coalesce(st.heading_level(text, HEADS), none).alias("level"), st.section_number(text).alias("section_no"))
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("section_no").alias("n_numbers"))


_HEADS_SQL = "h AS (SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1)::INT AS section_id FROM d_block WHERE kind = 'heading'), tree AS (SELECT a.document_id, a.pos, a.section_id, a.level, a.text AS title, a.page, (SELECT max(b.section_id) FROM h b WHERE b.document_id = a.document_id AND b.pos < a.pos AND b.level < a.level) AS parent_id, (SELECT min(b.pos) FROM h b WHERE b.document_id = a.document_id AND b.pos > a.pos AND b.level <= a.level) AS end_pos FROM h a)"


def _tree(spark, sf):
    return st.section_tree(v.d_block(spark, sf), orphan_root=False)


@query("section_tree_parent", v.with_views("d_block", body=f"{_HEADS_SQL} SELECT document_id, section_id, coalesce(parent_id, -1) AS parent_id, level, title, coalesce(end_pos, -1) AS end_pos FROM tree"))
def section_tree_parent(spark, sf):
    return _tree(spark, sf).select("document_id", "section_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "level", "title", F.coalesce("end_pos", F.lit(-1)).alias("end_pos"))


@query("section_page_range", v.with_views("d_block", body=f"{_HEADS_SQL} SELECT t.document_id, t.section_id, t.page AS page_start, greatest(t.page, coalesce((SELECT max(c.page) FROM tree c WHERE c.document_id = t.document_id AND c.parent_id = t.section_id), t.page)) AS page_end FROM tree t"))
def section_page_range(spark, sf):
    return st.page_ranges(_tree(spark, sf).withColumn("page", (F.floor(F.col("pos") / 10) + 1).cast("int")))


_FULL_SQL = f"""{_HEADS_SQL},
 filled AS (SELECT t.document_id, t.section_id, t.pos, t.end_pos, t.level, t.title, count(b.pos) AS n FROM tree t LEFT JOIN d_block b ON b.document_id = t.document_id AND b.pos > t.pos AND (t.end_pos IS NULL OR b.pos < t.end_pos) AND b.kind <> 'heading' AND b.text <> '' GROUP BY ALL),
 body AS (SELECT f.document_id, f.section_id, f.level, f.title, string_agg(b.text, chr(10) ORDER BY b.pos) AS full_content FROM filled f LEFT JOIN d_block b ON b.document_id = f.document_id AND b.pos > f.pos AND (f.end_pos IS NULL OR b.pos < f.end_pos) AND b.text <> '' AND (b.kind <> 'heading' OR EXISTS (SELECT 1 FROM filled g WHERE g.document_id = b.document_id AND g.pos = b.pos AND g.n > 0)) GROUP BY ALL)"""


@query("section_full_content", v.with_views("d_block", body=f"{_FULL_SQL} SELECT document_id, section_id, sha256(coalesce(full_content, '')) AS content_hash, length(coalesce(full_content, '')) AS n_chars FROM body"))
def section_full_content(spark, sf):
    full = st.full_content(v.d_block(spark, sf), _tree(spark, sf))
    return full.select("document_id", "section_id", F.sha2("full_content", 256).alias("content_hash"), F.length("full_content").cast("long").alias("n_chars"))


@query("candidate_sections", v.with_views("d_block", body=f"{_FULL_SQL} SELECT document_id, section_id, level FROM body WHERE level BETWEEN 1 AND 3 AND length(coalesce(full_content, '')) >= 300 AND NOT contains(title, 'ing')"))
def candidate_sections(spark, sf):
    tree = _tree(spark, sf)
    full = st.full_content(v.d_block(spark, sf), tree)
    rows = tree.join(full, ["document_id", "section_id"]).withColumn("section_type", F.lit("other"))
    return st.candidate_sections(rows, ["commercial"], ["ing"]).select("document_id", "section_id", "level")


@query("chunk_greedy_pack")
def chunk_greedy_pack(spark, sf):
    """Compared with a plain fold in the tests."""
    pieces = ck.semantic_split(F.col("text"), paragraph=r"\n", joiner="\n")
    return v.t(spark, sf, "documents").select("doc_id", F.posexplode(pieces).alias("chunk_index", "content")).select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_hash"))


@query("chunk_hard_cut", "SELECT doc_id, (unnest(range(0, CASE WHEN length(text) <= 1200 THEN 1 ELSE (length(text) - 1) // 1050 + 1 END)))::INT AS part, sha256(unnest([CASE WHEN length(text) <= 1200 THEN text ELSE substring(text, i * 1050 + 1, 1200) END for i in range(0, CASE WHEN length(text) <= 1200 THEN 1 ELSE (length(text) - 1) // 1050 + 1 END)])) AS piece_hash FROM documents")
def chunk_hard_cut(spark, sf):
    return v.t(spark, sf, "documents").select("doc_id", F.posexplode(ck.hard_cut(F.col("text"), ck.MAX_CHARS, ck.OVERLAP)).alias("part", "piece")).select("doc_id", "part", F.sha2("piece", 256).alias("piece_hash"))


@query("chunk_overlap", v.with_views("d_lines", body="SELECT document_id, pos AS part, sha256(coalesce(right(lag(text) OVER (PARTITION BY document_id ORDER BY pos), 150), '') || text) AS piece_hash FROM d_lines"))
def chunk_overlap(spark, sf):
    pieces = ck.with_overlap(F.split("text", "\n"), ck.OVERLAP)
    return v.t(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(pieces).alias("part", "piece")).select("document_id", "part", F.sha2("piece", 256).alias("piece_hash"))


@query("table_row_pack")
def table_row_pack(spark, sf):
    """Documents as tables of (line, words) rows; compared with a plain fold in the tests."""
    rows = F.transform(F.split("text", "\n"), lambda x: F.split(x, " "))
    return v.t(spark, sf, "documents").select("doc_id", F.posexplode(ck.table_chunks(rows, 400)).alias("part", "content")).select("doc_id", "part", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_hash"))


@query("page_marked_text", v.with_views("d_block", body="SELECT document_id, sha256(string_agg(CASE WHEN page IS DISTINCT FROM prev THEN '[page ' || page || ']' || chr(10) ELSE '' END || text, chr(10) ORDER BY pos)) AS text_hash FROM (SELECT *, lag(page) OVER (PARTITION BY document_id ORDER BY pos) AS prev FROM d_block) GROUP BY 1"))
def page_marked_text(spark, sf):
    return ck.page_marked(v.d_block(spark, sf)).select("document_id", F.sha2("text", 256).alias("text_hash"))


_ALLOWED = "allowed AS (SELECT p.* FROM d_pattern p WHERE tenant_id = 1 AND EXISTS (SELECT 1 FROM d_pattern_source x JOIN d_document d ON d.id = x.document_id WHERE x.pattern_id = p.id AND d.document_type IN ('regulation', 'project_case', 'qualification')) AND EXISTS (SELECT 1 FROM d_pattern_source x JOIN d_guard g USING (document_id) WHERE x.pattern_id = p.id AND g.lifecycle_status = 'ACTIVE'))"
_SCOPE = ["regulation", "project_case", "qualification"]


def _patterns(spark, sf):
    sources = v.d_pattern_source(spark, sf)
    found = rt.allowed_patterns(TENANT.scope(v.d_pattern(spark, sf)), sources, v.d_document(spark, sf).select("id", "document_type"), _SCOPE)
    return rt.live_patterns(found, sources, v.d_guard(spark, sf)), sources


_PV = ("d_pattern", "d_pattern_source", "d_document", "d_guard")


@query("pattern_topk_scoped", v.with_views(*_PV, body=f"{_ALLOWED} SELECT id, type, round({_SIM}, 4) AS score FROM allowed WHERE status = 'active' AND type IN ('pattern_kind_4', 'pattern_kind_8', 'pattern_kind_11') AND embedding IS NOT NULL ORDER BY {_SIM} DESC, id LIMIT 5"))
def pattern_topk_scoped(spark, sf):
    rows, _ = _patterns(spark, sf)
    return rt.pattern_search(rows, _query_vector(spark, sf), ["pattern_kind_4", "pattern_kind_8", "pattern_kind_11"]).select("id", "type", "score")


@query("pattern_type_fallback", v.with_views(*_PV, body=f"{_ALLOWED} SELECT id, type, round({_SIM}, 4) AS score FROM allowed WHERE status = 'active' AND embedding IS NOT NULL ORDER BY {_SIM} DESC, id LIMIT 5"))
def pattern_type_fallback(spark, sf):
    rows, _ = _patterns(spark, sf)
    return rt.search_with_fallback(rows, _query_vector(spark, sf), ["no_such_type"]).select("id", "type", "score")


@query("pattern_source_enrich", v.with_views("d_pattern", "d_pattern_source", body="SELECT p.id, array_to_string(list_sort(list_distinct(list(document_id))), ',') AS sources FROM d_pattern p LEFT JOIN d_pattern_source x ON x.pattern_id = p.id GROUP BY 1"))
def pattern_source_enrich(spark, sf):
    p = v.d_pattern(spark, sf).select("id")
    return rt.pattern_sources(p, v.d_pattern_source(spark, sf)).select("id", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query(
    "pattern_dedupe_sources",
    v.with_views(
        "d_pattern",
        "d_pattern_source",
        body="""mine AS (SELECT * FROM d_pattern WHERE tenant_id = 1),
 f AS (SELECT fingerprint, min(id) AS id, count(*) AS duplicate_count FROM mine GROUP BY 1)
SELECT DISTINCT f.id, f.duplicate_count, x.document_id FROM f JOIN mine m USING (fingerprint) JOIN d_pattern_source x ON x.pattern_id = m.id""",
    ),
)
def pattern_dedupe_sources(spark, sf):
    """The first pattern of each fingerprint with how many it stands for, a row for each of their documents."""
    mine = TENANT.scope(v.d_pattern(spark, sf)).drop("embedding")
    first = mine.groupBy("fingerprint").agg(F.min("id").alias("id"), F.count("*").alias("duplicate_count"))
    return rt.fingerprint_sources(mine, v.d_pattern_source(spark, sf)).join(first, "fingerprint").select("id", "duplicate_count", "document_id")


@query("pattern_source_rows", v.with_views("d_pattern", "d_pattern_source", body="SELECT DISTINCT p.fingerprint, x.document_id FROM d_pattern p JOIN d_pattern_source x ON x.pattern_id = p.id WHERE p.tenant_id = 1"))
def pattern_source_rows(spark, sf):
    return rt.fingerprint_sources(TENANT.scope(v.d_pattern(spark, sf)).drop("embedding"), v.d_pattern_source(spark, sf))


_EXPAND = f"""{_HEADS_SQL}, allowed AS (SELECT id FROM d_document WHERE tenant_id = 1), rows AS (SELECT * FROM tree WHERE document_id IN (SELECT id FROM allowed)),
 hits AS (SELECT document_id, section_id FROM rows WHERE section_id % 5 = 1), up AS (SELECT DISTINCT r.document_id, r.parent_id FROM rows r JOIN hits USING (document_id, section_id) WHERE coalesce(r.parent_id, 0) <> 0)
SELECT document_id, section_id AS id, coalesce(parent_id, -1) AS parent_id FROM rows WHERE (document_id, section_id) IN (SELECT document_id, section_id FROM hits) OR (document_id, section_id) IN (SELECT document_id, parent_id FROM up) OR (document_id, parent_id) IN (SELECT document_id, parent_id FROM up)"""


@query("section_expand", v.with_views("d_block", "d_document", body=_EXPAND))
def section_expand(spark, sf):
    rows = _tree(spark, sf).select("document_id", F.col("section_id").alias("id"), "parent_id")
    allowed = TENANT.trusted_documents(v.d_document(spark, sf).select("id", "tenant_id"))
    hits = TENANT.scope_by_document(rows, v.d_document(spark, sf).select("id", "tenant_id")).filter("id % 5 = 1").select("document_id", "id")
    return rt.expand_sections(rows, hits, allowed).select("document_id", "id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


@query("orphan_audit", v.with_views("d_chunk", "d_document", "d_guard", "d_pattern_source", body="SELECT 'chunk' AS name, count(*) AS violations FROM d_chunk c WHERE NOT EXISTS (SELECT 1 FROM d_document d WHERE d.id = c.document_id) UNION ALL SELECT 'guard', count(*) FROM d_guard g WHERE NOT EXISTS (SELECT 1 FROM d_document d WHERE d.id = g.document_id) UNION ALL SELECT 'source', count(*) FROM d_pattern_source s WHERE NOT EXISTS (SELECT 1 FROM d_document d WHERE d.id = s.document_id) UNION ALL SELECT 'unguarded', count(*) FROM d_document d WHERE NOT EXISTS (SELECT 1 FROM d_guard g WHERE g.document_id = d.id) UNION ALL SELECT 'lineitem', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)"))
def orphan_audit(spark, sf):
    docs = v.d_document(spark, sf).select("id")
    return gv.audit(
        chunk=gv.orphans(v.d_chunk(spark, sf, embeddings=False), "document_id", docs), guard=gv.orphans(v.d_guard(spark, sf), "document_id", docs), source=gv.orphans(v.d_pattern_source(spark, sf), "document_id", docs),
        unguarded=gv.orphans(docs, "id", v.d_guard(spark, sf), "document_id"), lineitem=gv.orphans(v.t(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey", v.t(spark, sf, "orders"), "o_orderkey"),
    )


@query("tenant_mismatch_audit", v.with_views("d_chunk", "d_document", body="SELECT 'tenant' AS name, count(*) AS violations FROM d_chunk c JOIN d_document d ON d.id = c.document_id WHERE c.tenant_id IS DISTINCT FROM d.tenant_id UNION ALL SELECT 'knowledge_base', count(*) FROM d_chunk c JOIN d_document d ON d.id = c.document_id WHERE c.knowledge_base_id IS DISTINCT FROM d.knowledge_base_id"))
def tenant_mismatch_audit(spark, sf):
    docs, chunks = v.d_document(spark, sf).drop("text", "file_hash"), v.d_chunk(spark, sf, embeddings=False)
    return gv.audit(tenant=gv.mismatches(chunks, "document_id", docs, "tenant_id"), knowledge_base=gv.mismatches(chunks, "document_id", docs, "knowledge_base_id"))


@query("multi_tenant_docs", v.with_views("d_request", body="SELECT document_id, count(DISTINCT tenant_id) AS n_values FROM d_request GROUP BY 1 HAVING count(DISTINCT tenant_id) > 1"))
def multi_tenant_docs(spark, sf):
    return gv.several_values(v.d_request(spark, sf), "document_id", "tenant_id")


@query("version_conflicts", v.with_views("d_request", body="SELECT document_id, index_version, count(DISTINCT input_hash) AS n_hashes, count(*) AS n_rows FROM d_request GROUP BY 1, 2 HAVING count(DISTINCT input_hash) > 1"))
def version_conflicts(spark, sf):
    return v.d_request(spark, sf).groupBy("document_id", "index_version").agg(F.countDistinct("input_hash").alias("n_hashes"), F.count("*").alias("n_rows")).filter("n_hashes > 1")


@query("trusted_backfill", v.with_views("d_chunk", "d_document", body="SELECT c.id, coalesce(c.tenant_id, d.tenant_id, -1) AS tenant_id FROM d_chunk c LEFT JOIN d_document d ON d.id = c.document_id"))
def trusted_backfill(spark, sf):
    """Chunks without a tenant get their document's; all others keep theirs."""
    return trusted_backfill_all(spark, sf)


@query("trusted_backfill_all", v.with_views("d_chunk", "d_document", body="SELECT c.id, coalesce(c.tenant_id, d.tenant_id, -1) AS tenant_id FROM d_chunk c LEFT JOIN d_document d ON d.id = c.document_id"))
def trusted_backfill_all(spark, sf):
    """All chunks, also those whose tenant was given and stays."""
    chunks = v.d_chunk(spark, sf, embeddings=False)
    return gv.backfill(chunks, "document_id", v.d_document(spark, sf).select("id", "tenant_id"), "tenant_id").select("id", F.coalesce("tenant_id", F.lit(-1)).alias("tenant_id"))


@query("tender_only_division", v.with_views("d_pattern_source", "d_document", body=f"SELECT pattern_id, CASE WHEN bool_and({_TYPE_SQL} = 'tender') THEN 'tender_only' ELSE 'mixed' END AS kind FROM d_pattern_source s JOIN d_document d ON d.id = s.document_id GROUP BY 1 HAVING bool_or({_TYPE_SQL} = 'tender')"))
def tender_only_division(spark, sf):
    return gv.tender_only_patterns(v.d_pattern_source(spark, sf), v.d_document(spark, sf).select("id", "document_type"))


@query("quarantine_patterns", v.with_views("d_pattern", "d_pattern_source", "d_document", body=f"bad AS (SELECT pattern_id FROM d_pattern_source s JOIN d_document d ON d.id = s.document_id GROUP BY 1 HAVING bool_and({_TYPE_SQL} = 'tender')) SELECT id, CASE WHEN id IN (SELECT pattern_id FROM bad) THEN 'quarantined' ELSE status END AS status FROM d_pattern"))
def quarantine_patterns(spark, sf):
    return gv.quarantine(v.d_pattern(spark, sf).select("id", "status"), v.d_pattern_source(spark, sf), v.d_document(spark, sf).select("id", "document_type"))


@query("lifecycle_census", v.with_views("d_document", "d_guard", body="SELECT coalesce(lifecycle_status, 'NULL') AS label, count(*) AS n FROM d_document d LEFT JOIN d_guard g ON g.document_id = d.id GROUP BY 1"))
def lifecycle_census(spark, sf):
    return gv.counts_by(v.d_document(spark, sf).select("id").join(v.d_guard(spark, sf), F.col("id") == F.col("document_id"), "left"), "lifecycle_status")


@query("chunk_type_census", v.with_views("d_chunk", body="SELECT coalesce(tenant_id::VARCHAR, 'NULL') AS label, count(*) AS n FROM d_chunk GROUP BY 1"))
def chunk_type_census(spark, sf):
    return gv.counts_by(v.d_chunk(spark, sf, embeddings=False), "tenant_id")


_DECIDE = "CASE WHEN g.document_id IS NULL THEN 'APPLY' WHEN g.tenant_id <> r.tenant_id THEN 'REJECT_TENANT_MISMATCH' WHEN lifecycle_status = 'DELETED' THEN 'REJECT_DELETED' WHEN lifecycle_status <> 'ACTIVE' THEN 'REJECT_QUARANTINED' WHEN current_index_version IS NULL THEN 'APPLY' WHEN index_version < current_index_version THEN 'REJECT_STALE' WHEN index_version = current_index_version AND index_input_hash IS NOT DISTINCT FROM input_hash THEN 'IDEMPOTENT' WHEN index_version = current_index_version THEN 'REJECT_VERSION_MISMATCH' ELSE 'APPLY' END"


@query("guard_decide", v.with_views("d_request", "d_guard", body=f"SELECT request_id, {_DECIDE} AS decision FROM d_request r LEFT JOIN d_guard g USING (document_id)"))
def guard_decide(spark, sf):
    return lc.decisions(v.d_request(spark, sf), v.d_guard(spark, sf)).select("request_id", "decision")


@query("guard_merge")
def guard_merge(spark, sf):
    """The state after all requests in order; compared with a plain fold in the tests."""
    return lc.apply_in_order(v.d_request(spark, sf))


@query("tombstone_purge", v.with_views("d_document", "d_guard", "d_pattern", "d_pattern_source", body="gone AS (SELECT id FROM d_document WHERE id % 10 = 4), l AS (SELECT * FROM d_pattern_source WHERE document_id NOT IN (SELECT id FROM gone)) SELECT 'patterns' AS name, count(*) AS n FROM d_pattern WHERE id IN (SELECT pattern_id FROM l) UNION ALL SELECT 'sources', count(*) FROM l UNION ALL SELECT 'first_time', count(*) FROM d_guard WHERE document_id IN (SELECT id FROM gone) AND lifecycle_status <> 'DELETED' UNION ALL SELECT 'deleted', count(*) FROM d_guard WHERE document_id IN (SELECT id FROM gone) OR lifecycle_status = 'DELETED'"))
def tombstone_purge(spark, sf):
    gone = v.d_document(spark, sf).filter("id % 10 = 4").select(F.col("id").alias("document_id"), "tenant_id")
    patterns, sources = lc.purge(v.d_pattern(spark, sf).select("id"), v.d_pattern_source(spark, sf), gone)
    guard = lc.tombstone(v.d_guard(spark, sf), gone)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return n(patterns, "patterns").unionByName(n(sources, "sources")).unionByName(n(guard.filter("first_time"), "first_time")).unionByName(n(guard.filter("lifecycle_status = 'DELETED'"), "deleted"))


@query("replace_index", v.with_views("d_chunk", body="staged AS (SELECT id + 7 AS id, document_id, chunk_index FROM d_chunk WHERE document_id % 20 = 3) SELECT id, document_id, chunk_index FROM d_chunk WHERE document_id NOT IN (SELECT document_id FROM staged) UNION ALL SELECT * FROM staged"))
def replace_index(spark, sf):
    current = v.d_chunk(spark, sf, embeddings=False).select("id", "document_id", "chunk_index")
    return lc.replace_rows(current, current.filter("document_id % 20 = 3").withColumn("id", F.col("id") + 7))


@query("document_upsert", v.with_views("d_document", body="n AS (SELECT id + 5 AS id, CASE WHEN id % 2 = 0 THEN document_type END AS document_type, tenant_id FROM d_document WHERE id % 6 = 0) SELECT coalesce(n.id, d.id) AS id, coalesce(n.document_type, d.document_type) AS document_type, coalesce(d.tenant_id, n.tenant_id, -1) AS tenant_id FROM (SELECT id, document_type, CASE WHEN id % 4 <> 1 THEN tenant_id END AS tenant_id FROM d_document) d FULL JOIN n ON n.id = d.id"))
def document_upsert(spark, sf):
    d = v.d_document(spark, sf).select("id", "document_type", "tenant_id")
    changes = d.filter("id % 6 = 0").select((F.col("id") + 5).alias("id"), F.when(F.col("id") % 2 == 0, F.col("document_type")).alias("document_type"), "tenant_id")
    return lc.upsert(d.withColumn("tenant_id", F.when(F.col("id") % 4 != 1, F.col("tenant_id"))), changes, "id", keep=("document_type",), adopt=("tenant_id",)).withColumn("tenant_id", F.coalesce("tenant_id", F.lit(-1)))


_JOBS = "jobs AS (SELECT document_id, tenant_id, current_index_version AS index_version, ['PENDING', 'RUNNING', 'COMPLETED', 'FAILED', 'OBSOLETE'][document_id % 5 + 1] AS state, 'w' || (document_id % 3) AS owner_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(document_id % 2000) AS expires_at FROM d_guard WHERE current_index_version IS NOT NULL)"


def _jobs(spark, sf):
    i = F.col("document_id")
    return v.d_guard(spark, sf).filter("current_index_version IS NOT NULL").select("document_id", "tenant_id", F.col("current_index_version").alias("index_version"), F.get(F.array(*map(F.lit, lc.JOB_STATES)), (i % 5).cast("int")).alias("state"), F.concat(F.lit("w"), (i % 3).cast("string")).alias("owner_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=(i % 2000).cast("decimal(18,6)"))).alias("expires_at"))


@query("job_claim", v.with_views("d_guard", "d_document", body=f"{_JOBS}, c AS (SELECT id AS document_id, tenant_id, id % 5 + 1 AS index_version, 'w1' AS owner_id FROM d_document), x AS (SELECT c.*, CASE WHEN j.state IS NULL THEN 'NEW' WHEN j.state = 'COMPLETED' THEN 'COMPLETED' WHEN j.state = 'RUNNING' AND j.owner_id <> c.owner_id AND j.expires_at > TIMESTAMP '2024-01-01 00:10:00' THEN 'HELD' ELSE 'TAKEN_OVER' END AS verdict FROM c LEFT JOIN jobs j USING (tenant_id, document_id, index_version)) SELECT document_id, index_version, verdict, verdict IN ('NEW', 'TAKEN_OVER') AS claimed FROM x"))
def job_claim(spark, sf):
    d = v.d_document(spark, sf).select(F.col("id").alias("document_id"), "tenant_id", (F.col("id") % 5 + 1).alias("index_version"), F.lit("2024-01-01 00:10:00").cast("timestamp").alias("now"))
    claims = d.withColumn("owner_id", F.lit("w1")).unionByName(d.withColumn("owner_id", F.lit("w2")))
    return lc.claim_jobs(claims, _jobs(spark, sf)).select("document_id", "index_version", "verdict", "claimed")


@query("job_current", v.with_views("d_guard", body=f"{_JOBS} SELECT document_id, index_version, owner_id FROM jobs j WHERE state = 'RUNNING' AND EXISTS (SELECT 1 FROM d_guard g WHERE g.document_id = j.document_id AND g.tenant_id = j.tenant_id AND g.current_index_version = j.index_version AND lifecycle_status = 'ACTIVE')"))
def job_current(spark, sf):
    return lc.current_jobs(_jobs(spark, sf), v.d_guard(spark, sf)).select("document_id", "index_version", "owner_id")


@query("job_obsolete", v.with_views("d_guard", body=f"{_JOBS} SELECT j.state AS was, CASE WHEN (j.index_version - 1 < g.current_index_version AND j.state NOT IN ('COMPLETED', 'OBSOLETE')) OR (g.lifecycle_status = 'DELETED' AND j.state IN ('PENDING', 'RUNNING')) THEN 'OBSOLETE' ELSE j.state END AS state, count(*) AS n FROM jobs j LEFT JOIN d_guard g USING (document_id) GROUP BY 1, 2"))
def job_obsolete(spark, sf):
    jobs = _jobs(spark, sf).withColumn("index_version", F.col("index_version") - 1).withColumn("was", F.col("state"))
    return lc.obsolete_jobs(jobs, v.d_guard(spark, sf)).groupBy("was", "state").agg(F.count("*").alias("n"))


FOLLOWUP = r"^(?:And|Of|The|Et|Und|In) "


@query("qa_followup_rewrite", "WITH t AS (SELECT conv_id, turn, role, trim(text, ' ') AS text, last_value(CASE WHEN role = 'user' AND trim(text, ' ') <> '' THEN trim(text, ' ') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^(?:And|Of|The|Et|Und|In) ') AND prev IS NOT NULL THEN prev || chr(10) || text ELSE text END AS query FROM t WHERE role = 'user'")
def qa_followup_rewrite(spark, sf):
    return ev.followup_queries(v.t(spark, sf, "conversations"), FOLLOWUP)


@query("qa_messages", "WITH x AS (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY 1) l USING (conv_id) WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND turn <= last) SELECT conv_id, 'system: Answer from the sources.' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM x WHERE n <= 13 GROUP BY 1")
def qa_messages(spark, sf):
    return ev.chat_messages(v.t(spark, sf, "conversations"), "Answer from the sources.").select("conv_id", F.array_join("messages", "\n").alias("messages"))


@query("evidence_pack_text", v.with_views("d_chunk", body="SELECT document_id, sha256(string_agg('[' || n || '] ' || CASE WHEN length(content) > 600 THEN left(content, 600) || '...' ELSE content END, chr(10) || chr(10) ORDER BY n)) AS evidence_hash FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS n FROM d_chunk) GROUP BY 1"))
def evidence_pack_text(spark, sf):
    return ev.evidence_blocks(v.d_chunk(spark, sf, embeddings=False), ["document_id"], ["chunk_index", "id"], F.col("content"), ev.PREVIEW_CHARS).select("document_id", F.sha2("evidence", 256).alias("evidence_hash"))


@query("rag_trace", v.with_views("d_chunk", body="SELECT coalesce(tenant_id, -1) AS tenant_id, knowledge_base_id, sha256(array_to_string(list_sort(list_distinct(list(document_id))), ',')) AS documents, count(DISTINCT id) AS n_chunks FROM d_chunk GROUP BY 1, 2"))
def rag_trace(spark, sf):
    """What each tenant's knowledge base was answered from: a digest of its documents, and how many chunks."""
    group = ["tenant_id", "knowledge_base_id"]
    chunks = v.d_chunk(spark, sf, embeddings=False)
    counts = chunks.groupBy(*group).agg(F.countDistinct("id").alias("n_chunks"))
    documents = ev.trace_digests(chunks, group, "document_id").select(F.col("tenant_id").alias("_t"), F.col("knowledge_base_id").alias("_k"), F.col("digest").alias("documents"))
    rows = counts.join(documents, F.col("tenant_id").eqNullSafe(F.col("_t")) & F.col("knowledge_base_id").eqNullSafe(F.col("_k")))
    return rows.select(F.coalesce("tenant_id", F.lit(-1)).alias("tenant_id"), "knowledge_base_id", "documents", "n_chunks")


@query("generate_sources", v.with_views("d_chunk", "d_guard", body=f"{_VISIBLE}, top AS (SELECT *, {_SIM} AS sim FROM visible WHERE embedding IS NOT NULL ORDER BY sim DESC, id LIMIT 10) SELECT row_number() OVER (ORDER BY sim DESC, id) AS rank, id, document_id, round(sim, 4) AS score, left(content, 200) AS preview FROM top"))
def generate_sources(spark, sf):
    hits = rt.vector_search(_visible(spark, sf), _query_vector(spark, sf)).withColumn("score", F.col("similarity"))
    return ev.source_list(hits, [F.desc("similarity"), "id"])


@query("rerank_stub", v.with_views("d_chunk", "d_guard", body=f"{_VISIBLE} SELECT id, score FROM (SELECT id, round(length(content) % 97 / 97.0::DOUBLE, 6) AS score FROM (SELECT * FROM visible WHERE content ILIKE '%{KEYWORD}%' ORDER BY id LIMIT 20)) ORDER BY score DESC, id LIMIT 5"))
def rerank_stub(spark, sf):
    rows = rt.visible_chunks(v.d_chunk(spark, sf, embeddings=False), v.d_guard(spark, sf), TENANT)
    recall = rt.keyword_search(rows, KEYWORD, 20)
    return rt.rerank(recall, rt.rerank_text("content"), lambda c: F.round(F.length(c) % 97 / 97.0, 6), 5).select("id", "score")


@query("embed_distinct")
def embed_distinct(spark, sf):
    """The stand-in embedder over distinct texts; compared with the column function in the tests."""
    rows = v.t(spark, sf, "conversations").select("conv_id", "turn", "text")
    return ex.embed(rows, "text", ex.hash_embedder(DIM)).select("conv_id", "turn", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x0"))


@query("relation_edges", "WITH raw AS (SELECT doc_id AS source, (doc_id * 5 + 1) % 1200 AS target, ['related', 'prerequisite', 'other', 'derived_from'][doc_id % 4 + 1] AS k FROM documents UNION ALL SELECT doc_id, (doc_id * 5 + 1) % 1200, 'related' FROM documents) SELECT source, target, min(CASE WHEN k = 'other' THEN 'related' ELSE k END) AS rel_type FROM raw WHERE source <> target AND target IN (SELECT doc_id FROM documents) GROUP BY 1, 2")
def relation_edges(spark, sf):
    d = v.t(spark, sf, "documents").select("doc_id")
    i = F.col("doc_id")
    kinds = F.get(F.array(*map(F.lit, ("related", "prerequisite", "other", "derived_from"))), (i % 4).cast("int"))
    raw = d.select(i.alias("source"), ((i * 5 + 1) % 1200).alias("target"), kinds.alias("rel_type")).unionByName(d.select(i.alias("source"), ((i * 5 + 1) % 1200).alias("target"), F.lit("related").alias("rel_type")))
    return ex.relation_edges(raw, d.select(i.alias("id")))


@query("llm_extract_stub", r"SELECT conv_id, turn, 0 AS item_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, length(text) % 10 AS page FROM conversations WHERE role = 'user' AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def llm_extract_stub(spark, sf):
    return llm_extract_stub_all(spark, sf)


def _extracted(rows: DataFrame) -> DataFrame:
    answered = ex.complete(rows, F.col("text"), _stub_model)
    return ex.records(answered, F.col("answer"), ["conv_id", "turn"]).select("conv_id", "turn", "item_no", "text", "page")


@query("llm_extract_stub_all", r"SELECT conv_id, turn, 0 AS item_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, length(text) % 10 AS page FROM conversations WHERE role = 'user' AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def llm_extract_stub_all(spark, sf):
    """All user turns, also those with quotes, backslashes and line breaks."""
    return _extracted(v.t(spark, sf, "conversations").filter("role = 'user'"))


def _stub_model():
    import json

    return lambda texts: ["```json\n" + json.dumps([{"title": "t", "text": t, "page": f"page {len(t) % 10}"}]) + "\n```" for t in texts]


@query("html_blocks")
def html_blocks(spark, sf):
    """Block rows of the pages table; the DOCX reader is tested on generated files."""
    pages = v.t(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.lit("html").alias("file_type"), F.col("html").cast("binary").alias("content"))
    return files.parse_blocks(pages).select("document_id", "pos", "kind", "level", "text")


@query("file_inspect", "SELECT page_id AS document_id, md5(html) AS md5, sha256(html) AS sha256, 'html' AS file_type FROM pages")
def file_inspect(spark, sf):
    rows = v.t(spark, sf, "pages").select(F.col("page_id").alias("document_id"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return rows.select("document_id", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), files.file_type(F.col("path"), F.col("content")).alias("file_type"))


@query("repeated_hashes", v.with_views("d_document", body="SELECT file_hash, count(*) AS n_rows FROM d_document GROUP BY 1 HAVING count(*) > 1"))
def repeated_hashes(spark, sf):
    """Files that were taken in more than once."""
    return gv.repeated_keys(v.d_document(spark, sf), "file_hash")


@query(
    "guard_backfill",
    v.with_views(
        "d_guard",
        "d_document",
        body="""SELECT document_id, tenant_id, lifecycle_status, coalesce(current_index_version, -1) AS current_index_version FROM d_guard
UNION ALL
SELECT id, tenant_id, 'ACTIVE', -1 FROM d_document d WHERE NOT EXISTS (SELECT 1 FROM d_guard g WHERE g.document_id = d.id)""",
    ),
)
def guard_backfill(spark, sf):
    out = gv.insert_missing_guards(v.d_guard(spark, sf), v.d_document(spark, sf))
    return out.select("document_id", "tenant_id", "lifecycle_status", F.coalesce(F.col("current_index_version").cast("long"), F.lit(-1)).alias("current_index_version"))


@query(
    "pattern_tenant_backfill",
    v.with_views(
        "d_pattern",
        "d_pattern_source",
        "d_document",
        body="""one AS (
  SELECT pattern_id, min(tenant_id) AS tenant_id FROM d_pattern_source s JOIN d_document d ON d.id = s.document_id
  GROUP BY 1 HAVING count(DISTINCT tenant_id) = 1)
SELECT p.id, coalesce(CASE WHEN p.id % 7 <> 0 THEN p.tenant_id END, one.tenant_id, -1) AS tenant_id
FROM d_pattern p LEFT JOIN one ON one.pattern_id = p.id""",
    ),
)
def pattern_tenant_backfill(spark, sf):
    """Patterns that lost their tenant get that of their source documents where these agree."""
    patterns = v.d_pattern(spark, sf).select("id", F.when(F.col("id") % 7 != 0, F.col("tenant_id")).alias("tenant_id"))
    sources = v.d_pattern_source(spark, sf).join(v.d_document(spark, sf).select(F.col("id").alias("document_id"), "tenant_id"), "document_id")
    filled = gv.backfill(patterns, "id", sources, "tenant_id", "pattern_id")
    return filled.select("id", F.coalesce("tenant_id", F.lit(-1)).alias("tenant_id"))


@query(
    "invariant_census",
    v.with_views(
        "d_chunk",
        "d_document",
        "d_guard",
        "d_pattern",
        "d_pattern_source",
        "d_request",
        body="""SELECT 'chunk_without_tenant' AS name, count(*) AS violations FROM d_chunk WHERE tenant_id IS NULL
UNION ALL SELECT 'guard_tenant', count(*) FROM d_guard g JOIN d_document d ON d.id = g.document_id WHERE g.tenant_id IS DISTINCT FROM d.tenant_id
UNION ALL SELECT 'pattern_without_source', count(*) FROM d_pattern p WHERE NOT EXISTS (SELECT 1 FROM d_pattern_source s WHERE s.pattern_id = p.id)
UNION ALL SELECT 'source_without_pattern', count(*) FROM d_pattern_source s WHERE NOT EXISTS (SELECT 1 FROM d_pattern p WHERE p.id = s.pattern_id)
UNION ALL SELECT 'pattern_over_tenants', count(*) FROM (
  SELECT pattern_id FROM d_pattern_source s JOIN d_document d ON d.id = s.document_id GROUP BY 1 HAVING count(DISTINCT tenant_id) > 1)
UNION ALL SELECT 'pattern_repeated', count(*) FROM (SELECT tenant_id, fingerprint FROM d_pattern GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'document_repeated', count(*) FROM (SELECT id FROM d_document GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'request_over_tenants', count(*) FROM (SELECT document_id FROM d_request GROUP BY 1 HAVING count(DISTINCT tenant_id) > 1)
UNION ALL SELECT 'chunk_of_deleted', count(*) FROM d_chunk c JOIN d_guard g ON g.document_id = c.document_id WHERE lifecycle_status = 'DELETED'""",
    ),
)
def invariant_census(spark, sf):
    docs, guard, patterns, sources = v.d_document(spark, sf), v.d_guard(spark, sf), v.d_pattern(spark, sf), v.d_pattern_source(spark, sf)
    chunks = v.d_chunk(spark, sf, embeddings=False)
    owners = sources.join(docs.select(F.col("id").alias("document_id"), "tenant_id"), "document_id")
    deleted = guard.filter(F.col("lifecycle_status") == lc.DELETED).select("document_id")
    return gv.audit(
        chunk_without_tenant=chunks.filter("tenant_id IS NULL"),
        guard_tenant=gv.mismatches(guard, "document_id", docs, "tenant_id"),
        pattern_without_source=gv.orphans(patterns, "id", sources, "pattern_id"),
        source_without_pattern=gv.orphans(sources, "pattern_id", patterns),
        pattern_over_tenants=gv.several_values(owners, "pattern_id", "tenant_id"),
        pattern_repeated=gv.repeated_keys(patterns, "tenant_id", "fingerprint"),
        document_repeated=gv.repeated_keys(docs, "id"),
        request_over_tenants=gv.several_values(v.d_request(spark, sf), "document_id", "tenant_id"),
        chunk_of_deleted=chunks.join(deleted, "document_id"),
    )


@query(
    "section_own_content",
    v.with_views(
        "d_block",
        body="""rows AS (SELECT document_id, pos, kind, text, (greatest(sum((kind = 'heading')::INT) OVER (PARTITION BY document_id ORDER BY pos) - 1, 0))::INT AS section_id FROM d_block)
SELECT document_id, section_id, string_agg(text, chr(10) ORDER BY pos) AS content FROM rows WHERE kind <> 'heading' AND text <> '' GROUP BY 1, 2""",
    ),
)
def section_own_content(spark, sf):
    return st.own_content(v.d_block(spark, sf))


@query(
    "pattern_expand",
    v.with_views(
        "d_block",
        "d_document",
        "d_pattern_source",
        body=f"""{_HEADS_SQL}, allowed AS (SELECT id FROM d_document WHERE tenant_id = 1),
rows AS (SELECT * FROM tree WHERE document_id IN (SELECT id FROM allowed)),
hits AS (SELECT s.pattern_id, r.document_id, r.section_id, r.parent_id FROM d_pattern_source s JOIN rows r ON r.document_id = s.document_id AND r.section_id = s.pattern_id % 3),
up AS (SELECT DISTINCT pattern_id, document_id, parent_id FROM hits WHERE coalesce(parent_id, 0) <> 0)
SELECT pattern_id, document_id, section_id AS id FROM hits
UNION SELECT up.pattern_id, r.document_id, r.section_id FROM up JOIN rows r ON r.document_id = up.document_id AND r.section_id = up.parent_id
UNION SELECT up.pattern_id, r.document_id, r.section_id FROM up JOIN rows r ON r.document_id = up.document_id AND r.parent_id = up.parent_id""",
    ),
)
def pattern_expand(spark, sf):
    """Of each pattern the source sections (here one per source document), their parents and siblings."""
    rows = _tree(spark, sf).select("document_id", F.col("section_id").alias("id"), "parent_id")
    allowed = TENANT.trusted_documents(v.d_document(spark, sf).select("id", "tenant_id"))
    sources = v.d_pattern_source(spark, sf).select("pattern_id", "document_id", (F.col("pattern_id") % 3).cast("int").alias("id"))
    return rt.expand_pattern_sources(rows, sources, allowed).select("pattern_id", "document_id", "id")


@query("version_stream")
def version_stream_query(spark, sf):
    """Requests as a stream, in one go; the newest row of each document is its state (equal to guard_merge)."""
    base = shared_path(spark, "version-stream")
    v.d_request(spark, sf).drop("ts").write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    changed = version_stream(spark.readStream.schema(schema).parquet(f"{base}/in"))

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/part={batch_id}")

    changed.writeStream.outputMode("update").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    newest = Window.partitionBy("document_id").orderBy(F.desc("batch"))
    return spark.read.parquet(f"{base}/out").drop("part").withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "batch")
