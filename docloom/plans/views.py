"""Document-shaped views over the plain tables, as DataFrames and as the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.doctypes import DOCUMENT_TYPES, LEGACY_TYPES

RAW_TYPES = (*DOCUMENT_TYPES, *LEGACY_TYPES)
#: Labels made up for these views, one for each remainder.
PATTERN_TYPES = tuple(f"pattern_kind_{k}" for k in range(13))
LINE_SPACE = 100_000


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(names, index) -> F.Column:
    return F.get(F.array(*(F.lit(n) for n in names)), index.cast("int"))


def d_document(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(i.alias("id"), (i % 3 + 1).alias("tenant_id"), (i % 5 + 1).alias("enterprise_id"), (i % 4 + 1001).alias("knowledge_base_id"), _pick(RAW_TYPES, F.substring("source", 4, 9).cast("int") % 10).alias("document_type"), F.sha2("text", 256).alias("file_hash"), "text")


def d_guard(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents").filter("doc_id % 13 <> 0")
    i = F.col("doc_id")
    return d.select(
        i.alias("document_id"), (i % 3 + 1).alias("tenant_id"), F.when(i % 11 == 0, "DELETED").when(i % 11 == 1, "QUARANTINED").otherwise("ACTIVE").alias("lifecycle_status"),
        F.when(i % 7 != 0, i % 5 + 1).alias("current_index_version"), F.md5(i.cast("string")).alias("index_input_hash"),
    )


def d_lines(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def d_chunk(spark: SparkSession, sf: str, embeddings: bool = True) -> DataFrame:
    d, i = d_lines(spark, sf), F.col("document_id")
    cid = i * LINE_SPACE + F.col("pos")
    out = d.select(
        cid.alias("id"), F.when(cid % 83 == 0, i + 1_000_000_000).otherwise(i).alias("document_id"), F.when(cid % 97 != 0, i % 3 + 1).alias("tenant_id"),
        (i % 4 + 1001 + (cid % 89 == 0).cast("long")).alias("knowledge_base_id"), F.col("pos").alias("chunk_index"), F.col("text").alias("content"), _pick(RAW_TYPES, i % 10).alias("document_type"), F.when(F.col("pos") == 0, i).alias("vec"),
    )
    if not embeddings:
        return out.drop("vec")
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("vec"), "embedding")
    return out.join(e, "vec", "left").drop("vec")


def d_block(spark: SparkSession, sf: str) -> DataFrame:
    head = F.col("pos") % 4 == 0
    level = ((F.floor(F.col("pos") / 4) * 7 + F.col("document_id")) % 4 + 1).cast("int")
    return d_lines(spark, sf).select("document_id", "pos", F.when(head, "heading").otherwise("paragraph").alias("kind"), F.when(head, level).alias("level"), "text", (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"))


def d_pattern(spark: SparkSession, sf: str) -> DataFrame:
    d, i = t(spark, sf, "documents"), F.col("doc_id")
    e = t(spark, sf, "embeddings").select("vec_id", "embedding")
    return d.join(e, i == F.col("vec_id"), "left").select(
        i.alias("id"), (i % 3 + 1).alias("tenant_id"), (i % 4 + 1001).alias("knowledge_base_id"), _pick(PATTERN_TYPES, i % 13).alias("type"), F.when(i % 17 == 0, "quarantined").otherwise("active").alias("status"),
        F.sha1(F.trim("text")).alias("fingerprint"), "embedding",
    )


def d_pattern_source(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    n = d.agg(F.count("*")).first()[0]
    own = d.select(F.col("doc_id").alias("pattern_id"), F.col("doc_id").alias("document_id"))
    other = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("pattern_id"), ((F.col("doc_id") * 7 + 3) % n).alias("document_id"))
    return own.unionByName(other)


def d_request(spark: SparkSession, sf: str) -> DataFrame:
    e, i = t(spark, sf, "events"), F.col("event_id")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(
        i.alias("request_id"), F.col("user_id").alias("document_id"), F.when(i % 101 == 0, F.lit(9)).otherwise(F.col("user_id") % 3 + 1).cast("long").alias("tenant_id"), (F.floor((n - 1) / 4) + 1).cast("long").alias("index_version"),
        F.md5((i % 2).cast("string")).alias("input_hash"), F.when((F.col("event_type") == "error") & (i % 7 == 0), "DELETE").otherwise("INGEST").alias("op"), "ts",
    )


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


SQL = {
    "d_document": f"SELECT doc_id AS id, doc_id % 3 + 1 AS tenant_id, doc_id % 5 + 1 AS enterprise_id, doc_id % 4 + 1001 AS knowledge_base_id, {_list(RAW_TYPES)}[substr(source, 4)::INT % 10 + 1] AS document_type, sha256(text) AS file_hash, text FROM documents",
    "d_guard": "SELECT doc_id AS document_id, doc_id % 3 + 1 AS tenant_id, CASE doc_id % 11 WHEN 0 THEN 'DELETED' WHEN 1 THEN 'QUARANTINED' ELSE 'ACTIVE' END AS lifecycle_status, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 + 1 END AS current_index_version, md5(doc_id::VARCHAR) AS index_input_hash FROM documents WHERE doc_id % 13 <> 0",
    "d_lines": "SELECT doc_id AS document_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "d_chunk": f"SELECT id, CASE WHEN id % 83 = 0 THEN document_id + 1000000000 ELSE document_id END AS document_id, CASE WHEN id % 97 <> 0 THEN document_id % 3 + 1 END AS tenant_id, document_id % 4 + 1001 + (id % 89 = 0)::BIGINT AS knowledge_base_id, pos AS chunk_index, text AS content, {_list(RAW_TYPES)}[document_id % 10 + 1] AS document_type, embedding FROM (SELECT l.*, document_id * {LINE_SPACE} + pos AS id, CASE WHEN pos = 0 THEN document_id END AS vec FROM d_lines l) LEFT JOIN embeddings ON vec = vec_id",
    "d_block": "SELECT document_id, pos, CASE WHEN pos % 4 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN pos % 4 = 0 THEN ((pos // 4 * 7 + document_id) % 4 + 1)::INT END AS level, text, (pos // 10 + 1)::INT AS page FROM d_lines",
    "d_pattern": f"SELECT doc_id AS id, doc_id % 3 + 1 AS tenant_id, doc_id % 4 + 1001 AS knowledge_base_id, {_list(PATTERN_TYPES)}[doc_id % 13 + 1] AS type, CASE WHEN doc_id % 17 = 0 THEN 'quarantined' ELSE 'active' END AS status, sha1(trim(text)) AS fingerprint, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "d_pattern_source": "SELECT doc_id AS pattern_id, doc_id AS document_id FROM documents UNION ALL SELECT doc_id, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) FROM documents WHERE doc_id % 3 = 0",
    "d_request": "SELECT event_id AS request_id, user_id AS document_id, CASE WHEN event_id % 101 = 0 THEN 9 ELSE user_id % 3 + 1 END AS tenant_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 + 1 AS index_version, md5((event_id % 2)::VARCHAR) AS input_hash, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'DELETE' ELSE 'INGEST' END AS op, ts FROM events",
}
NEEDS = {"d_chunk": ("d_lines",), "d_block": ("d_lines",)}


def with_views(*names: str, body: str, recursive: bool = False) -> str:
    """A statement with the views it needs as common table expressions."""
    order: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    parts = [f"{n} AS ({SQL[n]})" for n in order]
    sep = "" if body.lstrip().upper().startswith("SELECT") else ",\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + (sep or "\n") + body
