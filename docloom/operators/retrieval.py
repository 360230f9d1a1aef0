"""Retrieval: exact vector search, keyword search, fusion, reranking, tree expansion, deduplication.

Every entry takes a TenantContext; every top-k breaks ties by id.  Top-k is orderBy().limit(), which
Spark runs as a bounded heap per task, so ranks are only computed over the k rows that remain.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.context import TenantContext
from docloom.functions.scalar import cosine
from docloom.operators.vectors import search_many

ACTIVE = "ACTIVE"
RRF_K = 60
RECALL = 60
TOP_K = 10


def active_only(rows: DataFrame, guard: DataFrame) -> DataFrame:
    """Rows of documents whose guard is ACTIVE; a document without a guard row is not visible."""
    return rows.join(guard.filter(F.col("lifecycle_status") == ACTIVE).select("document_id"), "document_id", "left_semi")


def visible_chunks(chunks: DataFrame, guard: DataFrame, tenant: TenantContext, document_types: Sequence[str] | None = None) -> DataFrame:
    """An empty list of types is no filter here."""
    rows = tenant.scope(chunks)
    if document_types:
        rows = rows.filter(F.col("document_type").isin(*document_types))
    return active_only(rows, guard)


def vector_search(rows: DataFrame, query: Column, k: int = TOP_K) -> DataFrame:
    """The k nearest rows by cosine distance (6 decimals, then id), with similarity."""
    scored = rows.filter("embedding IS NOT NULL").withColumn("similarity", F.round(cosine(F.col("embedding"), query), 6))
    return scored.filter("similarity IS NOT NULL").orderBy(F.desc("similarity"), "id").limit(k)


def vector_search_many(rows: DataFrame, queries: DataFrame, k: int = TOP_K, dim: int | None = None) -> DataFrame:
    """``vector_search`` for every row of queries(query_id, query): each query's k nearest, with query_id and the rows' columns.

    ``dim`` is that of the longest query where it isn't given.
    """
    if dim is None:
        dim = queries.agg(F.max(F.size("query"))).first()[0] or 1
    best = search_many(rows, queries, dim, k)
    return best.join(rows.drop("embedding", "similarity"), "id")


WORD_EDGE = r"[^\p{L}\p{N}]+"
BM25_K, BM25_B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Words of a text in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_EDGE), lambda w: w != "")


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def bm25(corpus: DataFrame, text: str, query: Sequence[str]) -> Callable[[Column], Column]:
    """A scorer of texts against the query's words by BM25, with the statistics of the whole corpus.

    One row of numbers comes to the driver: texts, words, and the texts that have each word of the query.
    """
    words = list(dict.fromkeys(w.lower() for w in query))
    listed = corpus.select(terms(F.col(text)).alias("_t"))
    row = listed.agg(F.count("*").alias("n"), F.sum(F.size("_t")).alias("words"), *(F.count(F.when(F.array_contains("_t", w), 1)).alias(f"d{i}") for i, w in enumerate(words))).first()
    n, mean = row.n, (row.words or 0) / row.n if row.n else 0.0

    def score(body: Column) -> Column:
        listed = terms(body)
        size = F.size(listed) / F.lit(mean or 1.0)
        total = F.lit(0.0)
        for i, w in enumerate(words):
            idf = math.log(1 + (n - row[f"d{i}"] + 0.5) / (row[f"d{i}"] + 0.5))
            times = F.size(F.filter(listed, _equals(w))).cast("double")
            total = total + F.lit(idf) * times * (BM25_K + 1) / (times + BM25_K * (1 - BM25_B + BM25_B * size))
        return F.round(total, 6)

    return score


def keyword_search(rows: DataFrame, words: str, k: int = TOP_K, wildcards: bool = True) -> DataFrame:
    """Rows whose content holds the words, letter case ignored, by id.  % and _ are live unless turned off."""
    text = words if wildcards else words.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return rows.filter(F.col("content").ilike(f"%{text}%")).withColumn("score", F.lit(1.0)).orderBy("id").limit(k)


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Ranks from 0 over a result that is already cut to k rows."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(vector: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two results: id, similarity (null if found by keyword only), score, order.

    Ties keep the order in which rows came: vector rows first, then keyword rows.
    """
    v = ranked(vector, F.desc("similarity"), "id", name="v_rank").select("id", "similarity", "v_rank")
    w = ranked(keyword, "id", name="k_rank").select(F.col("id").alias("k_id"), "k_rank")
    both = v.join(w, F.col("id") == F.col("k_id"), "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.col(c) + k + 1), F.lit(0.0))
    return both.select(F.coalesce("id", "k_id").alias("id"), "similarity", F.round(part("v_rank") + part("k_rank"), 9).alias("score"), "v_rank", "k_rank")


def hybrid_search(rows: DataFrame, query: Column, words: str, k: int = TOP_K, recall: int = RECALL) -> DataFrame:
    fused = fuse(vector_search(rows, query, recall), keyword_search(rows, words, recall))
    return fused.orderBy(F.desc("score"), F.asc_nulls_last("v_rank"), "k_rank").limit(k)


def rerank(rows: DataFrame, text: Column, scorer: Callable[[Column], Column], k: int) -> DataFrame:
    """The k best by a scorer (a column function or pandas UDF); score is replaced, similarity kept."""
    return rows.withColumn("score", scorer(text)).withColumn("score_type", F.lit("rerank")).orderBy(F.desc("score"), "id").limit(k)


def rerank_text(*fields: str, parts: str | None = None) -> Column:
    """What a reranker reads: the filled fields by blanks, list parts by " / "."""
    cols = [F.when(F.col(f) != "", F.col(f)) for f in fields]
    if parts:
        cols.append(F.when(F.size(parts) > 0, F.array_join(parts, " / ")))
    return F.concat_ws(" ", *cols)


def allowed_patterns(patterns: DataFrame, sources: DataFrame, documents: DataFrame, types: Sequence[str]) -> DataFrame:
    """Patterns with a source document of an allowed type; no type means no pattern."""
    if not types:
        return patterns.limit(0)
    good = sources.join(documents.filter(F.col("document_type").isin(*types)).select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("pattern_id").alias("id"))
    return patterns.join(good, "id", "left_semi")


def live_patterns(patterns: DataFrame, sources: DataFrame, guard: DataFrame) -> DataFrame:
    """Patterns with at least one source document that is ACTIVE."""
    return patterns.join(active_only(sources, guard).select(F.col("pattern_id").alias("id")), "id", "left_semi")


def pattern_search(patterns: DataFrame, query: Column, types: Sequence[str] = (), status: str | None = "active", k: int = 5) -> DataFrame:
    """Patterns by similarity (4 decimals in the result)."""
    rows = patterns
    if types:
        rows = rows.filter(F.col("type").isin(*types))
    if status:
        rows = rows.filter(F.col("status") == status)
    return vector_search(rows, query, k).withColumn("score", F.round("similarity", 4))


def search_with_fallback(patterns: DataFrame, query: Column, types: Sequence[str], status: str | None = "active", k: int = 5) -> DataFrame:
    """With the type filter; without it (tenant, base and source types stay) where it leaves nothing.

    One plan: the unfiltered result is joined away when the filtered one has a row.
    """
    typed = pattern_search(patterns, query, types, status, k)
    if not types:
        return typed
    found = typed.limit(1).select(F.lit(1).alias("_found"))
    rest = pattern_search(patterns, query, (), status, k)
    return typed.unionByName(rest.withColumn("_k", F.lit(1)).join(found, F.col("_k") == F.col("_found"), "left_anti").drop("_k"))


def pattern_sources(patterns: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds sources, a sorted array of documents (empty without any)."""
    listed = sources.groupBy(F.col("pattern_id").alias("id")).agg(F.array_sort(F.collect_set("document_id")).alias("sources"))
    return patterns.join(listed, "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<bigint>")))


def dedupe_patterns(found: DataFrame, scope: DataFrame, sources: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The first pattern of each fingerprint (patterns without one all stay), with duplicate_count and merged sources.

    found: the ranked result; scope: all patterns of the tenant whose fingerprints count.
    """
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order))).filter("fingerprint IS NULL OR _n = 1").drop("_n")
    counts = scope.filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count("*").alias("duplicate_count"))
    merged = scope.filter("fingerprint IS NOT NULL").select("fingerprint", F.col("id").alias("pattern_id")).join(sources, "pattern_id").groupBy("fingerprint").agg(F.array_sort(F.collect_set("document_id")).alias("all_sources"))
    own = pattern_sources(first, sources)
    out = own.join(counts, "fingerprint", "left").join(merged, "fingerprint", "left")
    return out.withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(1))).withColumn("sources", F.coalesce("all_sources", "sources")).drop("all_sources")


def fingerprint_sources(scope: DataFrame, sources: DataFrame) -> DataFrame:
    """(fingerprint, document_id), each once: the merged sources as rows, for copy groups of any size."""
    return scope.filter("fingerprint IS NOT NULL").select("fingerprint", F.col("id").alias("pattern_id")).join(sources, "pattern_id").select("fingerprint", "document_id").distinct()


def expand_sections(sections: DataFrame, hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hits, their parents and their siblings within allowed documents.

    hits: (document_id, id); roots have no siblings; parent 0 counts as none; a section comes once.
    """
    rows = sections.join(allowed, "document_id", "left_semi")
    parent = F.coalesce(F.col("parent_id"), F.lit(0))
    mine = rows.join(hits, ["document_id", "id"], "left_semi")
    up = mine.filter(parent != 0).select("document_id", F.col("parent_id").alias("_up")).distinct()
    parents = rows.join(up.withColumnRenamed("_up", "id"), ["document_id", "id"], "left_semi")
    siblings = rows.join(up.withColumnRenamed("_up", "parent_id"), ["document_id", "parent_id"], "left_semi").join(hits, ["document_id", "id"], "left_anti")
    parts = [x.select(*sections.columns) for x in (mine, parents, siblings)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["document_id", "id"])


def expand_pattern_sources(sections: DataFrame, sources: DataFrame, allowed: DataFrame) -> DataFrame:
    """(pattern_id, document_id, id): the source sections of each pattern, their parents and siblings, each once.

    sources: (pattern_id, document_id, id); as in ``expand_sections`` only allowed documents count.
    """
    rows = sections.join(allowed, "document_id", "left_semi")
    mine = sources.join(rows, ["document_id", "id"])
    up = mine.filter(F.coalesce("parent_id", F.lit(0)) != 0).select("pattern_id", "document_id", "parent_id").distinct()
    parents = up.select("pattern_id", "document_id", F.col("parent_id").alias("id")).join(rows.select("document_id", "id"), ["document_id", "id"])
    siblings = up.join(rows, ["document_id", "parent_id"])
    parts = [x.select("pattern_id", "document_id", "id") for x in (mine, parents, siblings)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def classify_queries(queries: DataFrame, rules: DataFrame, task_words: Sequence[str]) -> DataFrame:
    """Adds domains, pattern_types and task.  rules: rule_order, domain, keywords, pattern_types.

    Rules are one broadcast array; domains and types keep rule order, types come once.
    """
    table = rules.agg(F.array_sort(F.collect_list(F.struct("rule_order", "domain", "keywords", "pattern_types"))).alias("_rules"))
    q = F.lower(F.coalesce("question", F.lit("")))
    hits = F.filter(F.col("_rules"), lambda r: F.exists(r["keywords"], lambda w: F.contains(q, w)))
    solution = F.lit(False)
    for w in task_words:
        solution = solution | F.contains(q, F.lit(w))
    out = queries.withColumn("_one", F.lit(1)).join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one").withColumn("_hits", hits)
    return out.select(*queries.columns, F.col("_hits.domain").alias("domains"), F.array_distinct(F.flatten("_hits.pattern_types")).alias("pattern_types"), F.when(solution, "solution_generation").otherwise("qa").alias("task"))
