"""A whole retrieval request: two channels, deduplication, expansion, facts, context and trace.

Every part is a lazy DataFrame.  What is broadcast or ranked in one task is a result that a top-k has cut;
tables of the index are only filtered and semi-joined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.context import TenantContext
from docloom.operators import evidence as ev
from docloom.operators import extraction as ex
from docloom.operators import fanout as fo
from docloom.operators import retrieval as rt

FACT_K = 5
PATTERN_K = 5


@dataclass(frozen=True)
class Index:
    """chunks (with section_id), guard, documents, sections (document_id, id, parent_id), patterns and their sources."""

    chunks: DataFrame
    guard: DataFrame
    documents: DataFrame
    sections: DataFrame
    patterns: DataFrame
    sources: DataFrame


@dataclass(frozen=True)
class Request:
    """What is asked: the query's vector and words, filters, sizes, and a scorer if hits are to be reranked.

    No document types is no filter; no pattern document types means no patterns.
    """

    vector: Column
    words: str
    document_types: Sequence[str] = ()
    pattern_types: Sequence[str] = ()
    pattern_document_types: Sequence[str] = ()
    fact_types: Sequence[str] = ()
    top_k: int = rt.TOP_K
    pattern_k: int = PATTERN_K
    fact_k: int = FACT_K
    scorer: Callable[[Column], Column] | None = None


def search_chunks(index: Index, tenant: TenantContext, asked: Request, types: Sequence[str], k: int) -> DataFrame:
    """The k best visible chunks by both channels, with all their columns, score and rank from 1."""
    rows = rt.visible_chunks(index.chunks, index.guard, tenant, types)
    hits = rt.hybrid_search(rows, asked.vector, asked.words, rt.RECALL if asked.scorer else k)
    found = rows.join(F.broadcast(hits), "id")
    order = [F.desc("score"), F.asc_nulls_last("v_rank"), F.col("k_rank")]
    if asked.scorer:
        found, order = rt.rerank(found, F.coalesce("content", F.lit("")), asked.scorer, k), [F.desc("score"), F.col("id")]
    return rt.ranked(found, *order).withColumn("rank", F.col("rank") + 1)


def search_patterns(index: Index, tenant: TenantContext, asked: Request) -> tuple[DataFrame, DataFrame]:
    """(the best patterns, the patterns they were chosen from): tenant, source types and live sources always hold."""
    scope = rt.allowed_patterns(tenant.scope(index.patterns), index.sources, index.documents, asked.pattern_document_types)
    scope = rt.live_patterns(scope, index.sources, index.guard)
    return rt.search_with_fallback(scope, asked.vector, asked.pattern_types, k=asked.pattern_k), scope


def retrieve(index: Index, tenant: TenantContext, asked: Request) -> dict[str, DataFrame]:
    """Both channels as they come, before deduplication."""
    return {"patterns": search_patterns(index, tenant, asked)[0], "evidences": search_chunks(index, tenant, asked, asked.document_types, asked.top_k)}


def unique_patterns(found: DataFrame, scope: DataFrame, sources: DataFrame) -> DataFrame:
    """Found patterns, one of each fingerprint, with duplicate_count and merged sources.

    Only the fingerprints that were found are counted and merged: at most as many as the top-k has rows.
    """
    wanted = F.broadcast(found.select("fingerprint").filter("fingerprint IS NOT NULL").distinct())
    same = scope.drop("embedding").join(wanted, "fingerprint", "left_semi")
    out = rt.dedupe_patterns(found, same, sources, [F.desc("similarity"), "id"])
    return rt.ranked(out, F.desc("similarity"), "id").withColumn("rank", F.col("rank") + 1)


def request_sections(sections: DataFrame, evidences: DataFrame) -> DataFrame:
    """Sections of the hits with parents and siblings, within the documents that were hit: sections have no tenant."""
    hits = evidences.filter("section_id IS NOT NULL").select("document_id", F.col("section_id").alias("id")).distinct()
    allowed = evidences.select("document_id").filter("document_id IS NOT NULL").distinct()
    return rt.expand_sections(sections, F.broadcast(hits), F.broadcast(allowed))


def run(index: Index, tenant: TenantContext, asked: Request, deduplicate: bool = True, expand: bool = True) -> dict[str, DataFrame]:
    """patterns, evidences, sections, enterprise_facts, context (layer, text) and trace (layer, document_id, id, rank).

    Layers without hits have no rows in any of them.  Ranks start at 1; sections have rank 0, as they are a set.
    """
    found, scope = search_patterns(index, tenant, asked)
    patterns = unique_patterns(found, scope, index.sources) if deduplicate else rt.ranked(rt.pattern_sources(found, index.sources), F.desc("similarity"), "id").withColumn("rank", F.col("rank") + 1)
    evidences = search_chunks(index, tenant, asked, asked.document_types, asked.top_k)
    facts = search_chunks(index, tenant, asked, asked.fact_types, asked.fact_k)
    sections = request_sections(index.sections, evidences) if expand else index.sections.limit(0)
    layers = {"evidence": evidences, "enterprise_fact": facts}
    texts = reduce(DataFrame.unionByName, (rows.select(F.lit(name).alias("layer"), "rank", "content") for name, rows in layers.items()))
    line = lambda rows, name, document, rank: rows.select(F.lit(name).alias("layer"), document.alias("document_id"), "id", rank.cast("int").alias("rank"))
    parts = [line(rows, name, F.col("document_id"), F.col("rank")) for name, rows in layers.items()]
    parts += [line(sections, "section", F.col("document_id"), F.lit(0)), line(patterns, "pattern", F.lit(None).cast("long"), F.col("rank"))]
    return {
        "patterns": patterns,
        "evidences": evidences,
        "sections": sections,
        "enterprise_facts": facts,
        "context": ev.evidence_blocks(texts, ["layer"], ["rank"], F.coalesce("content", F.lit(""))),
        "trace": reduce(DataFrame.unionByName, parts),
    }


@dataclass(frozen=True)
class Question:
    """A user's question: its words, the rules of its intent, and what it says or brings of a tender.

    ``requirements`` and ``scores`` are rows (item_no, title, text, page); ``tender`` is the tender's text, one row (text),
    from which what is not given is extracted by the models ``extract`` and ``extract_scores``.
    """

    text: str
    rules: DataFrame
    task_words: Sequence[str] = ()
    requirements: DataFrame | None = None
    scores: DataFrame | None = None
    tender: DataFrame | None = None
    extract: Callable[[], Callable] | None = None
    extract_scores: Callable[[], Callable] | None = None
    score_marks: Sequence[str] = ()


ITEM = "item_no int, title string, text string, page int"
#: Layers of the material that a model gets, in this order; the others are for the caller.
MATERIAL = ("requirement", "score", "evidence", "enterprise_fact")


def resolved(question: Question, given: DataFrame | None, factory: Callable[[], Callable] | None) -> DataFrame:
    """Given rows, if there are any; else those that a model finds in the tender's text; else none."""
    spark = question.rules.sparkSession
    none = spark.createDataFrame([], ITEM)
    if given is not None and not given.isEmpty():
        return given.select("item_no", "title", "text", "page")
    if question.tender is None or factory is None:
        return none
    answers = ex.complete(question.tender.select("text"), F.col("text"), factory, "_answer")
    return ex.records(answers.select("_answer"), F.col("_answer"), []).select("item_no", "title", "text", "page")


def item_lines(items: DataFrame, layer: str) -> DataFrame:
    """(layer, text): items by number, one line each, with title and page where they are filled."""
    head = F.concat(F.row_number().over(Window.orderBy("item_no", "text")).cast("string"), F.lit(". "))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit(": "))).otherwise("")
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))).otherwise("")
    lines = items.select(F.concat(head, title, "text", page).alias("_l"), F.row_number().over(Window.orderBy("item_no", "text")).alias("_n"))
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_l"))), lambda x: x["_l"]), "\n").alias("text"))
    return text.filter("text <> ''").select(F.lit(layer).alias("layer"), "text")


def material(layers: DataFrame, question: str) -> DataFrame:
    """(prompt): layers(layer, text) in the order of ``MATERIAL`` under their names, then the question."""
    place = F.array_position(F.array(*map(F.lit, MATERIAL)), F.col("layer"))
    part = F.struct(place.alias("_n"), F.concat(F.lit("## "), "layer", F.lit("\n"), "text").alias("_t"))
    joined = layers.filter(place > 0).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["_t"]), "\n\n").alias("_all"))
    head = F.when(F.col("_all") != "", F.concat("_all", F.lit("\n\n"))).otherwise("")
    return joined.select(F.concat(head, F.lit(f"## question\n{question}")).alias("prompt"))


def ask(index: Index, tenant: TenantContext, question: Question, asked: Request, generate: Callable[[], Callable], deduplicate: bool = True, expand: bool = True) -> dict[str, DataFrame]:
    """``run`` with the question's intent and requirements, and the answer of a model to all of it.

    Pattern types that are asked for win over those of the intent.  Adds intent (domains, pattern_types, task),
    requirements, scores, prompt (prompt) and answer (answer, error; a failed call has a null answer).  What
    is gathered here belongs to one request: top-k results, and items of one tender.
    """
    spark = question.rules.sparkSession
    one = spark.createDataFrame([(question.text,)], "question string")
    intent = rt.classify_queries(one, question.rules, question.task_words).select("domains", "pattern_types", "task")
    types = asked.pattern_types or tuple(intent.first().pattern_types)
    out = run(index, tenant, replace(asked, pattern_types=types), deduplicate, expand)
    scores = resolved(question, question.scores, question.extract_scores)
    requirements = ex.without_score_rows(resolved(question, question.requirements, question.extract), list(question.score_marks))
    layers = item_lines(requirements, "requirement").unionByName(item_lines(scores, "score")).unionByName(out["context"].select("layer", F.col("evidence").alias("text")))
    prompt = material(layers, question.text)
    answer = fo.fan_out(prompt, F.col("prompt"), generate).select("answer", "error")
    return out | {"intent": intent, "requirements": requirements, "scores": scores, "prompt": prompt, "answer": answer}
