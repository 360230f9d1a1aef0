"""Relations between the patterns of a document, asked of a model: the whole set first, blocks where that fails.

Defined results: documents with one pattern have none.  Sets of more than ``whole`` patterns do not fit a prompt and are
asked in blocks at once; so are those whose call fails or whose answer is no JSON.  A block that fails is left out, one
with a single pattern is not asked.  An answer that is JSON, but no list of relations, has none.  Relations name two
different patterns of their own set or block; other kinds than the known ones count as 'related'; a pair counts once, as
it is named first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalar import strip_fence
from docloom.operators.extraction import RELATIONS
from docloom.operators.fanout import WORKERS, fan_out
from docloom.operators.ids import dense_ids

BLOCK = 8
WHOLE = 400
SUMMARY_CHARS = 120
_EDGE = "source: string, target: string, rel_type: string"


def _asked(members: DataFrame, factory, workers: int) -> DataFrame:
    """(document_id, block, answer, error): one call per document and block of members, in their order."""
    item = F.struct("place", "code", "name", F.left(F.coalesce("summary", F.lit("")), F.lit(SUMMARY_CHARS)).alias("summary"))
    sets = members.groupBy("document_id", "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
    listed = F.transform("items", lambda i: F.struct(i["code"].alias("code"), i["name"].alias("name"), i["summary"].alias("summary")))
    prompts = sets.select("document_id", "block", F.to_json(listed).alias("prompt"))
    return fan_out(prompts, F.col("prompt"), factory, workers=workers).drop("prompt")


def _edges(answer: Column) -> Column:
    """An answer's relations, an empty array where it is JSON of another kind, null where it is no JSON."""
    clean = strip_fence(answer)
    listed = F.when(clean.startswith("{"), F.get_json_object(clean, "$.relations")).when(clean.startswith("["), clean)
    valid = F.try_parse_json(clean).isNotNull()
    return F.when(valid, F.coalesce(F.from_json(listed, f"array<struct<{_EDGE}>>"), F.array().cast(f"array<struct<{_EDGE}>>")))


def extract_relations(patterns: DataFrame, order: list[str], factory: Callable[[], Callable], keep: Callable[[DataFrame], DataFrame], block: int = BLOCK, whole: int = WHOLE, workers: int = WORKERS) -> DataFrame:
    """(document_id, source, target, rel_type) of patterns(document_id, code, name, summary, ...).

    ``order`` must tell the patterns of a document apart; codes are distinct within a document.  Places in a document come
    from one sort of the whole table, so neither sort nor list ever holds a large document: lists have ``whole``
    patterns at most.
    """
    numbered, _ = dense_ids(patterns.select("document_id", *order, "code", "name", "summary"), ["document_id", *order], 0, keep, "_id")
    sizes = numbered.groupBy("document_id").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    placed = keep(numbered.join(sizes, "document_id").select("document_id", (F.col("_id") - F.col("_first")).alias("place"), "code", "name", "summary", "_n"))
    fits = placed.filter(F.col("_n") <= whole).withColumn("block", F.lit(-1).cast("long"))
    first = keep(_asked(fits, factory, workers).withColumn("edges", _edges(F.col("answer"))).drop("answer", "error"))
    failed = placed.filter(F.col("_n") > whole).unionByName(placed.join(first.filter("edges IS NULL").select("document_id"), "document_id", "left_semi"))
    blocks = failed.withColumn("block", F.floor(F.col("place") / block).cast("long"))
    single = (F.col("_n") % block == 1) & (F.col("place") == F.col("_n") - 1)
    again = keep(_asked(blocks.filter(~single), factory, workers).withColumn("edges", _edges(F.col("answer"))).drop("answer", "error"))
    said = first.unionByName(again).select("document_id", "block", F.posexplode("edges").alias("pos", "e")).select("document_id", "block", "pos", "e.source", "e.target", "e.rel_type")
    members = fits.select("document_id", "block", "code").unionByName(blocks.select("document_id", "block", "code"))
    known = said.filter("source <> target")
    for end in ("source", "target"):
        known = known.join(members.withColumnRenamed("code", end), ["document_id", "block", end], "left_semi")
    kind = F.when(F.col("rel_type").isin(*RELATIONS), F.col("rel_type")).otherwise("related")
    named = known.groupBy("document_id", "source", "target").agg(F.min(F.struct("block", "pos", kind.alias("rel_type"))).alias("_f"))
    return named.select("document_id", "source", "target", "_f.rel_type")
