"""From hits to prompts: history, evidence packs, sources, traces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

HISTORY = 12
#: Ids that a digest's piece joins.
PIECE = 4096
CONTENT_CHARS, PREVIEW_CHARS, SOURCE_CHARS, SNIPPET_CHARS = 3000, 600, 200, 500


def followup_queries(turns: DataFrame, followup: str) -> DataFrame:
    """User turns with the query to search for: a follow-up (by pattern) gets the user's last filled turn before it.

    turns: conv_id, turn, role, text.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.trim("text"))
    out = turns.withColumn("_last", F.last(said, ignorenulls=True).over(before)).filter("role = 'user'")
    follows = F.trim("text").rlike(followup) & F.col("_last").isNotNull()
    return out.select("conv_id", "turn", F.when(follows, F.concat(F.col("_last"), F.lit("\n"), F.trim("text"))).otherwise(F.trim("text")).alias("query"))


def chat_messages(turns: DataFrame, system: str, limit: int = HISTORY) -> DataFrame:
    """(conv_id, messages): the system text, the last ``limit`` valid turns before the last user turn, that turn."""
    by_turn = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    valid = turns.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    last = turns.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("_last"))
    kept = valid.join(last, "conv_id").filter("turn <= _last").withColumn("_n", F.row_number().over(by_turn)).filter(F.col("_n") <= limit + 1)
    rows = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    item = lambda role, text: F.concat(role, F.lit(": "), text)
    return rows.select("conv_id", F.concat(F.array(F.lit(f"system: {system}")), F.transform("rows", lambda r: item(r["role"], r["text"]))).alias("messages"))


def truncated(text: Column, chars: int) -> Column:
    """At most ``chars`` characters, with a mark where something is missing."""
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("..."))).otherwise(text)


def evidence_blocks(hits: DataFrame, group: Sequence[str], order: Sequence[Column | str], content: Column, chars: int = CONTENT_CHARS, placeholder: str = "(none)") -> DataFrame:
    """One text per group: hits as numbered blocks in order, each cut; a group without filled hits has the placeholder."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    rows = hits.withColumn("_n", n).withColumn("_block", F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), truncated(content, chars)))
    text = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_n", "_block"))).alias("_rows"))
    return text.select(*group, F.coalesce(F.when(F.size("_rows") > 0, F.array_join("_rows._block", "\n\n")), F.lit(placeholder)).alias("evidence"))


def section_outline(level: Column, title: Column) -> Column:
    """A section's line in an outline, indented by level."""
    return F.concat(F.repeat(F.lit("  "), F.greatest(level - 1, F.lit(0))), F.lit("- "), title)


def trace_ids(hits: DataFrame, group: Sequence[str], *ids: str) -> DataFrame:
    """Distinct sorted ids of each kind per group."""
    return hits.groupBy(*group).agg(*(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ids))


def trace_rows(hits: DataFrame, group: Sequence[str], *ids: str) -> DataFrame:
    """The same ids as rows (group, kind, id), each once: for groups of any size."""
    parts = [hits.filter(F.col(c).isNotNull()).select(*group, F.lit(c).alias("kind"), F.col(c).alias("id")) for c in ids]
    return reduce(DataFrame.unionByName, parts).distinct()


def _runs(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, the other fields of its rows), of sorted rows with ``width`` columns of keys: at most ``most`` rows at once."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[:width] != key or len(held) == most):
                yield key, held
                held = []
            key = row[:width]
            held.append(row[width:])
    if held:
        yield key, held


def trace_digests(hits: DataFrame, group: Sequence[str], *ids: str) -> DataFrame:
    """(group, kind, n, digest) of the distinct ids: SHA-256 of the sorted ids with commas between.

    Ids are sorted and joined by ranges; the digest of a group, which is one after the other by nature, reads a row for
    each ``PIECE`` ids and holds none of them.
    """
    rows = trace_rows(hits, group, *ids)
    keys = [*group, "kind"]
    width = len(keys)
    fields = rows.schema.fields
    pieces = StructType([*fields, StructField("n", LongType()), StructField("joined", StringType())])
    digests = StructType([*fields[:width], StructField("n", LongType()), StructField("digest", StringType())])
    piece_schema, digest_schema = to_arrow_schema(pieces), to_arrow_schema(digests)

    def batch(schema: pa.Schema, *row) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _runs(batches, width, PIECE):
            yield batch(piece_schema, *key, held[0][0], len(held), ",".join(str(x) for (x,) in held))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, made = None, 0, None
        for key, ((_, size, text),) in _runs(batches, width, 1):
            if made is not None and key != last:
                yield batch(digest_schema, *last, n, made.hexdigest())
                n, made = 0, None
            made = made or hashlib.sha256()
            made.update((("," if n else "") + text).encode())
            last, n = key, n + size
        if made is not None:
            yield batch(digest_schema, *last, n, made.hexdigest())

    made = rows.repartitionByRange(*keys, "id").sortWithinPartitions(*keys, "id").mapInArrow(join, pieces)
    return made.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(digest, digests)


def source_list(hits: DataFrame, order: Sequence[Column | str], chars: int = SOURCE_CHARS) -> DataFrame:
    """The cut result as numbered sources with score and preview."""
    rank = F.row_number().over(Window.orderBy(*order))
    return hits.select(rank.alias("rank"), "id", "document_id", F.round("score", 4).alias("score"), F.left("content", F.lit(chars)).alias("preview"))


def evidence_pack(**layers: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in layers.items()))


def given_or_extracted(given: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """Rows given for a key win; keys without any take the extracted ones."""
    return given.unionByName(extracted.join(given.select(key).distinct(), key, "left_anti"))
