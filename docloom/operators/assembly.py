"""From extracted parts to records: embedding texts, real ids, section order, model labels, contracts, nested output, totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.scalar import label, string_list, strip, strip_fence
from docloom.operators.evidence import CONTENT_CHARS, PREVIEW_CHARS, truncated

PREVIEW_ROWS = 10


def labelled_text(fields: Mapping[str, Column], lists: Mapping[str, Column] | None = None) -> Column:
    """What a record is embedded as: "label: value" by line, then filled lists with a dash for each entry.  Nulls are empty."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(c.cast("string"), F.lit(""))) for k, c in fields.items()]
    for k, c in (lists or {}).items():
        entries = F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
        lines.append(F.when(F.size(c) > 0, F.concat(F.lit(f"{k}:\n"), entries)))
    return F.concat_ws("\n", *lines)


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def parse_vector(text: Column, dim: int) -> Column:
    """The vector of a text like "[1,2.5]"; null unless it has ``dim`` numbers."""
    v = F.from_json(text, "array<double>")
    return F.when((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull()), v)


def real_ids(rows: DataFrame, ids: DataFrame, column: str = "section_id") -> DataFrame:
    """Temporary ids replaced by those of ids(document_id, temporary_id, real_id); ids without a real one become null."""
    made = ids.select("document_id", F.col("temporary_id").alias("_old"), F.col("real_id").alias("_new"))
    out = rows.withColumnRenamed(column, "_old").join(made, ["document_id", "_old"], "left")
    return out.select(*(F.col("_new").alias(c) if c == column else F.col(c) for c in rows.columns))


def in_reading_order(sections: DataFrame) -> DataFrame:
    """Adds place, from 1 in each document: by sort_order (null as 0), then id."""
    order = Window.partitionBy("document_id").orderBy(F.coalesce("sort_order", F.lit(0)), "id")
    return sections.withColumn("place", F.row_number().over(order))


def preview(sections: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first sections of each document in reading order."""
    return in_reading_order(sections).filter(F.col("place") <= rows)


def best_stocked(documents: DataFrame, chunks: DataFrame, sections: DataFrame, sources: DataFrame, patterns: DataFrame, k: int = 1) -> DataFrame:
    """(tenant_id, document_id, n_embedded): of each tenant the k documents with most embedded chunks.

    Only documents count that have a section and are a source of a pattern with fingerprint of the same tenant.
    """
    n = chunks.filter("embedding IS NOT NULL").groupBy("document_id").agg(F.count("*").alias("n_embedded"))
    owned = sources.join(patterns.filter("fingerprint IS NOT NULL").select(F.col("id").alias("pattern_id"), "tenant_id"), "pattern_id")
    mine = documents.select(F.col("id").alias("document_id"), "tenant_id").join(n, "document_id")
    good = mine.join(sections, "document_id", "left_semi").join(owned, ["document_id", "tenant_id"], "left_semi")
    order = Window.partitionBy("tenant_id").orderBy(F.desc("n_embedded"), "document_id")
    return good.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n): a snapshot of row counts, to compare before and after a change."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])


def model_or_rule(model: Column, rule: Column, allowed: Sequence[str]) -> Column:
    """A model's label where it is one of the allowed ones, else the label by rule."""
    said = F.lower(strip(model))
    return F.when(said.isin(*allowed), said).otherwise(rule)


PATTERN = "struct<name: string, type: string, scenario: string, summary: string, structure: string>"


def pattern_records(rows: DataFrame, answer: Column, types: Sequence[str], aliases: Mapping[str, str], default: str) -> DataFrame:
    """Adds the fields of a model's JSON answer; rows whose answer is no object with a name are dropped.

    A type outside ``types`` becomes the default; a structure that is no list becomes an empty one.
    """
    clean = strip_fence(answer)
    out = rows.withColumn("_p", F.when(clean.startswith("{"), F.from_json(clean, PATTERN))).filter(strip(F.col("_p.name")) != "")
    kind = label(F.col("_p.type"), aliases, default)
    text = lambda c: F.coalesce(strip(F.col(f"_p.{c}")), F.lit("")).alias(c)
    listed = string_list(F.from_json(F.col("_p.structure"), "array<string>")).alias("structure")
    return out.select(*rows.columns, text("name"), F.when(kind.isin(*types), kind).otherwise(default).alias("type"), text("scenario"), text("summary"), listed)


def pattern_block(n: Column, head: Column, duplicates: Column, named: Mapping[str, Column], structure: Column, body: Column, chars: int = CONTENT_CHARS) -> Column:
    """One pattern for a prompt: numbered head, reuse, filled fields, structure in one line, cut body.

    ``body`` is to be the text without facts; the original text has no place here.
    """
    lines = [F.concat(F.lit("["), n.cast("string"), F.lit("] "), head), F.when(duplicates > 1, F.concat(F.lit("used: "), duplicates.cast("string")))]
    lines += [F.when(c != "", F.concat(F.lit(f"{k}: "), c)) for k, c in named.items()]
    lines.append(F.when(F.size(structure) > 0, F.concat(F.lit("structure: "), F.array_join(structure, " / "))))
    lines.append(F.when(body != "", F.concat(F.lit("text:\n"), truncated(body, chars))))
    return F.concat_ws("\n", *lines)


def section_block(level: Column, number: Column, title: Column, kind: Column, content: Column, chars: int = PREVIEW_CHARS) -> Column:
    """A section for a prompt: indented head with its type, and the start of its text if there is any."""
    indent = F.repeat(F.lit("  "), F.greatest(F.coalesce(level, F.lit(1)) - 1, F.lit(0)).cast("int"))
    head = F.concat(indent, F.concat_ws(" ", F.when(number != "", number), F.when(title != "", title), F.when(kind != "", F.concat(F.lit("("), kind, F.lit(")")))))
    text = strip(F.coalesce(content, F.lit("")))
    return F.concat_ws("\n", head, F.when(text != "", F.concat(indent, F.lit("  > "), truncated(text, chars))))


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def both_spellings(rows: DataFrame) -> DataFrame:
    """Every column under its name and, where that differs, in camel case: for readers of either contract."""
    return rows.select(*rows.columns, *(F.col(c).alias(_camel(c)) for c in rows.columns if _camel(c) not in rows.columns))


def nested_json(documents: DataFrame, patterns: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, json): each document with its patterns (by id) and relations (by source, target).

    patterns and relations have document_id; a document without any has empty lists.
    """

    def listed(rows: DataFrame, name: str) -> DataFrame:
        fields = [c for c in rows.columns if c != "document_id"]
        return rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    out = documents.join(listed(patterns, "patterns"), "document_id", "left").join(listed(relations, "relations"), "document_id", "left")
    filled = [F.coalesce(c, F.array()).alias(c) for c in ("patterns", "relations")]
    return out.select("document_id", F.to_json(F.struct(F.struct(*documents.columns).alias("document"), *filled)).alias("json"))


def analysis_summary(requirements: DataFrame, scores: DataFrame, risks: DataFrame, stats: DataFrame, key: str = "document_id") -> DataFrame:
    """stats (one row for each key) with the number of items of each kind and total_score (0 without any)."""
    none = F.lit(None).cast("double")
    kinds = {"n_requirements": requirements.withColumn("score", none), "n_scores": scores, "n_risks": risks.withColumn("score", none)}
    items = reduce(DataFrame.unionByName, [x.select(key, F.lit(k).alias("_kind"), "score") for k, x in kinds.items()])
    sums = items.groupBy(key).agg(*(F.count_if(F.col("_kind") == k).alias(k) for k in kinds), F.sum("score").alias("total_score"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in (*kinds, "total_score")]
    return stats.join(sums, key, "left").select(*stats.columns, *zero)
