"""Audits, trusted backfill and quarantine over the document tables.

Audits are counts that must be 0, one row each; all are unions of aggregates, so nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.doctypes import EXCLUDED_TYPE, LEGACY_TYPES, canonical_type


def audit(**checks: DataFrame) -> DataFrame:
    """(name, violations): the number of rows of each check."""
    counts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counts)


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose key has no parent (null keys included)."""
    return rows.join(parents.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")


def mismatches(rows: DataFrame, key: str, parents: DataFrame, column: str, parent_key: str = "id") -> DataFrame:
    """Rows whose column differs from their parent's, null being a value of its own."""
    p = parents.select(F.col(parent_key).alias("_parent"), F.col(column).alias("_theirs"))
    return rows.join(p, F.col(key) == F.col("_parent")).filter(~F.col(column).eqNullSafe(F.col("_theirs"))).select(*rows.columns)


def several_values(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Keys with more than one distinct value of a column."""
    return rows.groupBy(key).agg(F.countDistinct(column).alias("n_values")).filter("n_values > 1")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def insert_missing_guards(guard: DataFrame, documents: DataFrame) -> DataFrame:
    """The guard with an ACTIVE row, without version and hash, for each document(id, tenant_id) that it lacks."""
    missing = documents.join(guard.select(F.col("document_id").alias("_guarded")), F.col("id") == F.col("_guarded"), "left_anti")
    rows = missing.select(F.col("id").alias("document_id"), "tenant_id", F.lit("ACTIVE").alias("lifecycle_status"))
    return guard.unionByName(rows.dropDuplicates(["document_id"]), allowMissingColumns=True)


def backfill(rows: DataFrame, key: str, parents: DataFrame, column: str, parent_key: str = "id") -> DataFrame:
    """Fill a null column from the parent, only where the parent's value is unambiguous."""
    one = parents.groupBy(F.col(parent_key).alias("_parent")).agg(F.min(column).alias("_value"), F.countDistinct(column).alias("_n")).filter("_n = 1").drop("_n")
    out = rows.join(one, F.col(key) == F.col("_parent"), "left")
    return out.withColumn(column, F.coalesce(column, "_value")).select(*rows.columns)


def tender_only_patterns(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """(pattern_id, kind): 'tender_only' if all sources are of the excluded type, 'mixed' if some are."""
    kinds = documents.select(F.col("id").alias("document_id"), (canonical_type(F.col("document_type")) == EXCLUDED_TYPE).alias("excluded"))
    per = sources.join(kinds, "document_id").groupBy("pattern_id").agg(F.bool_and("excluded").alias("every"), F.bool_or("excluded").alias("some"))
    return per.filter("some").select("pattern_id", F.when(F.col("every"), "tender_only").otherwise("mixed").alias("kind"))


def quarantine(patterns: DataFrame, sources: DataFrame, documents: DataFrame, status: str = "quarantined") -> DataFrame:
    """Patterns with tender-only ones set aside; running it again changes nothing."""
    bad = tender_only_patterns(sources, documents).filter("kind = 'tender_only'").select(F.col("pattern_id").alias("_bad"))
    out = patterns.join(bad, F.col("id") == F.col("_bad"), "left")
    return out.withColumn("status", F.when(F.col("_bad").isNotNull(), status).otherwise(F.col("status"))).select(*patterns.columns)


def renamed_types(documents: DataFrame) -> DataFrame:
    """Documents whose type is an older name, set to the present one."""
    return documents.withColumn("document_type", F.when(F.trim("document_type").isin(*LEGACY_TYPES), canonical_type(F.col("document_type"))).otherwise(F.col("document_type")))


def counts_by(rows: DataFrame, column: str | Column, name: str = "label") -> DataFrame:
    """(label, n), null as the label 'NULL'."""
    c = F.col(column) if isinstance(column, str) else column
    return rows.groupBy(F.coalesce(c.cast("string"), F.lit("NULL")).alias(name)).agg(F.count("*").alias("n"))
