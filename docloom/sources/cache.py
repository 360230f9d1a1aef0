"""A keyed cache of extractions as a table: misses are an anti join, answers are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def misses(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def answered(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests with their cached answer; the newest of repeated entries counts."""
    newest = cache.groupBy(key).agg(F.max_by("answer", "created").alias("answer"))
    return requests.join(newest, key, "left")
