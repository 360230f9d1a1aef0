"""Filling a text that a model makes from another one, for all rows of a published table that lack it.

The table is done ``AT_ONCE`` buckets at a time, whose calls share the cluster.  A bucket's answers are written before they are
published, under a name that follows from its rows, so a run that is broken goes on where it was: a row is sent again only
if its own bucket's calls were under way.  Publishing, one version for these buckets, merges the answers into the newest version: a row that has got a value, or another text, in
the meantime stays as it is.  Failed rows stay without a value, with the error in the table of failures, and are sent
by the next run.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalar import strip
from docloom.operators.fanout import WORKERS, fan_out
from docloom.sources.publish import Conflict, Store, Stored, Version, listed

#: Buckets whose answers are made by jobs that run side by side, and published in one version.
AT_ONCE = 8
FAILURE = Stored("id long, error string", "id", ("id",))


class Progress(NamedTuple):
    """Rows sent, filled, left blank by the model, and failed; blank sources are never sent."""

    version: Version
    sent: int
    filled: int
    blank: int
    failed: int
    buckets: int


def _pending(rows: DataFrame, source: str, target: str, force: bool) -> DataFrame:
    filled = strip(F.coalesce(F.col(source), F.lit(""))) != ""
    return rows.filter(filled if force else filled & F.col(target).isNull())


def fill(store: Store, table: str, stored: Stored, source: str, target: str, factory: Callable[[], Callable], run: str, force: bool = False, most_buckets: int | None = None, workers: int = WORKERS, tries: int = 5) -> Progress:
    """Fill ``target`` from ``source``; ``run`` names the work: the same name continues it, ``force`` redoes filled rows once per name.

    ``most_buckets`` ends the call after so many buckets, as a broken run would.
    """
    sent = filled = blank = failed = 0
    at = store.pin()
    folder = lambda bucket: f"{store.root}/_runs/{run}/{table}-{bucket}"
    todo = [b for b in sorted(b for t, b in at.folders if t == table) if not listed(store.spark, f"{folder(b)}/done")][:most_buckets]

    def answered(bucket: int) -> None:
        answers = f"{folder(bucket)}/answers"
        if "_SUCCESS" not in listed(store.spark, answers):
            rows = _pending(store.read(table, store.pin(), stored, [bucket]), source, target, force).select("id", source)
            made = fan_out(rows, F.col(source), factory, "_answer", "_error", workers)
            made.select("id", F.sha2(source, 256).alias("_of"), F.when(strip("_answer") != "", strip("_answer")).alias("_answer"), "_error").write.mode("overwrite").parquet(answers)

    def finished(bucket: int) -> None:
        store.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder(bucket)}/done")

    with ThreadPoolExecutor(max_workers=AT_ONCE) as pool:
        for i in range(0, len(todo), AT_ONCE):
            mine = todo[i : i + AT_ONCE]
            list(pool.map(answered, mine))
            made = store.spark.read.parquet(*(f"{folder(b)}/answers" for b in mine))
            n = made.agg(F.count("*"), F.count("_answer"), F.count("_error")).first()
            at = _published(store, table, stored, source, target, mine, made, force, tries) if n[0] else at
            list(pool.map(finished, mine))
            sent, filled, failed, blank = sent + n[0], filled + n[1], failed + n[2], blank + n[0] - n[1] - n[2]
    return Progress(at, sent, filled, blank, failed, len(todo))


def _published(store: Store, table: str, stored: Stored, source: str, target: str, buckets: list[int], made: DataFrame, force: bool, tries: int) -> Version:
    """The buckets with their answers, and the failures of their rows, in one version."""
    for attempt in range(1, tries + 1):
        now = store.pin()
        rows = store.read(table, now, stored, buckets)
        same = F.col("_of").isNotNull() & F.sha2(source, 256).eqNullSafe(F.col("_of"))
        free = F.lit(True) if force else F.col(target).isNull()
        value = F.when(same & free & F.col("_answer").isNotNull(), F.col("_answer")).otherwise(F.col(target))
        new = rows.join(made.drop("_error"), "id", "left").withColumn(target, value).select(*rows.columns)
        ids = made.select("id")
        mine = store.touched(made, "id")
        name = f"{table}_failure"
        failures = store.read(name, now, FAILURE, mine).join(ids, "id", "left_anti").unionByName(made.filter("_error IS NOT NULL").select("id", F.col("_error").alias("error")))
        try:
            return store.commit(now, store.stage_all({table: (new, stored, buckets), name: (failures, FAILURE, mine)}))
        except Conflict:
            if attempt == tries:
                raise
    raise AssertionError("unreachable")
