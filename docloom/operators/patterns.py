"""Saving extracted patterns into a published store: gates, one pattern per fingerprint, sources and jobs in one commit.

Defined results: candidates without tenant, document or name are refused (``REJECT_INPUT``); documents of the excluded or
of an unknown type give no patterns (``REJECT_TYPE``); candidates of a job that is not the caller's, not running, or
not for the current version of an active document are refused (``REJECT_JOB``).  With ``merge`` the others share one
pattern per tenant and fingerprint: a stored active one if there is one (``ADOPTED``), else a new one that the first
of them in order of document, section and code describes (``INSERTED``, the rest ``MERGED``); patterns of other tenants
and quarantined ones are not touched.  Without ``merge`` each makes a pattern of its own.  A source is stored once per
pattern, document and section.  Jobs of saved candidates are completed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalar import fingerprint
from docloom.operators import lifecycle as lc
from docloom.operators.doctypes import may_have_patterns
from docloom.operators.ids import dense_ids
from docloom.sources import tables as tb
from docloom.sources.publish import Conflict, Staged, Store, Version

REJECT_INPUT, REJECT_TYPE, REJECT_JOB = "REJECT_INPUT", "REJECT_TYPE", "REJECT_JOB"
INSERTED, ADOPTED, MERGED = "INSERTED", "ADOPTED", "MERGED"
_JOB = ["tenant_id", "document_id", "index_version", "owner_id"]
_ORDER = ["document_id", "section_id", "code", "_row"]


class Saved(NamedTuple):
    """(row, tenant_id, document_id, fingerprint, verdict, pattern_id) of every candidate, and the version it is stored in."""

    verdicts: DataFrame
    version: Version
    tries: int


def gated(candidates: DataFrame, jobs: DataFrame, guard: DataFrame) -> DataFrame:
    """Candidates with ``verdict``: why one is refused, else null."""
    mine = lc.current_jobs(jobs, guard).select(*_JOB, F.lit(True).alias("_mine")).distinct()
    named = F.coalesce(F.trim("name"), F.lit("")) != ""
    given = F.col("tenant_id").isNotNull() & F.col("document_id").isNotNull() & named
    verdict = F.when(~given, REJECT_INPUT).when(~F.coalesce(may_have_patterns(F.col("document_type")), F.lit(False)), REJECT_TYPE).when(F.col("_mine").isNull(), REJECT_JOB)
    return candidates.join(mine, _JOB, "left").withColumn("verdict", verdict).drop("_mine")


def save(store: Store, candidates: DataFrame, merge: bool = True, tries: int = 5) -> Saved:
    """Store candidates(tenant_id, document_id, index_version, owner_id, document_type, section_id, code, name, summary, ...).

    They are gated and merged against the newest version; where another writer publishes first, again from there.
    """
    rows = store.keep(candidates.withColumn("fingerprint", fingerprint(F.col("summary"), F.col("name"))).withColumn("_row", F.monotonically_increasing_id()))
    for attempt in range(1, tries + 1):
        now = store.pin()
        decided = store.keep(gated(rows, store.read("job", now, tb.JOB), store.read("guard", now, tb.GUARD)))
        refused = decided.filter("verdict IS NOT NULL").withColumn("pattern_id", F.lit(None).cast("long"))
        good = decided.filter("verdict IS NULL").drop("verdict")
        if good.isEmpty():
            return Saved(_reported(refused), now, attempt)
        known, changes = _merged(store, now, good, merge)
        try:
            return Saved(_reported(refused.unionByName(known)), store.commit(now, changes), attempt)
        except Conflict:
            if attempt == tries:
                raise
    raise AssertionError("unreachable")


def _reported(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_row").alias("row"), "tenant_id", "document_id", "fingerprint", "verdict", "pattern_id")


def _merged(store: Store, now: Version, good: DataFrame, merge: bool) -> tuple[DataFrame, dict[str, Staged]]:
    """Candidates with verdict and pattern_id, and what is to be committed."""
    prints, documents = store.touched(good, "fingerprint"), store.touched(good, "document_id")
    stored = store.read("pattern", now, tb.PATTERN, prints)
    key = ["tenant_id", "fingerprint"] if merge else ["_row"]
    # The first of its key, found by a partial minimum: no list of a frequent fingerprint is ever made.
    first = good.groupBy(*key).agg(F.min(F.struct(*_ORDER)).alias("_first")).select(*key, "_first._row").withColumnRenamed("_row", "_of") if merge else good.select("_row").withColumn("_of", F.col("_row"))
    old = stored.filter("status = 'active'").groupBy("tenant_id", "fingerprint").agg(F.min("id").alias("old_id")) if merge else None
    firsts = first.join(old, key, "left") if merge else first.withColumn("old_id", F.lit(None).cast("long"))
    firsts = store.keep(firsts)
    fresh = good.join(firsts.filter("old_id IS NULL").select(F.col("_of").alias("_row")), "_row", "left_semi")
    numbered, _ = dense_ids(fresh, _ORDER, now.next_ids.get("pattern", 1), store.keep)
    made = numbered.select(F.col("_row").alias("_of"), F.col("id").alias("new_id"))
    ids = firsts.join(made, "_of", "left").select(*key, "_of", "old_id", F.coalesce("old_id", "new_id").alias("pattern_id"))
    verdict = F.when(F.col("old_id").isNotNull(), ADOPTED).when(F.col("_row") == F.col("_of"), INSERTED).otherwise(MERGED)
    known = store.keep(good.join(ids, key).withColumn("verdict", verdict).drop("_of", "old_id"))

    new = tb.fitted(numbered.withColumn("version", F.lit(1)).withColumn("status", F.lit("active")), tb.PATTERN)
    sources = known.groupBy("pattern_id", "document_id", "section_id").agg(F.max("index_version").alias("index_version"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    sources = tb.fitted(sources.withColumn("source_type", F.lit("section")).withColumn("sort_order", F.lit(0)), tb.PATTERN_SOURCE)
    had = store.read("pattern_source", now, tb.PATTERN_SOURCE, documents)
    again = had.select(F.col("pattern_id").alias("_p"), F.col("document_id").alias("_d"), F.col("section_id").alias("_s"))
    same = (F.col("pattern_id") == F.col("_p")) & (F.col("document_id") == F.col("_d")) & F.col("section_id").eqNullSafe(F.col("_s"))
    done = known.select(*_JOB, F.lit(None).cast("string").alias("error")).distinct()
    jobs = lc.finish_jobs(store.read("job", now, tb.JOB, documents), done)
    return known, store.stage_all({
        "pattern": (stored.unionByName(new), tb.PATTERN, prints),
        "pattern_source": (had.unionByName(sources.join(again, same, "left_anti")), tb.PATTERN_SOURCE, documents),
        "job": (jobs, tb.JOB, documents),
    })
