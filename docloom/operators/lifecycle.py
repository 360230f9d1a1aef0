"""The versioned index: decisions, ordered application of requests, tombstones, replacement, jobs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, DELETED, QUARANTINED = "ACTIVE", "DELETED", "QUARANTINED"
LIFECYCLES = (ACTIVE, DELETED, QUARANTINED)
JOB_STATES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "OBSOLETE")
APPLY, IDEMPOTENT, STALE = "APPLY", "IDEMPOTENT", "REJECT_STALE"
REJECT_TENANT, REJECT_DELETED, REJECT_QUARANTINED, VERSION_MISMATCH = "REJECT_TENANT_MISMATCH", "REJECT_DELETED", "REJECT_QUARANTINED", "REJECT_VERSION_MISMATCH"
LEASE_SECONDS = 900
ERROR_CHARS = 1024


def decide(guard_document: Column, guard_tenant: Column, lifecycle: Column, current_version: Column, current_hash: Column, tenant: Column, version: Column, input_hash: Column, ignore_hash: bool = False) -> Column:
    """What to do with a request, by precedence: no guard row applies; then tenant, lifecycle, version, hash."""
    same = F.lit(True) if ignore_hash else current_hash.eqNullSafe(input_hash)
    return (
        F.when(guard_document.isNull(), APPLY)
        .when(guard_tenant != tenant, REJECT_TENANT)
        .when(lifecycle == DELETED, REJECT_DELETED)
        .when(lifecycle != ACTIVE, REJECT_QUARANTINED)
        .when(current_version.isNull(), APPLY)
        .when(version < current_version, STALE)
        .when((version == current_version) & same, IDEMPOTENT)
        .when(version == current_version, VERSION_MISMATCH)
        .otherwise(APPLY)
    )


def decisions(requests: DataFrame, guard: DataFrame, ignore_hash: bool = False, require_existing: bool = False) -> DataFrame:
    """Requests, each against the guard as it is, with the decision."""
    g = guard.select(F.col("document_id").alias("g_document"), F.col("tenant_id").alias("g_tenant"), "lifecycle_status", "current_index_version", "index_input_hash")
    out = requests.join(g, F.col("document_id") == F.col("g_document"), "left")
    verdict = decide(F.col("g_document"), F.col("g_tenant"), F.col("lifecycle_status"), F.col("current_index_version"), F.col("index_input_hash"), F.col("tenant_id"), F.col("index_version"), F.col("input_hash"), ignore_hash)
    if require_existing:
        verdict = F.when(F.col("g_document").isNull(), REJECT_TENANT).otherwise(verdict)
    return out.select(*requests.columns, verdict.alias("decision"))


def fold_requests(state: tuple | None, rows: Iterator[tuple]) -> tuple[tuple | None, list[str]]:
    """Requests (tenant, version, hash, op) of one document in order, each against what the one before left.

    state: (tenant, lifecycle, version, hash) or None.  The rules are those of ``decide``; a DELETE by the
    document's tenant is a tombstone that no later request undoes.
    """
    out = []
    for tenant, version, digest, op in rows:
        if op == "DELETE":
            if state is not None and state[0] != tenant:
                out.append(REJECT_TENANT)
            elif state is not None and state[1] == DELETED:
                out.append(IDEMPOTENT)
            else:
                state = (tenant, DELETED, state[2] if state else None, state[3] if state else None)
                out.append(APPLY)
            continue
        if state is None:
            verdict = APPLY
        elif state[0] != tenant:
            verdict = REJECT_TENANT
        elif state[1] == DELETED:
            verdict = REJECT_DELETED
        elif state[1] != ACTIVE:
            verdict = REJECT_QUARANTINED
        elif state[2] is None or version > state[2]:
            verdict = APPLY
        elif version < state[2]:
            verdict = STALE
        else:
            verdict = IDEMPOTENT if state[3] == digest else VERSION_MISMATCH
        if verdict == APPLY:
            state = (tenant, ACTIVE, version, digest)
        out.append(verdict)
    return state, out


STATE_SCHEMA = "document_id long, tenant_id long, lifecycle_status string, current_index_version long, index_input_hash string, n_applied long, n_requests long"


def apply_in_order(requests: DataFrame, guard: DataFrame | None = None) -> DataFrame:
    """The guard after all requests, in request order per document (a decision depends on the one before).

    Rows of a document are sorted within its partition and folded as they come; none is held as an array.
    """
    cols = ("request_id", "tenant_id", "index_version", "input_hash", "op")
    asked = requests.select("document_id", F.lit(1).alias("kind"), *cols)
    rows = asked
    if guard is not None:
        g = guard.select("document_id", F.lit(0).alias("kind"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), "tenant_id", F.col("current_index_version").alias("index_version"), F.col("index_input_hash").alias("input_hash"), F.col("lifecycle_status").alias("op"))
        rows = g.unionByName(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        applied = total = 0
        for batch in batches:
            done: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("document_id", "kind", "tenant_id", "index_version", "input_hash", "op")]
            # A document without an id has no guard: nulls do not meet.
            for new, of in groupby(zip(*columns, strict=True), lambda r: (r[0], r[1] if r[0] is None else 0)):
                if new != key:
                    if key is not None:
                        done.append((key[0], *(state or (None,) * 4), applied, total))
                    key, state, applied, total = new, None, 0, 0
                for kind, part in groupby(of, lambda r: r[1]):
                    if kind == 0:
                        state = next((r[2], r[5], r[3], r[4]) for r in part)
                        continue
                    state, verdicts = fold_requests(state, (r[2:] for r in part))
                    applied, total = applied + verdicts.count(APPLY), total + len(verdicts)
            if done:
                yield _state_batch(done)
        if key is not None:
            yield _state_batch([(key[0], *(state or (None,) * 4), applied, total)])

    return rows.repartition("document_id").sortWithinPartitions("document_id", "kind", *cols).mapInArrow(run, STATE_SCHEMA)


def _state_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def tombstone(guard: DataFrame, deletes: DataFrame) -> DataFrame:
    """Guard rows with deleted documents set DELETED (version kept) and ``first_time``; other tenants change nothing."""
    d = deletes.select(F.col("document_id").alias("d_document"), F.col("tenant_id").alias("d_tenant")).distinct()
    out = guard.join(d, (F.col("document_id") == F.col("d_document")) & (F.col("tenant_id") == F.col("d_tenant")), "left")
    hit = F.col("d_document").isNotNull()
    return out.select(*(c for c in guard.columns if c != "lifecycle_status"), F.when(hit, DELETED).otherwise(F.col("lifecycle_status")).alias("lifecycle_status"), (hit & (F.col("lifecycle_status") != DELETED)).alias("first_time"))


def purge(patterns: DataFrame, sources: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns, sources) without the sources of deleted documents and without patterns that this leaves bare.

    Patterns that never had a source stay.
    """
    left = sources.join(deleted.select("document_id"), "document_id", "left_anti")
    gone = sources.join(deleted.select("document_id"), "document_id", "left_semi").select("pattern_id").distinct()
    bare = gone.join(left.select("pattern_id"), "pattern_id", "left_anti").select(F.col("pattern_id").alias("id"))
    return patterns.join(bare, "id", "left_anti"), left


def replace_rows(current: DataFrame, staged: DataFrame, key: str = "document_id") -> DataFrame:
    """Staged rows in place of all rows of their documents."""
    return current.join(staged.select(key).distinct(), key, "left_anti").unionByName(staged)


def upsert(current: DataFrame, changes: DataFrame, key: str, keep: tuple[str, ...] = (), adopt: tuple[str, ...] = ()) -> DataFrame:
    """Merge by key: ``keep`` columns only change to values, ``adopt`` columns only while null, all others are overwritten."""
    new = changes.select(*(F.col(c).alias(f"n_{c}") for c in changes.columns))
    both = current.join(new, F.col(key) == F.col(f"n_{key}"), "full_outer")
    changed = F.col(f"n_{key}").isNotNull()

    def column(c: str) -> Column:
        n = F.col(f"n_{c}")
        if c == key or c in keep:
            return F.coalesce(n, F.col(c)).alias(c)
        if c in adopt:
            return F.coalesce(F.col(c), n).alias(c)
        return F.when(changed, n).otherwise(F.col(c)).alias(c)

    return both.select(*map(column, current.columns))


def claim_jobs(claims: DataFrame, jobs: DataFrame) -> DataFrame:
    """One winner per job key among claims (tenant_id, document_id, index_version, owner_id, now) with the reason.

    A completed job, or one that runs elsewhere with a lease that has not ended, is not to be had.
    """
    key = ["tenant_id", "document_id", "index_version"]
    first = claims.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("now", "owner_id"))).filter("_n = 1").drop("_n")
    j = jobs.select(*key, "state", F.col("owner_id").alias("held_by"), "expires_at")
    out = first.join(j, key, "left")
    verdict = (
        F.when(F.col("state").isNull(), "NEW")
        .when(F.col("state") == "COMPLETED", "COMPLETED")
        .when((F.col("state") == "RUNNING") & (F.col("held_by") != F.col("owner_id")) & (F.col("expires_at") > F.col("now")), "HELD")
        .otherwise("TAKEN_OVER")
    )
    got = verdict.isin("NEW", "TAKEN_OVER")
    lease = F.col("now") + F.expr(f"INTERVAL {LEASE_SECONDS} SECONDS")
    return out.select(*key, "owner_id", verdict.alias("verdict"), got.alias("claimed"), F.when(got, lease).alias("expires_at"))


def current_jobs(jobs: DataFrame, guard: DataFrame) -> DataFrame:
    """Running jobs that still stand for the current version of an active document of their tenant."""
    g = guard.filter(F.col("lifecycle_status") == ACTIVE).select("document_id", "tenant_id", F.col("current_index_version").alias("index_version"))
    return jobs.filter("state = 'RUNNING'").join(g, ["document_id", "tenant_id", "index_version"], "left_semi")


def obsolete_jobs(jobs: DataFrame, guard: DataFrame) -> DataFrame:
    """Jobs below the current version, or of deleted documents, that are not finished become OBSOLETE."""
    g = guard.select(F.col("document_id").alias("g_document"), F.col("current_index_version").alias("g_version"), "lifecycle_status")
    out = jobs.join(g, F.col("document_id") == F.col("g_document"), "left")
    old = F.coalesce(F.col("index_version") < F.col("g_version"), F.lit(False)) & ~F.col("state").isin("COMPLETED", "OBSOLETE")
    dead = F.coalesce(F.col("lifecycle_status") == DELETED, F.lit(False)) & F.col("state").isin("PENDING", "RUNNING")
    return out.withColumn("state", F.when(old | dead, "OBSOLETE").otherwise(F.col("state"))).select(*jobs.columns)


def finish_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs of done(tenant_id, document_id, index_version, owner_id, error): COMPLETED, or FAILED with the error cut."""
    key = ["tenant_id", "document_id", "index_version", "owner_id"]
    d = done.select(*key, F.col("error").alias("_error"), F.lit(True).alias("_done"))
    out = jobs.join(d, key, "left")
    mine = F.coalesce("_done", F.lit(False)) & (F.col("state") == "RUNNING")
    state = F.when(mine & F.col("_error").isNull(), "COMPLETED").when(mine, "FAILED").otherwise(F.col("state"))
    return out.withColumn("error_message", F.when(mine, F.left("_error", F.lit(ERROR_CHARS))).otherwise(F.col("error_message"))).withColumn("state", state).select(*jobs.columns)


def checked(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows as they are; a value outside the allowed ones fails the write."""
    return rows.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{column} not allowed: "), F.coalesce(F.col(column), F.lit("null"))))))
