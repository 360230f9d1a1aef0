"""The published store: conflicts, checks, dense ids, ingest in phases, saved patterns."""

from __future__ import annotations

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from docloom.operators import ids
from docloom.operators import ingest as ig
from docloom.operators import lifecycle as lc
from docloom.operators import patterns as pt
from docloom.plans.stored import cross_check_embedder
from docloom.sources import tables as tb
from docloom.sources.publish import Conflict, Store, Violation, create_if_absent, listed

REQUEST = "request_id long, document_id long, tenant_id long, index_version long, input_hash string, document_type string"
SECTION = "document_id long, id int, parent_id int, title string, level int"
CHUNK = "document_id long, section_id int, chunk_index int, content string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), 3)


def parts(spark, *documents, text="text"):
    sections = [(d, s, None if s == 0 else 0, f"s{s}", 1) for d in documents for s in range(3)]
    chunks = [(d, n % 3, n, f"{text} {d} {n}") for d in documents for n in range(4)]
    return spark.createDataFrame(sections, SECTION), spark.createDataFrame(chunks, CHUNK)


def ask(spark, *rows):
    return spark.createDataFrame([(n, d, 1, version, digest, "regulation") for n, (d, version, digest) in enumerate(rows)], REQUEST)


def held(store, table):
    return sorted(tuple(r) for r in store.read(table, store.pin(), tb.TABLES[table]).collect())


def verdicts(done):
    return {r.document_id: r.decision for r in done.decisions.collect()}


def test_a_file_is_created_once(spark, tmp_path):
    path = str(tmp_path / "a/b.json")
    assert create_if_absent(spark, path, "one") and not create_if_absent(spark, path, "two")
    assert open(path).read() == "one"
    assert [n for n in listed(spark, str(tmp_path / "a")) if not n.startswith(".")] == ["b.json"]


def test_of_two_writers_from_one_version_one_loses(spark, store):
    base = store.publish({"guard": spark.createDataFrame([(1, 1, "ACTIVE", 1, "h")], tb.GUARD.schema)}, tb.TABLES)
    rows = [spark.createDataFrame([(1, 1, "ACTIVE", n, "h")], tb.GUARD.schema) for n in (2, 3)]
    staged = [store.stage("guard", r, tb.GUARD) for r in rows]
    made, lost = [], []

    def commit(s):
        try:
            made.append(store.commit(base, {"guard": s}))
        except Conflict as e:
            lost.append(e)

    threads = [threading.Thread(target=commit, args=(s,)) for s in staged]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(made) == len(lost) == 1 and store.pin().number == 2
    assert held(store, "guard")[0][3] in (2, 3)
    assert store.read("guard", base, tb.GUARD).first().current_index_version == 1


def test_rows_that_break_a_check_publish_nothing(spark, store):
    good = spark.createDataFrame([(1, 1, "ACTIVE", 1, "h")], tb.GUARD.schema)
    store.publish({"guard": good}, tb.TABLES)
    bad = spark.createDataFrame([(2, None, "ACTIVE", 1, "h"), (3, 1, "LOST", 1, "h"), (4, 1, "ACTIVE", 1, None), (5, 1, "ACTIVE", 1, "h"), (6, 1, None, None, None)], tb.GUARD.schema)
    with pytest.raises(Violation) as e:
        store.publish({"guard": bad}, tb.TABLES)
    assert e.value.broken == {"tenant_id_given": 1, "lifecycle": 2, "version_has_hash": 1}
    quarantined = spark.read.parquet(e.value.folder).filter("_check <> 'ok'")
    assert {(r.document_id, r._check) for r in quarantined.collect()} == {(2, "tenant_id_given"), (3, "lifecycle"), (4, "version_has_hash"), (6, "lifecycle")}
    with pytest.raises(Violation) as e:
        store.publish({"guard": good.union(good)}, tb.TABLES)
    assert e.value.broken == {"key": 1}
    assert store.pin().number == 1 and len(held(store, "guard")) == 1


def test_a_change_rewrites_the_buckets_it_touches(spark, store):
    guard = spark.createDataFrame([(i, 1, "ACTIVE", 1, "h") for i in range(40)], tb.GUARD.schema)
    first = store.publish({"guard": guard}, tb.TABLES)
    one = spark.createDataFrame([(7, 1, "DELETED", 1, "h")], tb.GUARD.schema)
    touched = store.touched(one, "document_id")
    rows = lc.replace_rows(store.read("guard", first, tb.GUARD, touched), one)
    second = store.commit(first, {"guard": store.stage("guard", rows, tb.GUARD, touched)})
    assert len(touched) == 1 and sum(first.folders[k] != second.folders[k] for k in first.folders) == 1
    assert {r[0]: r[2] for r in held(store, "guard")} == {i: "DELETED" if i == 7 else "ACTIVE" for i in range(40)}


@pytest.mark.parametrize("parallel", [1, 7])
def test_ids_are_dense_and_the_same_under_any_partitioning(spark, store, parallel):
    rows = spark.createDataFrame([(d, p) for d in (3, 1, 2) for p in range(50 if d == 2 else 4)] + [(9, 0)], "d long, p int").repartition(parallel)
    spark.conf.set("spark.sql.shuffle.partitions", str(parallel + 1))
    try:
        numbered, after = ids.dense_ids(rows, ["d", "p"], 100, store.keep)
        got = [(r.d, r.p, r.id) for r in numbered.orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [g[2] for g in got] == list(range(100, 159)) and after == 159
    assert [g[:2] for g in got] == sorted(g[:2] for g in got)
    none, after = ids.dense_ids(rows.limit(0), ["d", "p"], 5, store.keep)
    assert none.count() == 0 and after == 5


def test_first_ingest_gives_ids_from_one_in_preorder(spark, store):
    done = ig.ingest_in_phases(store, ask(spark, (2, 1, "h"), (1, 1, "h")), *parts(spark, 1, 2), cross_check_embedder(), 4)
    assert verdicts(done) == {1: "APPLY", 2: "APPLY"} and done.tries == 1
    sections = store.read("section", store.pin(), tb.SECTION).orderBy("id").collect()
    assert [(r.id, r.document_id, r.parent_id, r.sort_order, r.index_version) for r in sections] == [(1, 1, None, 0, 1), (2, 1, 1, 1, 1), (3, 1, 1, 2, 1), (4, 2, None, 0, 1), (5, 2, 4, 1, 1), (6, 2, 4, 2, 1)]
    chunks = store.read("chunk", store.pin(), tb.CHUNK).orderBy("id").collect()
    assert [(r.id, r.document_id, r.section_id, r.chunk_index) for r in chunks] == [(4 * k + n + 1, k + 1, 3 * k + n % 3 + 1, n) for k in range(2) for n in range(4)]
    assert all(len(r.embedding) == 4 and r.tenant_id == 1 and r.document_type == "regulation" for r in chunks)
    assert [(r[0], r[9], r[10]) for r in held(store, "document")] == [(1, "regulation", "embedded"), (2, "regulation", "embedded")]


def test_the_stale_one_of_two_interleaved_ingests_leaves_no_row(spark, store):
    new, old = ig.begin(store, ask(spark, (1, 2, "new"))), ig.begin(store, ask(spark, (1, 1, "old")))
    old = ig.embed_parts(store, old, *parts(spark, 1, text="old"), cross_check_embedder(), 4)
    assert verdicts(ig.finish(store, ig.embed_parts(store, new, *parts(spark, 1, text="new"), cross_check_embedder(), 4))) == {1: "APPLY"}
    before = store.pin()
    assert verdicts(ig.finish(store, old)) == {1: lc.STALE}
    assert store.pin() == before
    assert all(r.content.startswith("new") for r in store.read("chunk", before, tb.CHUNK).collect())


def test_a_writer_that_loses_the_commit_decides_again(spark, store, monkeypatch):
    mine = ig.embed_parts(store, ig.begin(store, ask(spark, (1, 2, "h"), (2, 1, "h"))), *parts(spark, 1, 2), cross_check_embedder(), 4)
    plain, met = Store.commit, []

    def racing(self, base, changes):
        if not met:  # another writer publishes a higher version of document 1 between our check and our commit
            met.append(True)
            ig.ingest_in_phases(self, ask(spark, (1, 3, "other")), *parts(spark, 1, text="other"), cross_check_embedder(), 4)
        return plain(self, base, changes)

    monkeypatch.setattr(Store, "commit", racing)
    done = ig.finish(store, mine)
    assert done.tries == 2 and verdicts(done) == {1: lc.STALE, 2: "APPLY"}
    texts = {r.document_id: r.content[:5] for r in store.read("chunk", store.pin(), tb.CHUNK).collect()}
    assert texts == {1: "other", 2: "text "}
    numbers = sorted(r[0] for r in held(store, "section"))
    assert numbers == list(range(1, 7))


def test_one_wrong_vector_rejects_its_document(spark, store):
    sections, chunks = parts(spark, 1, 2)
    chunks = chunks.union(spark.createDataFrame([(2, 0, 9, "a@b")], CHUNK))
    done = ig.ingest_in_phases(store, ask(spark, (1, 1, "h"), (2, 1, "h")), sections, chunks, cross_check_embedder(), 4)
    assert verdicts(done) == {1: "APPLY", 2: ig.REJECT_VECTORS}
    assert {r[4] for r in held(store, "chunk")} == {1} and [r[0] for r in held(store, "guard")] == [1]
    again = ig.ingest_in_phases(store, ask(spark, (1, 1, "h"), (2, 1, "h")), sections, chunks.filter("content <> 'a@b'"), cross_check_embedder(), 4)
    assert verdicts(again) == {1: lc.IDEMPOTENT, 2: "APPLY"}


def test_a_guard_that_went_meanwhile_rejects(spark, store):
    store.publish({"guard": spark.createDataFrame([(1, 1, "ACTIVE", 1, "h")], tb.GUARD.schema)}, tb.TABLES)
    mine = ig.embed_parts(store, ig.begin(store, ask(spark, (1, 2, "h"))), *parts(spark, 1), cross_check_embedder(), 4)
    store.publish({"guard": spark.createDataFrame([], tb.GUARD.schema)}, tb.TABLES)
    assert verdicts(ig.finish(store, mine)) == {1: lc.REJECT_TENANT}


CANDIDATE = "tenant_id long, document_id long, index_version long, owner_id string, document_type string, section_id long, code string, name string, summary string, page_start int, page_end int"


def pattern_store(spark, store):
    guard = [(d, d % 2 + 1, "ACTIVE", 1, "h") for d in range(1, 9)]
    jobs = [(d % 2 + 1, d, 1, "h", "RUNNING", "w", None, None) for d in range(1, 9)]
    old = [(5, 1, "old", sha("shared"), "active"), (6, 2, "old", sha("two"), "quarantined")]
    pattern = spark.createDataFrame(old, "id long, tenant_id long, name string, fingerprint string, status string")
    store.publish({"guard": spark.createDataFrame(guard, tb.GUARD.schema), "job": spark.createDataFrame(jobs, tb.JOB.schema), "pattern": tb.fitted(pattern, tb.PATTERN)}, tb.TABLES)


def sha(text):
    return hashlib.sha1(text.encode()).hexdigest()


def candidate(document, section, summary, owner="w", kind="regulation", name="n", version=1, tenant=None):
    return (tenant or document % 2 + 1, document, version, owner, kind, section, "SP", name, summary, 1, 2)


def test_pattern_save(spark, store):
    pattern_store(spark, store)
    rows = [candidate(2, s, "shared") for s in (1, 2, 2)] + [candidate(4, 1, "new"), candidate(2, 9, " new "), candidate(4, 1, "new")]
    rows += [candidate(1, 1, "shared"), candidate(3, 1, "two"), candidate(5, 1, "", name="shared")]
    rows += [candidate(6, 1, "x", owner="other"), candidate(6, 1, "x", kind="tender"), candidate(6, 1, "x", kind="?"), candidate(6, 1, "x", name=" "), candidate(6, 1, "x", version=2), candidate(6, 1, "x", tenant=2), candidate(8, None, "bare")]
    done = pt.save(store, spark.createDataFrame(rows, CANDIDATE))
    got = sorted((r.tenant_id, r.document_id, r.fingerprint[:4], r.verdict, r.pattern_id or 0) for r in done.verdicts.collect())
    a, n, t, b, x = (sha(s)[:4] for s in ("shared", "new", "two", "bare", "x"))
    assert [g for g in got if not g[3].startswith("REJECT")] == sorted(
        [(1, 2, a, "ADOPTED", 5)] * 3 + [(1, 2, n, "INSERTED", 8), (1, 4, n, "MERGED", 8), (1, 4, n, "MERGED", 8), (2, 1, a, "INSERTED", 7), (2, 5, a, "MERGED", 7), (2, 3, t, "INSERTED", 9), (1, 8, b, "INSERTED", 10)]
    )
    assert sorted(g[3] for g in got if g[3].startswith("REJECT")) == ["REJECT_INPUT", "REJECT_JOB", "REJECT_JOB", "REJECT_JOB", "REJECT_TYPE", "REJECT_TYPE"] and x
    assert {(r[0], r[1], r[13]) for r in map(tuple, store.read("pattern", store.pin(), tb.PATTERN).collect())} == {(5, 1, "active"), (6, 2, "quarantined"), (7, 2, "active"), (8, 1, "active"), (9, 2, "active"), (10, 1, "active")}
    sources = sorted(((r.pattern_id, r.document_id, r.section_id) for r in store.read("pattern_source", store.pin(), tb.PATTERN_SOURCE).collect()), key=repr)
    assert sources == sorted([(5, 2, 1), (5, 2, 2), (8, 2, 9), (8, 4, 1), (7, 1, 1), (7, 5, 1), (9, 3, 1), (10, 8, None)], key=repr)
    jobs = {r.document_id: r.state for r in store.read("job", store.pin(), tb.JOB).collect()}
    assert jobs == {d: "COMPLETED" if d in (1, 2, 3, 4, 5, 8) else "RUNNING" for d in range(1, 9)}
    again = pt.save(store, spark.createDataFrame(rows, CANDIDATE))
    assert {r.verdict for r in again.verdicts.collect()} <= {"REJECT_JOB", "REJECT_TYPE", "REJECT_INPUT"} and again.version == done.version


def test_pattern_save_without_merging(spark, store):
    pattern_store(spark, store)
    done = pt.save(store, spark.createDataFrame([candidate(2, s, "shared") for s in (2, 1, 1)], CANDIDATE), merge=False)
    assert sorted((r.verdict, r.pattern_id) for r in done.verdicts.collect()) == [("INSERTED", 7), ("INSERTED", 8), ("INSERTED", 9)]
    assert store.read("pattern_source", store.pin(), tb.PATTERN_SOURCE).count() == 3


def test_added_columns_are_null(spark):
    rows = tb.fitted(spark.createDataFrame([(1, "x")], "document_id int, more string"), tb.GUARD)
    assert rows.columns == [c.split()[0] for c in tb.GUARD.schema.split(", ")] and rows.filter(F.col("tenant_id").isNull()).count() == 1
