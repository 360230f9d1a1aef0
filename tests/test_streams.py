"""Streams that isolate failures, remember embeddings and end leases."""

from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from docloom.streaming import leases, memory, tasks


def failing(batch):
    return batch.withColumn("n", F.when(F.col("payload") == "poison", F.raise_error(F.lit("bad payload")).cast("int")).otherwise(F.length("payload")))


def send(spark, path, rows):
    spark.createDataFrame(rows, tasks.MESSAGE).coalesce(1).write.parquet(str(path))


def run(spark, tmp_path, queues, **options):
    stream = spark.readStream.schema(tasks.MESSAGE).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = tasks.run_queues(stream, queues, str(tmp_path / "out"), str(tmp_path / "log"), **options)
    query.awaitTermination()
    return query


def test_one_poison_message_is_rejected_alone(spark, tmp_path):
    rows = [("a", i, "poison" if i == 777 else f"p{i}") for i in range(2000)] + [("b", 1, "x"), ("c", 1, "x"), ("a", None, "x"), ("a", 5, None)]
    send(spark, tmp_path / "in/1", rows)
    run(spark, tmp_path, {"a": failing, "b": lambda b: b})
    got = sorted(r.document_id for r in tasks.results(spark, str(tmp_path / "out"), "a").collect())
    assert got == [i for i in range(2000) if i != 777]
    bad = {(r.document_id, r.payload): r.error for r in spark.read.parquet(str(tmp_path / "out/_rejected")).collect()}
    assert set(bad) == {(777, "poison"), (1, "x"), (None, "x"), (5, None)}
    assert "bad payload" in bad[777, "poison"] and bad[1, "x"] == "no such queue"
    assert tasks.results(spark, str(tmp_path / "out"), "b").count() == 1


def test_equal_messages_stay_apart(spark, tmp_path):
    send(spark, tmp_path / "in/1", [("a", 1, "poison")] * 3 + [("a", 1, "fine")] * 4)
    run(spark, tmp_path, {"a": failing})
    assert tasks.results(spark, str(tmp_path / "out"), "a").count() == 4
    assert spark.read.parquet(str(tmp_path / "out/_rejected")).count() == 3


@pytest.mark.parametrize("n,limit", [(5, 100), (9, 3)], ids=["all fail", "too many fail"])
def test_a_broken_handler_stops_the_stream_and_loses_nothing(spark, tmp_path, n, limit):
    send(spark, tmp_path / "in/1", [("a", i, "poison") for i in range(n)] + ([("a", 99, "fine")] if limit < n else []))
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path, {"a": failing}, max_poison=limit)
    run(spark, tmp_path, {"a": lambda b: b})
    assert tasks.results(spark, str(tmp_path / "out"), "a").count() == n + (limit < n)
    assert spark.read.parquet(str(tmp_path / "out/_rejected")).count() == 0


def test_handlers_may_tell_failed_rows(spark, tmp_path):
    send(spark, tmp_path / "in/1", [("a", i, str(i)) for i in range(10)])
    run(spark, tmp_path, {"a": lambda b: b.withColumn("_error", F.when(F.col("document_id") % 5 == 0, "fifth"))})
    assert tasks.results(spark, str(tmp_path / "out"), "a").count() == 8
    assert sorted((r.document_id, r.error) for r in spark.read.parquet(str(tmp_path / "out/_rejected")).collect()) == [(0, "fifth"), (5, "fifth")]


def counting_embedder(log: str):
    def factory():
        import uuid

        def model(texts):
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(t.encode().hex() + "." for t in texts))
            return [[float(len(t)), float(sum(map(ord, t)) % 97)] for t in texts]

        return model

    return factory


def test_texts_are_embedded_once_over_batches_and_restarts(spark, tmp_path):
    own = memory.keyed_state(spark)
    log = tmp_path / "calls"
    log.mkdir()
    sent: list[tuple] = []

    def send_rows(n, rows):
        sent.extend(rows)
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    def embed():
        stream = own.readStream.schema("id long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        made = memory.embed_stream(stream, "text", counting_embedder(str(log)), buckets=3, batch=4)
        query = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return len(query.recentProgress)

    send_rows(1, [(i, f"text {i % 7}") for i in range(30)] + [(100, None), (101, "  "), (102, " text 1 ")])
    send_rows(2, [(i, f"text {i % 11}") for i in range(200, 230)])
    assert embed() >= 2
    send_rows(3, [(i, f"text {i % 13}") for i in range(300, 340)] + [(400, "")])
    embed()
    calls = [bytes.fromhex(x[:-1]).decode() for f in log.iterdir() for x in f.read_text().split("\n")]
    assert sorted(calls) == sorted({(t or "").strip() for _, t in sent})
    got = {r.id: list(r.embedding) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: [float(len((t or "").strip())), float(sum(map(ord, (t or "").strip())) % 97)] for i, t in sent}


def plain_jobs(events, lease, clock):
    """By job, second by second: an own telling of the same rules."""
    out = []
    for key, group in itertools.groupby(sorted(events), key=lambda e: e[:3]):
        state, owner, ends = "PENDING", None, None
        for at, kind, who in sorted((e[5], e[3], e[4]) for e in group):
            if state == "RUNNING" and ends <= at:
                out.append((*key, "PENDING", None, ends))
                state = "PENDING"
            if kind == "CLAIM" and (state in ("PENDING", "FAILED") or (state == "RUNNING" and owner == who)):
                state, owner, ends = "RUNNING", who, at + lease
                out.append((*key, "RUNNING", who, at))
            elif kind == "CLAIM":
                out.append((*key, "HELD", who, at))
            elif state == "RUNNING" and owner == who:
                state = {"DONE": "COMPLETED", "FAIL": "FAILED"}[kind]
                out.append((*key, state, who, at))
        if state == "RUNNING" and ends <= clock:
            out.append((*key, "PENDING", None, ends))
    return sorted(map(repr, out))


def test_leases_end_without_a_message(spark, tmp_path):
    own = memory.keyed_state(spark)
    rng, start, lease = random.Random(4), datetime(2024, 1, 1), timedelta(seconds=60)
    events, now = [], start
    schema = "tenant_id long, document_id long, index_version long, kind string, owner_id string, at timestamp"
    for n in range(6):
        batch = []
        for _ in range(25):
            now += timedelta(seconds=rng.randint(1, 12))
            batch.append((1, rng.randint(1, 8), 1, rng.choice(["CLAIM", "CLAIM", "CLAIM", "DONE", "FAIL"]), rng.choice("xy"), now))
        events += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = own.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    query = leases.lease_stream(stream, 60).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = sorted(repr(tuple(r)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == plain_jobs(events, lease, now)
    assert sum("'PENDING'" in r for r in got) > 3


def test_events_of_a_frame_are_read_at_once(monkeypatch):
    import pandas as pd

    class Job:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    class Handle:
        getValueState = lambda self, *a: Job()  # noqa: E731, N815
        registerTimer = deleteTimer = lambda self, ms: None  # noqa: E731, N815

    frame = pd.DataFrame({"at": pd.to_datetime(["2024-01-01 00:00:00.0019", "2024-01-01 00:00:01"], format="ISO8601"), "kind": ["CLAIM", "CLAIM"], "owner_id": [None, "w"]})
    kept = leases._Leases(60)
    kept.init(Handle())
    monkeypatch.setattr(leases.pd, "Timestamp", None)
    out = pd.concat(kept.handleInputRows((1, 2, 3), iter([frame]), None))
    monkeypatch.undo()
    assert out["state"].tolist() == ["RUNNING", "HELD"] and out["owner_id"].tolist() == [None, "w"]
    assert out["at"].tolist() == [pd.Timestamp("2024-01-01 00:00:00.001"), pd.Timestamp("2024-01-01 00:00:01")]


class StateOfOneKey(dict):
    """A map state in memory that counts what it is asked."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def iterator(self):
        self.calls += 1
        return iter(self.items())


@pytest.mark.parametrize("segment", [memory.SEGMENT, 3], ids=["as it is", "small segments"])
def test_memory_is_not_asked_text_by_text(monkeypatch, segment):
    import hashlib

    import pandas as pd

    monkeypatch.setattr(memory, "SEGMENT", segment)
    states: dict[str, StateOfOneKey] = {}
    calls: list[str] = []

    class Handle:
        getMapState = lambda self, name, *a: states.setdefault(name, StateOfOneKey())  # noqa: E731, N815

    def model(texts):
        calls.extend(texts)
        return [[float(t), *[0.5] * (int(t) % 3)] for t in texts]

    def frames(*parts):
        for part in parts:
            yield pd.DataFrame({"c0": list(part), "plain": [str(i) for i in part], "digest": [hashlib.sha256(str(i).encode()).digest() for i in part], "page": 1})

    got = []
    for batch in ([range(1500), range(1000, 2500)], [[7], [2500, 7, 2500]], [range(3000)]):
        kept = memory._Remembering(lambda: model, f"packed-{segment}", 32)
        kept.init(Handle())
        got += [(i, list(v)) for out in kept.handleInputRows((1,), frames(*batch), None) for i, v in zip(out["c0"], out["embedding"], strict=True)]
    assert sorted(calls, key=int) == [str(i) for i in range(3000)]
    assert len(got) == 6004 and all(v == [float(i), *[0.5] * (i % 3)] for i, v in got)
    assert sum(s.calls for s in states.values()) < 10 * 3000 / segment
