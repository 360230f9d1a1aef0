"""Operator 2: levels of calls that use later ones, against plain peeling; long chains in few jobs; no tables left behind."""

from __future__ import annotations

import random
import uuid

import pytest

from docloom.llm import common, tool_chat


def peeled(uses: dict) -> dict:
    """level by call, None on and above cycles."""
    level, open_ = {}, {c: set(d) for c, d in uses.items()}
    k = 0
    while free := [c for c, d in open_.items() if not d & set(open_)]:
        for c in free:
            level[c] = k
        for c in free:
            del open_[c]
        k += 1
    return level | dict.fromkeys(open_)


def found(spark, convs: dict) -> dict:
    ids = spark.createDataFrame([(conv, c) for conv, uses in convs.items() for c in uses], "conv_id string, call_id string")
    edges = spark.createDataFrame([(conv, c, d) for conv, uses in convs.items() for c, deps in uses.items() for d in deps], "conv_id string, call_id string, dep string")
    rows = tool_chat._topological_levels(common.materialise(ids, "t"), common.materialise(edges, "t")).collect()
    assert all(r.cyclic == (r.level is None) for r in rows)
    return {(r.conv_id, r.call_id): r.level for r in rows}


def test_levels_equal_peeling(spark):
    rng = random.Random(7)
    convs = {}
    for n in range(12):
        names = [f"c{i}" for i in range(rng.randint(1, 14))]
        dense = n % 3
        convs[f"v{n}"] = {c: {rng.choice(names[i + 1 :] if n % 4 else names) for _ in range(rng.choice((1, 1, 1 + dense)))} if names[i + 1 :] else set() for i, c in enumerate(names)}
    convs["ring"] = {"a": {"b"}, "b": {"c"}, "c": {"a"}, "d": {"a"}, "e": {"d", "f"}, "f": set(), "self": {"self"}}
    assert found(spark, convs) == {(v, c): level for v, uses in convs.items() for c, level in peeled(uses).items()}


@pytest.mark.parametrize("n", [200])
def test_a_long_chain_takes_few_jobs_and_leaves_one_table(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(common, "work_path", lambda spark, tag: f"{tmp_path}/{tag}-{uuid.uuid4().hex}")
    uses = {f"c{i}": {f"c{i + 1}"} if i < n else set() for i in range(n + 1)}
    tracker = spark.sparkContext
    tracker.setJobGroup("chain", "chain")
    got = found(spark, {"v": uses})
    jobs = len(tracker.statusTracker().getJobIdsForGroup("chain"))
    tracker.setLocalProperty("spark.jobGroup.id", None)
    assert got == {("v", f"c{i}"): n - i for i in range(n + 1)}
    assert jobs <= 80 and {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"t", "chat-levels"}
