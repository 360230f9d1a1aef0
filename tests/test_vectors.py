"""Many vector queries by blocks, and BM25, against plain loops."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import retrieval as rt
from docloom.operators import vectors


def plain(rows: dict, queries: dict, k: int) -> dict:
    def unit(v):
        if v is None or len(v) != 4 or any(x is None for x in v):
            return None
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else None

    own = {i: u for i, v in rows.items() if (u := unit(v))}
    out = {}
    for q, v in queries.items():
        if u := unit(v):
            scored = sorted((-round(sum(a * b for a, b in zip(u, w, strict=True)), 6), i) for i, w in own.items())
            out[q] = [(i, -s + 0.0) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("query_bytes", [1 << 20, 8 * 4 * 5], ids=["one pass", "several passes"])
def test_many_queries_equal_a_plain_search(spark, query_bytes, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(2)
    grid = rng.integers(-2, 3, (200, 4)).astype(float).tolist()  # many ties and zero vectors
    rows = {i: v for i, v in enumerate(grid)} | {900: None, 901: [1.0, 2.0], 902: [None, 1.0, 1.0, 1.0]}
    queries = {i: v for i, v in enumerate(rng.integers(-2, 3, (17, 4)).astype(float).tolist())} | {50: None, 51: [0.0] * 4, 52: [1.0]}
    df = spark.createDataFrame(list(rows.items()), "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, query array<float>")
    got: dict = {}
    for r in vectors.search_many(df, asked, 4, 5, query_bytes).collect():
        got.setdefault(r.query_id, []).append((r.id, r.similarity + 0.0))
    assert {q: sorted(v, key=lambda x: (-x[1], x[0])) for q, v in got.items()} == plain(rows, queries, 5)
    assert vectors.search_many(df.limit(0), asked, 4, 5).count() == 0 and vectors.search_many(df, asked.limit(0), 4, 5).count() == 0


def test_bm25_equals_plain_formula(spark):
    texts = ["The cat sat.", "the the CAT", "", None, "a dog, a cat; the end", "nothing here", "Été the été"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    query = ["The", "cat", "été", "the"]
    got = {r.id: r.score for r in rt.rerank(df, F.col("content"), rt.bm25(df, "content", query), 99).collect()}
    listed = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    mean = sum(map(len, listed)) / len(listed)
    for i, words in enumerate(listed):
        total = 0.0
        for w in ("the", "cat", "été"):
            d = sum(w in x for x in listed)
            n = Counter(words)[w]
            total += math.log(1 + (len(texts) - d + 0.5) / (d + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words) / mean))
        assert got[i] == pytest.approx(total, abs=1e-6)
    assert rt.rerank(df.limit(0), F.col("content"), rt.bm25(df.limit(0), "content", query), 9).count() == 0


def test_a_task_holds_what_its_queries_keep():
    import tracemalloc

    rng = np.random.default_rng(3)
    queries, rows = rng.normal(size=(20_000, 4)), rng.normal(size=(4096, 4))
    best = vectors._Best(queries, 10)
    tracemalloc.start()
    for at in range(0, len(rows), 512):
        best.add(np.arange(at, at + 512), rows[at : at + 512])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(q) for q, _, _ in best.blocks()) == 200_000
    assert peak < 60 << 20
