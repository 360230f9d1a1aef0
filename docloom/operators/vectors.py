"""Many nearest-neighbour queries at once: blocks of vectors times blocks of queries, the best of each task kept.

Queries are sent to the tasks ``QUERY_BYTES`` at a time; a larger set makes further passes over the vectors.  A task
multiplies a batch of unit vectors with blocks of queries and keeps, per query, what is among its k best so far, so that
a pass shuffles at most k rows per query and task.  No pair of a vector and a query is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BYTES = 32 << 20
QUERY_BLOCK = 512
#: Vectors that are multiplied at once.
VECTOR_BLOCK = 512
DECIMALS = 6


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one."""
    length = np.sqrt((rows * rows).sum(1))
    fine = np.isfinite(length) & (length > 0)
    return rows / np.where(fine, length, 1)[:, None], fine


class _Best:
    """Per query the k nearest so far: by similarity (rounded), then id.  What is held grows with queries times k alone."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries), -np.inf)
        #: For each block of queries: query, id and value of what is held.
        self.held = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(queries), QUERY_BLOCK)]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for b in range(len(self.held)):
            part = slice(b * QUERY_BLOCK, (b + 1) * QUERY_BLOCK)
            value = vectors @ self.queries[part].T
            np.round(value, DECIMALS, out=value)
            row, column = np.nonzero(value >= self.floor[part])
            if len(row):
                self.settle(b, column, ids[row], value[row, column])

    def settle(self, b: int, *more: np.ndarray) -> None:
        """The block's hits go in or out at once."""
        query, ids, value = (np.concatenate(x) for x in zip(self.held[b], more, strict=True))
        order = np.lexsort((ids, -value, query))
        query, ids, value = query[order], ids[order], value[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < self.k
        last = place == self.k - 1
        self.floor[b * QUERY_BLOCK + query[last]] = value[last]
        self.held[b] = (query[best].astype(np.int32), ids[best], value[best])

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the query, id, value), a block of queries at a time."""
        for b, (query, ids, value) in enumerate(self.held):
            yield b * QUERY_BLOCK + query.astype(np.int64), ids, value


def _pass(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    """(query_id, id, similarity) of each task's k best."""
    sent = rows.sparkSession.sparkContext.broadcast((queries, ids))
    width = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, names = sent.value
        best = _Best(matrix, k)
        for batch in batches:
            for at in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(at, VECTOR_BLOCK)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                units, fine = _units(flat)
                best.add(part.column(0).to_numpy()[fine], units[fine])
        for query, ids, value in best.blocks():
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(ids), pa.array(value)], ["query_id", "id", "similarity"])

    return rows.mapInArrow(run, "query_id long, id long, similarity double")


def search_many(rows: DataFrame, queries: DataFrame, dim: int, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, id, similarity): for each of queries(query_id, query) the k nearest of rows(id, embedding) by cosine.

    Similarities have 6 decimals, ties go to the smaller id.  Vectors and queries that are null, of another dimension, with
    null components or without length are left out.  Ids are longs without nulls, distinct among the rows; queries with equal
    ids share their k places.
    """

    def whole(c: str) -> F.Column:
        return F.coalesce((F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull()), F.lit(False))

    vectors = rows.filter(whole("embedding") & F.col("id").isNotNull()).select(F.col("id").cast("long"), "embedding")
    asked = queries.filter(whole("query")).select(F.col("query_id").cast("long"), F.col("query").cast("array<double>").alias("query"))
    per_pass = max(1, query_bytes // (8 * dim))
    passes = max(1, -(-asked.count() // per_pass))
    found = []
    for p in range(passes):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toArrow()
        if not block.num_rows:
            continue
        flat = block.column("query").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        units, fine = _units(flat)
        found.append(_pass(vectors, units[fine], block.column("query_id").to_numpy()[fine], k))
    if not found:
        return vectors.limit(0).select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("similarity"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return reduce(DataFrame.unionByName, found).withColumn("_n", best).filter(F.col("_n") <= k).drop("_n")
