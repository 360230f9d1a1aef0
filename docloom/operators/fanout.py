"""Calls of a slow model, row by row, a bounded number of them at once, with retries and without losing the batch.

Each task has ``workers`` threads, so a job never has more calls open than its tasks times that; ``tasks`` bounds them over
the whole cluster by the number of partitions.  Answers keep the order of their rows.  A row whose call fails for good
has a null answer and the error; no other row is touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import extraction as ex
from docloom.operators.lifecycle import ERROR_CHARS

WORKERS = 4
def in_order(pool: ThreadPoolExecutor, call: Callable, items: list, queued: int = WORKERS) -> Iterator:
    """``call`` of each item, in the order of the items, with at most ``queued`` of them handed to the pool.

    The threads take the next item by themselves: one that is handed over and fetched by itself costs more than a quick call.
    """
    out: list = [None] * len(items)
    places = iter(range(len(items)))

    def run() -> None:
        for i in places:
            out[i] = call(items[i])

    for future in [pool.submit(run) for _ in range(min(queued, len(items)))]:
        future.result()
    yield from out


def fan_out(rows: DataFrame, prompt: Column, factory: Callable[[], Callable], name: str = "answer", error: str = "error", workers: int = WORKERS, tasks: int | None = None, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Rows with ``name`` and ``error``.  The model takes one prompt and returns a text; a null prompt is not sent.

    ``factory`` makes the model once per Python worker; calls from several threads must be safe.
    """
    key = ex.model_name(factory)
    sent = rows.withColumn("_prompt", prompt)
    if tasks is not None:
        sent = sent.repartition(tasks)
    names = rows.columns
    place = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def call(text):
            if text is None:
                return None, None
            try:
                return ex.retried(lambda: ex.once(factory, key)(text), tries, wait), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"[:ERROR_CHARS]

        with ThreadPoolExecutor(max_workers=workers) as pool:
            for batch in batches:
                if not batch.num_rows:
                    continue
                answers, errors = zip(*in_order(pool, call, batch.column(place).to_pylist(), workers), strict=True)
                columns = [batch.column(i) for i in range(place)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], [*names, name, error])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` string, `{error}` string"
    return sent.mapInArrow(run, schema)


def answered(rows: DataFrame, name: str = "answer", error: str = "error") -> DataFrame:
    """Rows whose call came back, without the error column."""
    return rows.filter(F.col(error).isNull() & F.col(name).isNotNull()).drop(error)
