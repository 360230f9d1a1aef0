"""Corpus-wide word statistics and their sums per document.

Two operators need, for every document, the sum over its words of a number that is known once per
distinct word of the corpus (pieces of a tokenizer, a count).  Sending every (document, word) pair
through a shuffle would move more than the corpus itself, so the words are split by frequency:

* the ``FREQUENT_WORDS`` most frequent ones go to the tasks as one broadcast table.  Its size is
  bounded by that constant times ``FREQUENT_BYTES``, whatever the corpus;
* all other words, however many there are, take the shuffled join on the word.

Both ways give the same numbers, so nothing is dropped or capped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

FREQUENT_WORDS = 1 << 18
FREQUENT_BYTES = 48
#: A task's map-side table of words is passed on when it holds so many.
FLUSH_WORDS = 400_000
#: Words whose sums a task passes on at once, but for a single longer document.
SUM_WORDS = 1_000_000

Splitter = Callable[[bytes], list]


def ascii_words(text: bytes) -> list:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() without arguments splits at exactly these."""
    return text.split()


def count_words(docs: DataFrame, text_col: str = "text", split: Splitter = ascii_words) -> DataFrame:
    """(word binary, n long) over all rows; null and empty texts give nothing."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                counts.update(split(text_bytes(text)))
                if len(counts) > FLUSH_WORDS:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    return docs.select(text_col).mapInArrow(tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_values(words: DataFrame, value_cols: list[str], limit: int = FREQUENT_WORDS) -> tuple[dict, np.ndarray]:
    """(word -> number, values[number, column]) of the most frequent words, at most ``limit``, most frequent first.

    The last row of the values, which no word has, is 0: number -1 stands for all other words.
    """
    top = words.filter(F.length("word") <= FREQUENT_BYTES).orderBy(F.desc("n"), "word").limit(limit).select("word", *value_cols)
    rows = top.toArrow().to_pydict()
    values = np.zeros((len(rows["word"]) + 1, len(value_cols)))
    for i, c in enumerate(value_cols):
        values[:-1, i] = rows[c]
    return dict(zip(rows["word"], range(len(values)), strict=False)), values


def sum_per_document(docs: DataFrame, words: DataFrame, value_cols: list[str], id_col: str = "doc_id", text_col: str = "text", split: Splitter = ascii_words, limit: int = FREQUENT_WORDS, extra: Callable[[np.ndarray, np.ndarray], dict] | None = None, extra_cols: tuple[str, ...] = (), gathered: int | None = None) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_words`` and, for each value column, the sum over the row's words.

    ``words`` has word, n and the value columns (double); words that it lacks count as 0.
    Repeated ids stay separate rows: rows are told apart by their place in the scan.
    ``extra`` gets the numbers (see ``frequent_values``) of all words of some texts, one text after another, and
    how many each text has; it returns the double columns ``extra_cols``.  Texts are gathered until they have
    ``gathered`` words (``SUM_WORDS`` without it).
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent_values(words, value_cols, limit))

    def split_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, values = known.value
        get = numbers.get

        def record(rows, ids, sizes, found, rest_words, rest_times, ends):
            counts = np.array([len(x) for x in found], dtype=np.int64)
            flat = np.concatenate(found)
            text = np.repeat(np.arange(len(counts)), counts)
            sums = [np.bincount(text, weights=values[flat, i], minlength=len(counts)).astype(np.float64) for i in range(values.shape[1])]
            more = extra(flat, counts) if extra else {}
            rest = pa.StructArray.from_arrays([pa.array(rest_words, pa.binary()), pa.array(rest_times, pa.int64())], ["word", "times"])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(rows), pa.concat_arrays(ids), pa.array(sizes, pa.int64()), pa.array(counts), *(pa.array(x) for x in sums), *(pa.array(more[c], pa.float64()) for c in extra_cols), rest],
                ["row", "id", "n_bytes", "n_words", *value_cols, *extra_cols, "rest"],
            )

        parts, size = ([], [], [], [], [], [], [0]), 0
        for batch in slices(batches, 2):
            rows, ids, sizes, found, rest_words, rest_times, ends = parts
            rows.append(batch.column(0))
            ids.append(batch.column(1))
            for text in batch.column(2).to_pylist():
                raw = text_bytes(text)
                in_order = split(raw)
                mine = np.fromiter(map(get, in_order, repeat(-1)), dtype=np.int32, count=len(in_order))
                sizes.append(len(raw))
                found.append(mine)
                size += len(mine)
                others = Counter([in_order[i] for i in np.flatnonzero(mine < 0).tolist()])
                rest_words += others.keys()
                rest_times += others.values()
                ends.append(len(rest_words))
            if size > (gathered or SUM_WORDS):
                yield record(*parts)
                parts, size = ([], [], [], [], [], [], [0]), 0
        if parts[0]:
            yield record(*parts)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {id_type}, n_bytes long, n_words long, " + ", ".join(f"`{c}` double" for c in (*value_cols, *extra_cols)) + ", rest array<struct<word: binary, times: bigint>>"
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_col)
    parts = keyed.mapInArrow(split_off, schema)
    # A row without rare words gets a key of its own: it holds a space, so no word equals it and no task gets them all.
    rare = parts.select("row", "id", "n_bytes", "n_words", *value_cols, *extra_cols, F.explode_outer("rest").alias("r")).select(
        "row", "id", "n_bytes", "n_words", *extra_cols, *(F.col(c).alias(f"own_{c}") for c in value_cols), F.coalesce("r.word", F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary")).alias("word"), F.coalesce("r.times", F.lit(0)).alias("times")
    )
    joined = rare.join(words.select("word", *value_cols), "word", "left")
    return (
        joined.groupBy("row")
        .agg(F.first("id").alias(id_col), F.first("n_bytes").alias("n_bytes"), F.first("n_words").alias("n_words"), *(F.first(c).alias(c) for c in extra_cols), *((F.first(f"own_{c}") + F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("times"))).alias(c) for c in value_cols))
        .drop("row")
    )
