"""Benchmark decontamination with training suffix arrays (operator 4).

Each shard (an Arrow batch of documents) gets a word suffix array.  Every test suffix that starts a
window is searched in it by bisection: the suffixes that share the whole window are one range of the
array, and each of them is followed to its longest verbatim match.  Documents with such a match are
contaminated.

Only words that occur in the benchmark can match, so the array holds just the suffixes that start with
a run of at least the shortest window's length of such words.  All others sort where no test suffix is.

The benchmark is a query set: it is read in blocks of at most ``BLOCK_CHARS`` characters (one block in
most cases; a longer single item is a block of its own), each of which is searched against all documents.

Words: A-Z become lower case, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.  A window is 10
consecutive words of an item; an item of fewer words is one window; an item without words has none.

Defined results: null texts have no words; every input row gives one row, also where ids are null or
repeated; a null item_id counts as the empty string, items that repeat an id count once; an empty
benchmark leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, slices, table, text_bytes

WINDOW = 10
BLOCK_CHARS = 4_000_000
#: Words of a shard's suffix array at most, but for a single document with more.
SHARD_WORDS = 2_000_000

_WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class TestSuffixes:
    """The suffixes of one block of items that start a window, as rows of word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.vocabulary = window, {}
        ids, starts, lengths, names, words = [], [], [], [], []
        for name, text in items:
            found = alnum_words(text_bytes(text))
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
            size = min(window, len(numbers))
            for at in range(len(numbers) - size + 1 if numbers else 0):
                starts.append(len(ids) + at)
                lengths.append(size)
                names.append(name)
                words.append(at)
            ids += [*numbers, -1]
        self.ids = np.array(ids + [-1] * (window + 1), dtype=np.int64)
        self.start, self.length = np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)
        self.item, self.item_pos = names, np.array(words, dtype=np.int64)
        self.shortest = int(self.length.min()) if lengths else 0
        if lengths:
            rows = self.ids[self.start[:, None] + np.arange(window)]
            rows[np.arange(window) >= self.length[:, None]] = 0
            self.prefix, self.of = np.unique(rows, axis=0, return_inverse=True)
            self.of = self.of.ravel()
            self.prefix_length = (self.prefix > 0).sum(1)
            order = np.argsort(self.of, kind="stable")
            self.by_prefix = order, np.searchsorted(self.of[order], np.arange(len(self.prefix) + 1))


def _suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by their next ``depth`` words at least (prefix doubling)."""
    rank, k = words, 1
    while k < depth:
        ahead = np.concatenate([rank[k:], np.zeros(min(k, len(rank)), dtype=rank.dtype)])[: len(rank)]
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1] + 1
        k *= 2
    return np.argsort(rank, kind="stable")


def _ranges(words: np.ndarray, array: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct window, where in the suffix array its suffixes begin and end."""
    padded = np.concatenate([words, np.zeros(test.window, dtype=words.dtype)])
    columns, n = np.arange(test.window), len(test.prefix)
    beyond = columns >= test.prefix_length[:, None]

    def bisect(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(n, dtype=np.int64), np.full(n, len(array), dtype=np.int64)
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, len(array) - 1)
            there = padded[array[middle][:, None] + columns]
            differs = (there != test.prefix) & ~beyond
            first = differs.argmax(1)
            at = np.arange(n)
            same = ~differs.any(1)
            right = np.where(same, after_equal, there[at, first] < test.prefix[at, first]) & open_
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        return low

    return bisect(False), bisect(True)


def shard_matches(numbers: np.ndarray, doc_of: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (place, test suffix, longest match in words) of a shard.

    numbers: word numbers with 0 for words outside the benchmark and -2 after each document.
    """
    none = np.zeros(0, dtype=np.int64)
    known = numbers > 0
    if not test.shortest or not known.any():
        return none, none, none
    edges = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long_enough = end - begin >= test.shortest
    begin, end = begin[long_enough], end[long_enough]
    if not len(begin):
        return none, none, none
    # The runs one after another, a 0 after each.
    size = end - begin + 1
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    where = np.repeat(begin - offset, size) + np.arange(size.sum())
    words = np.where(np.isin(np.arange(len(where)), offset + size - 1), 0, numbers[np.minimum(where, len(numbers) - 1)])
    array = _suffix_array(words, test.window)
    low, high = _ranges(words, array, test)
    found = np.flatnonzero(high > low)
    if not len(found):
        return none, none, none
    counts = high[found] - low[found]
    prefix = np.repeat(found, counts)
    place = array[np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
    # One row for each test suffix with that window.
    order, bounds = test.by_prefix
    many = bounds[prefix + 1] - bounds[prefix]
    place, first = np.repeat(place, many), np.repeat(bounds[prefix] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    suffix = order[first + np.arange(many.sum())]
    length = test.length[suffix].copy()
    padded = np.concatenate([words, [0]])
    going = np.arange(len(length))
    while len(going):
        mine = padded[np.minimum(place[going] + length[going], len(words))]
        theirs = test.ids[np.minimum(test.start[suffix[going]] + length[going], len(test.ids) - 1)]
        going = going[(mine > 0) & (mine == theirs)]
        length[going] += 1
    return where[place], suffix, length


MATCH = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.int64()), ("window", pa.int64()), ("item_id", pa.string()), ("item_at", pa.int64())]))
MATCH_SQL = "array<struct<at: bigint, words: bigint, window: bigint, item_id: string, item_at: bigint>>"


def _search_block(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """(row, id, n_words, matches) of every row of docs(row, id, text) against one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TestSuffixes(shared.value, window)
        number = test.vocabulary.get

        def shard(rows, ids, counts, numbers):
            flat = np.array(numbers, dtype=np.int64)
            ends = np.cumsum(np.array(counts, dtype=np.int64) + 1)
            starts = ends - np.array(counts, dtype=np.int64) - 1
            place, suffix, length = shard_matches(flat, ends, test)
            doc = np.searchsorted(ends, place, side="right")
            matches: list[list] = [[] for _ in counts]
            for d, at, s, n in zip(doc.tolist(), (place - starts[doc]).tolist(), suffix.tolist(), length.tolist(), strict=True):
                matches[d].append({"at": at, "words": n, "window": int(test.length[s]), "item_id": test.item[s], "item_at": int(test.item_pos[s])})
            return pa.RecordBatch.from_arrays([pa.concat_arrays(rows), pa.concat_arrays(ids), pa.array(counts, pa.int64()), pa.array(matches, MATCH)], ["row", "id", "n_words", "matches"])

        rows, ids, counts, numbers = [], [], [], []
        for batch in slices(batches, 2):
            rows.append(batch.column(0))
            ids.append(batch.column(1))
            for text in batch.column(2).to_pylist():
                words = alnum_words(text_bytes(text))
                counts.append(len(words))
                numbers += [number(w, 0) for w in words]
                numbers.append(-2)
            if len(numbers) > SHARD_WORDS:
                yield shard(rows, ids, counts, numbers)
                rows, ids, counts, numbers = [], [], [], []
        if rows:
            yield shard(rows, ids, counts, numbers)

    return docs.mapInArrow(search, f"row long, id {docs.schema['id'].dataType.simpleString()}, n_words long, matches {MATCH_SQL}")


def _benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("text <> ''")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(size) // BLOCK_CHARS))
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        yield [(r.item, r.text) for r in block.collect()]


def suffix_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row, id, n_words, matches): for every row all places where a test suffix matches, with the longest match."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = [_search_block(rows, items, window) for items in _benchmark_blocks(benchmark, item_col, item_text_col)]
    if len(parts) == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match for every row."""
    found = suffix_matches(docs, benchmark, window, id_col, text_col, item_col, item_text_col)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            hit, items, digests, longest = [], [], [], []
            for n, matches in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not matches:
                    hit.append(0), items.append(0), digests.append(empty), longest.append(0)
                    continue
                covered = np.zeros(n + 1, dtype=np.int64)
                at = np.array([m["at"] for m in matches])
                np.add.at(covered, at, 1)
                np.add.at(covered, at + np.array([m["window"] for m in matches]), -1)
                names = sorted({m["item_id"] for m in matches})
                hit.append(int((np.cumsum(covered)[:n] > 0).sum()))
                items.append(len(names))
                digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
                longest.append(max(m["words"] for m in matches))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), pa.array(longest, pa.int64())],
                ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    done = found.mapInArrow(sums, f"id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long")
    return done.withColumnRenamed("id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a match, all columns.

    The verdicts are joined by id, so of rows that share an id all go if one of them is contaminated.
    """
    verdicts = contamination(docs, benchmark, window, id_col, text_col)
    gone = materialise(verdicts.filter("contaminated").select(F.col(id_col).alias(fresh(docs.columns, "_gone"))).distinct(), "contaminated")
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(gone.columns[0])), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
