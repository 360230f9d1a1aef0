"""How many texts have each of many words, in one pass over the texts.

``trigram`` looks every word up in every block, so words times blocks grow with the square of tables that give both.  Here the
words are tables of their first eight bytes, or of all where they are shorter, and each place of the texts is looked up in these:
at one place at most one word of each length can match, so the work grows with the texts, whatever the number of words.  What
stands behind eight bytes is compared byte by byte.  A task adds up what it finds and puts out one row for each word it
found; no pair of a word and a text leaves it.  Words are sent to the tasks ``WORD_BYTES`` at a time; more make further passes.

Defined results: case does not count; a null text or word matches nothing, an empty word every text; a text counts once
for a word; a null id counts as a text but is no first or last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words that go to the tasks at once, with eight for each word.
WORD_BYTES = 4 << 20
#: Bytes of texts that are looked up at once; a longer text is taken in pieces.
BLOCK = 1 << 17
WIDTH = 8
_ODD = 0x9E3779B97F4A7C15
_MOST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number each; ``data`` has at least eight more bytes than places."""
    return np.ndarray((len(data) - WIDTH,), "<u8", data, strides=(1,))


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(WIDTH, np.uint8)])


class _Keys:
    """Numbers, looked up by the top bits of a product: a key for each place, and those whose place is taken in a table of their own."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, odd: int = _ODD):
        # 16 to 32 places a key.
        bits = max(8, (16 * len(keys)).bit_length())
        self.odd, self.shift = np.uint64(odd), np.uint64(64 - bits)
        slot, first = np.unique(self._slots(keys), return_index=True)
        self.keys, self.values = keys[first], values[first]
        self.used = np.zeros(1 << bits, bool)
        self.used[slot] = True
        self.row = np.zeros(1 << bits, np.int32)
        self.row[slot] = np.arange(len(slot))
        left = np.ones(len(keys), bool)
        left[first] = False
        self.rest = _Keys(keys[left], values[left], odd * _ODD & (1 << 64) - 1) if left.any() else None
        # Equal keys, which only hashes can be, are found by asking on.
        self.repeats = len(np.unique(keys)) < len(keys)

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        slot = numbers * self.odd
        slot >>= self.shift
        return slot.view(np.int64)

    def find(self, numbers: np.ndarray, fits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``numbers``, value) wherever a number that ``fits`` is a key; a value for each equal key."""
        slot = self._slots(numbers)
        used = self.used[slot]
        at = np.flatnonzero(used if fits is None else used & fits)
        row, number = self.row[slot[at]], numbers[at]
        same = self.keys[row] == number
        found, value = at[same], self.values[row[same]]
        if self.rest:
            open_ = np.ones(len(at), bool) if self.repeats else ~same
            more, values = self.rest.find(number[open_])
            found, value = np.concatenate([found, at[open_][more]]), np.concatenate([value, values])
        return found, value


class Matcher:
    """Finds distinct words in texts, both given as joined bytes and where each ends; empty words are left out."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        self.eight = _windows(_padded(words))
        self.start = np.append(0, ends)[:-1].astype(np.int64)
        length = ends - self.start
        #: Bytes, mask and table of words up to eight bytes; bytes and table of longer ones, and a table of how these begin.
        self.short, self.long, self.head = [], [], None
        for n in np.unique(length[length > 0]).tolist():
            of = np.flatnonzero(length == n)
            if n <= WIDTH:
                mask = np.uint64((1 << 8 * n) - 1)
                self.short.append((n, mask, _Keys(self.eight[self.start[of]] & mask, of)))
            else:
                self.long.append((n, _Keys(self._hash(self.eight, self.start[of], n), of)))
        if self.long:
            heads = np.unique(self.eight[self.start[length > WIDTH]])
            self.head = _Keys(heads, np.arange(len(heads)))

    @staticmethod
    def _steps(n: int) -> list[int]:
        """Where windows begin that cover n bytes."""
        return [*range(0, n - WIDTH, WIDTH), n - WIDTH]

    def _hash(self, eight: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in self._steps(n):
            h = (h ^ eight[at + k]) * np.uint64(_ODD)
            h ^= h >> np.uint64(29)
        return h

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, text) for each word that a text has, once, in the order of words and texts; ``data`` is padded."""
        eight = _windows(data)
        bits = len(ends).bit_length()
        found = []
        for a in range(0, len(eight), BLOCK):
            here = eight[a : a + BLOCK].copy()
            # The text that each place is in, and the bytes from there to its end.
            size = np.diff(np.clip(ends, a, a + len(here)), prepend=a)
            text, room = np.repeat(np.arange(len(ends)), size), np.repeat(ends, size) - np.arange(a, a + len(here))
            hits = []
            for n, mask, keys in self.short:
                at, word = keys.find(here & mask, room >= n)
                hits.append(word << bits | text[at])
            if self.head:
                heads = self.head.find(here, room > WIDTH)[0]
                for n, keys in self.long:
                    own = heads[room[heads] >= n] + a
                    k, word = keys.find(self._hash(eight, own, n))
                    own = own[k]
                    for step in self._steps(n):
                        same = eight[own + step] == self.eight[self.start[word] + step]
                        own, word = own[same], word[same]
                    hits.append(word << bits | text[own - a])
            found.append(_distinct(hits))
        both = found[0] if len(found) == 1 else _distinct(found)
        return both >> bits, both & (1 << bits) - 1


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    both = np.sort(np.concatenate([np.zeros(0, np.int64), *parts]))
    return both[np.diff(both, prepend=-1) != 0]


class _Totals:
    """Number of texts, least and largest id for each word."""

    def __init__(self, n: int):
        self.n, self.first, self.last = np.zeros(n, np.int64), np.full(n, _MOST), np.full(n, _LEAST)

    def add(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Words in their order, each with the id of a text as ``low`` and ``high``."""
        at = np.flatnonzero(np.diff(word, prepend=-1))
        if not len(at):
            return
        own = word[at]
        self.n[own] += np.diff(np.append(at, len(word)))
        self.first[own] = np.minimum(self.first[own], np.minimum.reduceat(low, at))
        self.last[own] = np.maximum(self.last[own], np.maximum.reduceat(high, at))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, joined, and where each value ends."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def totals(words: DataFrame, texts: DataFrame, word_bytes: int = WORD_BYTES) -> DataFrame:
    """(word, n, first_id, last_id): in how many of texts(id, content) each of words(word) is, and their least and largest id.

    Words come back once, in lower case; those that no text has are left out.
    """
    asked = words.filter("word IS NOT NULL").select(F.lower("word").alias("word")).distinct()
    own = texts.filter("content IS NOT NULL").select(F.col("id").cast("long"), F.lower("content").cast("binary").alias("content"))
    n = asked.agg(F.sum(F.octet_length("word") + 8)).first()[0] or 0
    parts = max(1, -(-n // word_bytes))
    part = F.pmod(F.xxhash64("word"), F.lit(parts))
    found = reduce(DataFrame.unionByName, [_pass(asked.filter(part == k), own) for k in range(parts)])
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


def _pass(words: DataFrame, texts: DataFrame) -> DataFrame:
    asked = words.select(F.col("word").cast("binary")).toArrow().column(0).combine_chunks()
    sent = texts.sparkSession.sparkContext.broadcast(_bytes(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, stops = sent.value
        matcher, sums = Matcher(joined, stops), _Totals(len(stops))
        empty = np.flatnonzero(np.diff(stops, prepend=0) == 0)
        for batch in batches:
            low, high = (pc.fill_null(batch.column(0), x).to_numpy() for x in (_MOST, _LEAST))
            data, ends = _bytes(batch.column(1))
            for k in empty:
                sums.add(np.full(len(ends), k), low, high)
            a = 0
            while a < len(ends):
                begin = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, begin + BLOCK, "right")))
                word, text = matcher.find(_padded(data[begin : ends[b - 1]]), ends[a:b] - begin)
                sums.add(word, low[text + a], high[text + a])
                a = b
        held = np.flatnonzero(sums.n)
        begins = np.append(0, stops)[held]
        names = [joined[x:y].tobytes() for x, y in zip(begins.tolist(), stops[held].tolist(), strict=True)]
        first, last = sums.first[held], sums.last[held]
        no_id = first > last
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sums.n[held]), pa.array(first, mask=no_id), pa.array(last, mask=no_id)], ["word", "n", "first_id", "last_id"])

    return texts.mapInArrow(run, "word binary, n long, first_id long, last_id long").withColumn("word", F.col("word").cast("string"))
