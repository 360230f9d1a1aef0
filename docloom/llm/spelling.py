"""Spelling variant grouping with forward and backward automata (operator 12).

Words one error apart (a code point inserted, deleted or replaced) agree in the first half of one of them or
in its second half.  The vocabulary is therefore dealt out twice: by its possible first halves to forward
parts and by its possible second halves, read backwards, to backward parts.  A part holds its words in a
minimal acyclic automaton whose arcs count the words they pass, so that a path gives the word's number, and
the number gives the word and its count.  Each word walks its half exactly and completes the rest with one
error.  What both directions find is kept from the forward one alone.

Each word takes the most frequent of its near words as its form if that is ``FACTOR`` times as frequent, and
forms are followed to their roots by doubling: counts grow by that factor at each step, so a dozen steps end any chain.

Counting is summed per task before the shuffle.  A half that more than ``HOT_HALF`` words share is dealt to several
parts by the words themselves, and those that ask for it ask in each; such halves are at most one per ``HOT_HALF``
entries of the vocabulary, so their list is broadcast.  No part is larger than a few times ``PART_WORDS`` words.

Defined results: null and empty texts have no words; a null id is written as nothing in the hashed text;
repeated rows count as often as they are there; ids may be repeated; an empty table, or one without frequent words,
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, slices, table
from .wordsums import FLUSH_WORDS

MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
#: One of so many (document, word) pairs gets a typing error.
ERROR_RATE = 199
PART_WORDS = 5_000
HOT_HALF = 5_000

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


class Automaton:
    """Minimal acyclic automaton of distinct words, added in order; numbers them in that order."""

    def __init__(self, words: list[str]):
        self.final, self.arcs, self.size, self.skip = [False], [{}], [0], [{}]
        self.known: dict[tuple, int] = {}
        last, path = "", [0]  # path: states along the last word, not yet shared
        for word in words:
            same = 0
            for a, b in zip(word, last):  # noqa: B905 - the shorter one ends it
                if a != b:
                    break
                same += 1
            self._share(last, path, same)
            for c in word[same:]:
                self.final.append(False)
                self.arcs.append({})
                self.size.append(0)
                self.skip.append({})
                self.arcs[path[-1]][c] = len(self.final) - 1
                path.append(len(self.final) - 1)
            self.final[path[-1]] = True
            last = word
        self._share(last, path, 0)
        self._count(0)

    def _count(self, state: int) -> None:
        n = int(self.final[state])
        for c, to in self.arcs[state].items():  # in order of the code points, as the words came
            self.skip[state][c] = n
            n += self.size[to]
        self.size[state] = n

    def _share(self, word: str, path: list[int], keep: int) -> None:
        """States behind the first ``keep`` letters are complete: replace them by equal ones."""
        while len(path) > keep + 1:
            state = path.pop()
            self._count(state)
            signature = (self.final[state], *self.arcs[state].items())
            self.arcs[path[-1]][word[len(path) - 1]] = self.known.setdefault(signature, state)

    def walk(self, text: str, state: int = 0, number: int = 0, start: int = 0) -> tuple[int, int] | None:
        """State and number behind ``text[start:]``; None where no word goes on so."""
        arcs, skip = self.arcs, self.skip
        for i in range(start, len(text)):
            c = text[i]
            to = arcs[state].get(c)
            if to is None:
                return None
            number += skip[state][c]
            state = to
        return state, number

    def one_error(self, text: str, exact: int) -> set[int]:
        """Numbers of the words that begin with ``text[:exact]`` and differ from ``text`` by one error behind it."""
        at = self.walk(text[:exact])
        found: set[int] = set()
        if at is None:
            return found
        state, number = at
        for i in range(exact, len(text) + 1):
            arcs, skip = self.arcs[state], self.skip[state]
            mine = text[i] if i < len(text) else None
            ends = []
            if mine is not None and (i == exact or mine != text[i - 1]):
                ends.append(self.walk(text, state, number, i + 1))
            for c, to in arcs.items():
                if c != mine:
                    ends.append(self.walk(text, to, number + skip[c], i))
                    if mine is not None:
                        ends.append(self.walk(text, to, number + skip[c], i + 1))
            found.update(end[1] for end in ends if end is not None and self.final[end[0]])
            if mine is None or mine not in arcs:
                break
            number += skip[mine]
            state = arcs[mine]
        return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: int = ERROR_RATE) -> DataFrame:
    """(word, n): runs of letters, some with an error, that have at least ``MIN_LENGTH`` letters."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, 1):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(f"{name or ''}:".encode())
                for run, n in Counter(_RUN.findall(text)).items():
                    run = run.lower() if run.isascii() else run.translate(_LOWER)
                    h = zlib.crc32(run.encode(), seed)
                    if not h % error_rate:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < MIN_LENGTH:
                            continue
                    counts[run] += n
                if len(counts) > FLUSH_WORDS:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halves(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (half, back, word, n) under which words are found, and (half, back, word) under which they ask."""
    size = F.length("word")
    directions = F.explode(F.array(F.lit(False), F.lit(True))).alias("back")
    turned = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    # A word of l letters asks with its first l // 2 letters forward and with the others backward.
    asked = F.when(F.col("back"), size - F.floor(size / 2)).otherwise(F.floor(size / 2)).cast("int")
    asks = words.select("word", directions).select("back", "word", F.substring(turned, F.lit(1), asked).alias("half"))
    # Near words have l - 1, l or l + 1 letters.
    lengths = F.explode(F.array_distinct(F.transform(F.sequence(size - 1, size + 1), lambda s: F.when(F.col("back"), s - F.floor(s / 2)).otherwise(F.floor(s / 2)).cast("int")))).alias("letters")
    entries = words.select("word", "n", directions).select("back", "word", "n", lengths).select("back", "word", "n", F.substring(turned, F.lit(1), F.col("letters")).alias("half"))
    return entries, asks


def near_words(words: DataFrame, part_words: int = PART_WORDS, hot_half: int = HOT_HALF) -> DataFrame:
    """(word, near, near_n), once for each ordered pair of words(word, n) that are one error apart."""
    entries, asks = _halves(words)
    n_parts = max(1, entries.count() // part_words)
    hot = entries.groupBy("back", "half").agg(F.count("*").alias("n_entries")).filter(F.col("n_entries") > hot_half).select("back", "half", F.ceil(F.col("n_entries") / hot_half).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    part = F.pmod(F.xxhash64("back", "half", "salt"), F.lit(n_parts)).alias("part")
    held = entries.join(F.broadcast(hot), ["back", "half"], "left").withColumn("salt", F.pmod(F.xxhash64("word"), salts).cast("int")).select(part, "back", F.lit("").alias("asks"), "word", "n")
    asked = asks.join(F.broadcast(hot), ["back", "half"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(part, "back", F.col("half").alias("asks"), "word", F.lit(0).cast("long").alias("n"))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        for back, own in rows.groupby("back"):
            count = dict(own.loc[own.asks == "", ["word", "n"]].itertuples(index=False))
            turn = (lambda w: w[::-1]) if back else (lambda w: w)
            held = sorted(map(turn, count))
            automaton = Automaton(held)
            for half, word in own.loc[own.asks != "", ["asks", "word"]].drop_duplicates().itertuples(index=False):
                first = word[: len(word) // 2]
                for number in automaton.one_error(turn(word), len(half)):
                    other = turn(held[number])
                    if not back or not other.startswith(first):
                        found.append((word, other, count[other]))
        return pd.DataFrame(found, columns=["word", "near", "near_n"])

    pairs = held.unionByName(asked).groupBy("part").applyInPandas(match, "word string, near string, near_n long")
    # A pair comes twice only where parts of a hot half meet in one part.
    return pairs.distinct()


def forms(words: DataFrame, near: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n) for every word."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    takes = F.coalesce(-F.col("best.less") >= factor * F.col("n"), F.lit(False))
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form, by doubling the steps that each has gone."""
    steps = materialise(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        on = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        doubled = materialise(steps.join(on, steps.root == on["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-steps")
        moved = not doubled.filter("moved").isEmpty()
        release(steps)
        steps = doubled.select("word", "root")
        if not moved:
            return steps


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: int = ERROR_RATE, part_words: int = PART_WORDS, hot_half: int = HOT_HALF) -> DataFrame:
    """word, form, root, n, n_near, form_n for every frequent word."""
    words = materialise(word_counts(docs, id_col, text_col, error_rate).filter(F.col("n") >= MIN_COUNT), "spelling-words")
    formed = materialise(forms(words, near_words(words, part_words, hot_half)), "spelling-forms")
    release(words)
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))
