"""Substring search over many texts by trigram postings.

Texts are dealt into blocks as they come; a block is one row of the index, with its ids, its texts in lower case and, for
each trigram, the places of the texts that have it.  A word's candidates in a block are the texts that have all of its
``MOST_GRAMS`` trigrams that are rarest there; the exact comparison, that of ``retrieval.keyword_search``, runs on these
alone, in the task that has the block.  Words are sent to the tasks ``WORD_CHARS`` at a time; more make further passes over
the index.  Neither postings nor pairs of a word and a text are shuffled, and no block grows with the table.

Words of under three characters have no trigram: they are compared with every text of a block; patterns with wildcards may
have none: they are compared with every text.  Candidates are never cut off.

Defined results: case does not count; a null text or word matches nothing, an empty word every text; ids are longs, distinct
and not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Texts of a block, and characters that end one before; a longer text is a block of its own.
BLOCK, BLOCK_CHARS = 4096, 1 << 21
MOST_GRAMS = 6
#: Characters of words that go to the tasks at once, and words that are looked up together.
WORD_CHARS, WORD_GROUP = 8 << 20, 1024
#: Words that go to the texts at once where every text is compared; more make further scans.
MOST_SCANNED = 10_000
_BITS = 21
_INDEX = "ids array<long>, texts array<string>, grams binary, ends binary, places binary"


class Postings(NamedTuple):
    """A row for each block: ids and texts, the codes of its trigrams, and where the places of each end."""

    blocks: DataFrame


def _codes(chars: np.ndarray) -> np.ndarray:
    """Codes of the trigrams that start at each character but the last two."""
    c = chars.astype(np.int64)
    return c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:]


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _postings(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted codes, the end of each one's places, and the places, without repetition."""
    chars = _characters("".join(texts))
    if len(chars) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    inside = owner[:-2] == owner[2:]
    alphabet = np.flatnonzero(np.bincount(chars))
    n = len(alphabet)
    if n**3 * len(texts) < 1 << 63:
        # A small alphabet: trigram and place fit one number, which sorts at once.
        small = np.zeros(alphabet[-1] + 1, np.int64)
        small[alphabet] = np.arange(n)
        c = small[chars]
        both = np.sort((((c[:-2] * n + c[1:-1]) * n + c[2:]) * len(texts) + owner[:-2])[inside])
        gram, place = np.divmod(both[np.diff(both, prepend=-1) != 0], len(texts))
        new = np.flatnonzero(np.diff(gram, prepend=-1))
        first = gram[new]
        codes = alphabet[first // n**2] << 2 * _BITS | alphabet[first // n % n] << _BITS | alphabet[first % n]
    else:
        codes, gram = np.unique(_codes(chars)[inside], return_inverse=True)
        gram, place = np.divmod(np.unique(gram * len(texts) + owner[:-2][inside]), len(texts))
        new = np.flatnonzero(np.diff(gram, prepend=-1))
    return codes, np.append(new[1:], len(gram)), place.astype(np.uint16)


def build(texts: DataFrame, block: int = BLOCK) -> Postings:
    """The index of texts(id, content), of at most 65,536 texts a block; to search it often, write its table once."""
    own = texts.filter("id IS NOT NULL AND content IS NOT NULL").select(F.col("id").cast("long"), F.lower("content").alias("content"))

    def row(ids: list[int], held: list[str]) -> pa.RecordBatch:
        codes, ends, places = _postings(held)
        fields = [pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*fields, *(pa.array([x.tobytes()], pa.binary()) for x in (codes, ends, places))], ["ids", "texts", "grams", "ends", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (len(held) >= block or n + len(text) > BLOCK_CHARS):
                    yield row(ids, held)
                    ids, held, n = [], [], 0
                ids.append(i)
                held.append(text)
                n += len(text)
        if held:
            yield row(ids, held)

    return Postings(own.mapInArrow(run, _INDEX))


class _Group:
    """Words that are looked up together: short ones, and others by their trigrams."""

    def __init__(self, ids: list[int], words: list[str], most: int):
        long = [k for k, w in enumerate(words) if len(w) >= GRAM]
        self.short = [(ids[k], words[k]) for k, w in enumerate(words) if len(w) < GRAM]
        self.ids, self.words, self.most = np.array([ids[k] for k in long], np.int64), [words[k] for k in long], most
        self.exact = np.array([len(w) == GRAM for w in self.words], bool)
        own = [np.unique(_codes(_characters(w))) for w in self.words]
        self.word = np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.codes, self.code = np.unique(np.concatenate([*own, np.zeros(0, np.int64)]), return_inverse=True)

    def candidates(self, grams: np.ndarray, ends: np.ndarray, places: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, place of the text), of texts that have all of a word's rarest trigrams."""
        at = np.minimum(np.searchsorted(grams, self.codes), max(0, len(grams) - 1))
        held = grams[at] == self.codes if len(grams) else np.zeros(len(self.codes), bool)
        start = np.where(held, np.append(0, ends)[at], 0)
        size = np.where(held, ends[at] - start, 0) if len(grams) else np.zeros(len(self.codes), np.int64)
        # The trigrams of each word by how many texts have them; words with a trigram that no text has end here.
        order = np.lexsort((size[self.code], self.word))
        word, code = self.word[order], self.code[order]
        rank = np.arange(len(word)) - np.searchsorted(word, word)
        fine = size[code[rank == 0]] > 0
        kept = fine[word] & (rank < self.most)
        word, code, rank = word[kept], code[kept], rank[kept]
        head = code[rank == 0]
        of_word = np.repeat(word[rank == 0], size[head])
        place = places[_ranges(start[head], size[head])].astype(np.int64)
        table = np.full((len(fine), self.most), -1, np.int64)
        table[word, rank] = code
        others = np.unique(table[:, 1:])
        others = others[others >= 0]
        row = np.zeros(len(self.codes) + 1, np.int64)
        row[others] = np.arange(len(others))
        has = np.zeros((len(others), n_texts), bool)
        has[np.repeat(np.arange(len(others)), size[others]), places[_ranges(start[others], size[others])]] = True
        for k in range(1, self.most):
            code = table[of_word, k]
            stays = code < 0
            stays[~stays] = has[row[code[~stays]], place[~stays]]
            of_word, place = of_word[stays], place[stays]
        return of_word, place


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _lookup(words: DataFrame, index: Postings, most: int, exact: bool, word_chars: int) -> DataFrame:
    """(word_id, id) of words(word_id, word), in lower case, in the index; not ``exact``: candidates, of no short words."""
    n = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = max(1, -(-n // word_chars))
    part = F.pmod(F.xxhash64("word_id", "word"), F.lit(parts))
    found = [_pass(words.filter(part == k), index, most, exact) for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _pass(words: DataFrame, index: Postings, most: int, exact: bool) -> DataFrame:
    block = words.select(F.col("word_id").cast("long"), "word").toArrow()
    sent = index.blocks.sparkSession.sparkContext.broadcast((block.column(0).to_pylist(), block.column(1).to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        groups = [_Group(ids[k : k + WORD_GROUP], asked[k : k + WORD_GROUP], most) for k in range(0, len(ids), WORD_GROUP)]
        for batch in batches:
            for k in range(batch.num_rows):
                names = batch.column(0)[k].values.to_numpy()
                texts = batch.column(1)[k].values.to_pylist()
                grams, ends, places = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((2, np.int64), (3, np.int64), (4, np.uint16)))
                for group in groups:
                    word, place = group.candidates(grams, ends, places, len(texts))
                    if exact:
                        held = group.words
                        stays = group.exact[word]
                        open_ = np.flatnonzero(~stays)
                        stays[open_] = [held[w] in texts[p] for w, p in zip(word[open_].tolist(), place[open_].tolist(), strict=True)]
                        word, place = word[stays], place[stays]
                    out = [(group.ids[word], names[place])]
                    for i, short in group.short if exact else ():
                        hits = names[[short in t for t in texts]]
                        out.append((np.full(len(hits), i), hits))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["word_id", "id"])

    return index.blocks.mapInArrow(run, "word_id long, id long")


def candidates(self, grams: np.ndarray, ends: np.ndarray, places: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, place of the text), of texts that have all of a word's rarest trigrams."""
        at = np.minimum(np.searchsorted(grams, self.codes), max(0, len(grams) - 1))
        held = grams[at] == self.codes if len(grams) else np.zeros(len(self.codes), bool)
        start = np.where(held, np.append(0, ends)[at], 0)
        size = np.where(held, ends[at] - start, 0) if len(grams) else np.zeros(len(self.codes), np.int64)
        # The trigrams of each word by how many texts have them; words with a trigram that no text has end here.
        order = np.lexsort((size[self.code], self.word))
        word, code = self.word[order], self.code[order]
        rank = np.arange(len(word)) - np.searchsorted(word, word)
        fine = size[code[rank == 0]] > 0
        kept = fine[word] & (rank < self.most)
        word, code, rank = word[kept], code[kept], rank[kept]
        head = code[rank == 0]
        of_word = np.repeat(word[rank == 0], size[head])
        place = places[_ranges(start[head], size[head])].astype(np.int64)
        table = np.full((len(fine), self.most), -1, np.int64)
        table[word, rank] = code
        others = np.unique(table[:, 1:])
        others = others[others >= 0]
        row = np.zeros(len(self.codes) + 1, np.int64)
        row[others] = np.arange(len(others))
        has = np.zeros((len(others), n_texts), bool)
        has[np.repeat(np.arange(len(others)), size[others]), places[_ranges(start[others], size[others])]] = True
        for k in range(1, self.most):
            code = table[of_word, k]
            stays = code < 0
            stays[~stays] = has[row[code[~stays]], place[~stays]]
            of_word, place = of_word[stays], place[stays]
        return of_word, place


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _lookup(words: DataFrame, index: Postings, most: int, exact: bool, word_chars: int) -> DataFrame:
    """(word_id, id) of words(word_id, word), in lower case, in the index; not ``exact``: candidates, of no short words."""
    n = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    parts = max(1, -(-n // word_chars))
    part = F.pmod(F.xxhash64("word_id", "word"), F.lit(parts))
    found = [_pass(words.filter(part == k), index, most, exact) for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _pass(words: DataFrame, index: Postings, most: int, exact: bool) -> DataFrame:
    block = words.select(F.col("word_id").cast("long"), "word").toArrow()
    sent = index.blocks.sparkSession.sparkContext.broadcast((block.column(0).to_pylist(), block.column(1).to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = sent.value
        groups = [_Group(ids[k : k + WORD_GROUP], asked[k : k + WORD_GROUP], most) for k in range(0, len(ids), WORD_GROUP)]
        for batch in batches:
            for k in range(batch.num_rows):
                names = batch.column(0)[k].values.to_numpy()
                texts = batch.column(1)[k].values.to_pylist()
                grams, ends, places = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in ((2, np.int64), (3, np.int64), (4, np.uint16)))
                for group in groups:
                    word, place = group.candidates(grams, ends, places, len(texts))
                    if exact:
                        held = group.words
                        stays = group.exact[word]
                        open_ = np.flatnonzero(~stays)
                        stays[open_] = [held[w] in texts[p] for w, p in zip(word[open_].tolist(), place[open_].tolist(), strict=True)]
                        word, place = word[stays], place[stays]
                    out = [(group.ids[word], names[place])]
                    for i, short in group.short if exact else ():
                        hits = names[[short in t for t in texts]]
                        out.append((np.full(len(hits), i), hits))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["word_id", "id"])

    return index.blocks.mapInArrow(run, "word_id long, id long")


def literal(word: Column) -> Column:
    """A pattern that matches the word itself, wherever it stands."""
    escaped = F.regexp_replace(word, r"([\\%_])", r"\\$1")
    return F.concat(F.lit("%"), escaped, F.lit("%"))


def candidates(words: DataFrame, index: Postings, most: int = MOST_GRAMS, word_chars: int = WORD_CHARS) -> DataFrame:
    """(word_id, id) of the texts that have all of a word's rarest trigrams; a superset of its matches."""
    asked = words.filter("word_id IS NOT NULL AND word IS NOT NULL").select("word_id", F.lower("word").alias("word"))
    return _lookup(asked, index, most, False, word_chars)


def search(words: DataFrame, texts: DataFrame, index: Postings, wildcards: bool = False, most: int = MOST_GRAMS, word_chars: int = WORD_CHARS) -> DataFrame:
    """(word_id, id) for words(word_id, word) in texts(id, content); with ``wildcards``, % and _ in a word are such."""
    asked = words.filter("word_id IS NOT NULL AND word IS NOT NULL").select("word_id", "word")
    wild = F.col("word").rlike(r"[%_\\]")
    plain = asked.filter(~wild) if wildcards else asked
    found = _lookup(plain.select("word_id", F.lower("word").alias("word")), index, most, True, word_chars)
    if not wildcards:
        return found
    own = texts.filter("content IS NOT NULL").select("id", "content")
    scanned = _scan(asked.filter(wild).withColumn("_pattern", F.concat(F.lit("%"), "word", F.lit("%"))), own)
    return found.unionByName(scanned.select("word_id", "id"))


def _scan(words: DataFrame, texts: DataFrame, most: int = MOST_SCANNED) -> DataFrame:
    """Patterns that no index helps with against all texts; at most ``most`` of them at once are sent to the texts."""
    n = words.count()
    parts = max(1, -(-n // most))
    part = F.pmod(F.xxhash64("word_id", "word"), F.lit(parts))
    found = [texts.join(F.broadcast(words.filter(part == k)), F.expr("content ILIKE _pattern")).select("word_id", "id") for k in range(parts)]
    return reduce(DataFrame.unionByName, found)
