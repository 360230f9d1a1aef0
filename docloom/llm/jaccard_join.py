"""Exact n-gram Jaccard join by universe-partition pigeonhole (operator 9).

A document's set holds its distinct 5-word shingles (fewer words: the whole sequence).  Documents link
when 100 * intersection >= 80 * union.  Equal sets are one class from the start; classes are joined.

Candidates.  Linked sets of which the smaller has s elements differ in at most s/4.  Sizes fall into
bands (each ``BAND`` times the one before, so linked sets are in one band or in neighbours), and each
band cuts the universe of shingles by hash into m segments, more than the differences that links of that
band may have.  So linked sets agree on some whole segment.  Each set indexes the subsets that it has in the segments of
its own band and of the one below (for partners there).

Cost-based allocation.  A segment gets 0, 1 or 2 of the differences to absorb: 0 if the set has nothing
in it or its subset is too frequent, 1 if the subset itself is indexed, 2 if its one-deletion
neighbourhood is indexed too (the partner's subset with one element less).  Linked sets are found if one
of the two has more allocated than differences allowed.  Neighbourhoods cost an entry per element, spare
segments an entry each; bands whose spare segments make up for the expected empty ones use those, and
smaller bands use neighbourhoods.

A class whose hits are fewer than what linked sets must share is left out before anything is shuffled.

Groups of equal entries are never paired in full: all members of a group have its least class as candidate;
those that share as many entries with it as their allocation guarantees are verified exactly, and verified
links are contracted to components.  Only groups that still span several components are looked at again:
members of different components are compared where that makes at most ``GROUP`` pairs per member.  Entries
with more pairs get 0.

Classes that lose more than half of their spare allocation that way (a frequent passage fills most of
them), or have too little from the start (too many empty segments), are weak.  Two weak classes are found by their shingles (``hot_part_pairs``): shingles of at most
``GROUP`` weak classes pair them directly (prefix filter with positions); what the other, hot, shingles alone
can link is found through the smallest class of each distinct hot part, one candidate per class; the hot
parts themselves are joined in the same way.

Before entries are shuffled, each task combines the equal entries of its batch into one and packs them
by hash bucket; a hot entry crosses the shuffle once per batch, not once per document.  Rows are told
apart by their place in the scan, so ``docs`` should be read from files.

Shingles, subsets and classes are 64-bit hashes.

Defined results: null and empty texts have empty sets, n_shingles 0, their own id as component_id, and
link with nothing; rows with null ids take part, components without any id have a null component_id; rows
that repeat an id give a row each; an empty table gives no rows; other columns are carried by
``keep_one_per_component`` and ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import expanded as _expanded
from .common import fresh, materialise, release, slices, table, text_batches, text_bytes
from .common import squeezed as _squeezed
from .components import connected_components
from .wordhash import chunks, hash_words, mix, short_sequence, windows

WIDTH = 5
BAND = 1.6
SPARE = 1.25
GROUP = 64
#: Documents whose classes a task remembers so as to emit copies once.
SEEN = 1_000_000
#: Entries that are packed together, and shingles per bucket.
BATCH_ENTRIES = 700_000
BUCKET_SHINGLES = 2_000_000
#: Bits of an entry beside its bucket.
NAME_BITS = 40


@cache
def bands(upto: int = 1 << 40) -> tuple[int, ...]:
    """Least sizes of the bands.  Sets of fewer than 4 link only when equal."""
    least = [4]
    while least[-1] < upto:
        least.append(math.ceil(least[-1] * BAND))
    return tuple(least)


def allowed(size):
    """Most elements in which a set of this size and a linked one that is not smaller differ."""
    return size // 4


@cache
def allocation(band: int) -> tuple[int, bool]:
    """(segments, whether neighbourhoods are indexed) of a band."""
    largest = bands()[band + 1] - 1
    m = math.ceil(SPARE * (allowed(largest) + 1)) + 2
    empty = m * (1 - 1 / m) ** largest
    spare = m - allowed(largest) - 1
    return m, spare < empty + 4 * math.sqrt(empty)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, sorted distinct shingles of all texts of a chunk one after another, number of each text)."""
    for start, end in chunks(texts):
        words, counts = hash_words(texts[start:end])
        ends = np.cumsum(counts)
        begins = ends - counts
        n = np.maximum(counts - width + 1, 0)
        first = np.repeat(begins - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        h = windows(words, width)[first] if n.sum() else np.zeros(0, dtype=np.uint64)
        doc = np.repeat(np.arange(len(counts)), n)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            h = np.concatenate([h, *(short_sequence(words[begins[i] : ends[i]], width) for i in short)])
            doc = np.concatenate([doc, short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        yield start, h[new], np.bincount(doc[new], minlength=len(counts))


def class_keys(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set (0 for an empty one)."""
    keys = np.zeros(len(sizes), dtype=np.uint64)
    full = sizes > 0
    if full.any():
        begins = (np.cumsum(sizes) - sizes)[full]
        keys[full] = mix(np.add.reduceat(mix(shingles ^ np.uint64(0xA5A5A5A5DEADBEEF)), begins) + sizes[full].astype(np.uint64))
    return keys


def _band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(bands()), sizes, side="right") - 1


def _entries(shingles: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(entries, set of each, 0, slack of each set), and the same with 1 for the band below.

    slack: what is allocated beyond the differences allowed, less one; 0 or more means that all links
    within the band are found.
    """
    least = np.array(bands())
    own = _band_of(sizes)
    for lower in (0, 1):
        band = own - lower
        use = (sizes >= 4) & (band >= 0)
        if lower:
            use &= sizes <= (least[np.maximum(own, 0)] - 1) * 5 // 4
        if not use.any():
            continue
        ms = np.zeros(len(sizes), dtype=np.uint64)
        deep = np.zeros(len(sizes), dtype=bool)
        most = np.zeros(len(sizes), dtype=np.int64)
        for b in np.unique(band[use]):
            at = use & (band == b)
            m, d = allocation(int(b))
            ms[at], deep[at] = m, d
            most[at] = allowed(np.minimum(sizes[at], least[b + 1] - 1))
        of = np.repeat(np.arange(len(sizes)), sizes)
        picked = use[of]
        h, of = shingles[picked], of[picked]
        segment = ((h >> np.uint64(32)) * ms[of]) >> np.uint64(32)
        new = np.ones(len(h), dtype=bool)
        new[1:] = (segment[1:] != segment[:-1]) | (of[1:] != of[:-1])
        begins = np.flatnonzero(new)
        value = mix(h)
        sums = np.add.reduceat(value, begins)
        holds = np.diff(np.concatenate([begins, [len(h)]]))
        owner = of[begins]
        salt = mix(segment[begins] + (band[owner].astype(np.uint64) << np.uint64(40)) + np.uint64(1))
        exact = mix(sums + salt)
        allocated = np.bincount(owner, weights=np.where(deep[owner] & (holds > 1), 2, 1), minlength=len(sizes)).astype(np.int64)
        slack = np.where(use, allocated - most - 1, 1 << 30)
        entries, sets = [exact], [owner]
        inner = np.repeat(deep[owner] & (holds > 1), holds)
        if inner.any():
            group = np.repeat(np.arange(len(begins)), holds)[inner]
            entries.append(mix(sums[group] - value[inner] + salt[group]))
            sets.append(owner[group])
        entries, sets = np.concatenate(entries), np.concatenate(sets)
        yield entries, sets, lower, slack


def _texts(column: pa.Array) -> list[bytes]:
    """Texts with A-Z in lower case."""
    return [text_bytes(t).lower() for t in column.to_pylist()]


def document_classes(docs: DataFrame) -> DataFrame:
    """(row, id, n_shingles, cls) per row of docs(row, id, text)."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            sizes, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
            for _, shingles, n in shingle_sets(_texts(batch.column(2))):
                sizes.append(n)
                keys.append(class_keys(shingles, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(keys).view(np.int64))], ["row", "id", "n_shingles", "cls"])

    return docs.mapInArrow(classes, f"row long, id {docs.schema['id'].dataType.simpleString()}, n_shingles long, cls long")


PACKED = "key long, kind int, batch long, a binary, b binary, c binary"
#: lower: 0 for entries of the class's own band, 1 for those of the band below.
MEMBERS = "entry long, cls long, lower int, own int, size int, slack int"
ENTRIES, CLASSES, SAME = range(3)
SHORT = -1


def _pack(batch: int, keys: np.ndarray, bands_: np.ndarray, sizes: np.ndarray, slacks: np.ndarray, entries: np.ndarray, owner: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of PACKED for one batch of classes.

    owner: twice the number of the class in the batch, plus 1 for entries of the band below.  Each
    distinct entry goes to its bucket once; entries of several classes are listed for the batch itself.
    """
    out = [(-1 - batch, CLASSES, batch, _squeezed(keys), _squeezed(np.stack([bands_, sizes]).astype(np.int32)), _squeezed(slacks.astype(np.int32)))]
    order = np.lexsort((owner, entries)).astype(np.int32)
    entries, owner = entries[order], owner[order]
    del order
    new = np.ones(len(entries), dtype=bool)
    new[1:] = entries[1:] != entries[:-1]
    lead = np.flatnonzero(new).astype(np.int32)
    times = np.diff(lead, append=np.int32(len(entries)))
    several = times > 1
    member = np.repeat(several, times)
    if member.any():
        out.append((-1 - batch, SAME, batch, _squeezed(entry_names(entries[member], buckets)), _squeezed(owner[member].astype(np.int32)), b""))
    entries, owner = entries[lead], owner[lead]
    del new, lead, times, member
    bucket = bucket_of(entries, buckets).astype(np.int32)
    by = np.lexsort((owner, bucket)).astype(np.int32)
    entries, owner, bucket, several = entries[by], owner[by], bucket[by], several[by]
    del by
    cuts = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        out.append((int(bucket[x]), ENTRIES, batch, _low_bytes(entries[x:y]), _squeezed(np.diff(owner[x:y], prepend=0).astype(np.int32)), np.packbits(several[x:y]).tobytes()))
    return out


def bucket_of(entries: np.ndarray, buckets: int) -> np.ndarray:
    return (((entries >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def entry_names(entries: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and low NAME_BITS of an entry: its name from the bucket on."""
    return ((bucket_of(entries, buckets).astype(np.uint64) << np.uint64(NAME_BITS)) | (entries & np.uint64((1 << NAME_BITS) - 1))).view(np.int64)


def _low_bytes(entries: np.ndarray) -> bytes:
    """The low 40 bits: 4 bytes of each, then 1 of each."""
    return entries.astype(np.uint32).tobytes() + (entries >> np.uint64(32)).astype(np.uint8).tobytes()


def _low_bits(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, dtype=np.uint32, count=n).astype(np.int64) | (np.frombuffer(raw, dtype=np.uint8, offset=4 * n).astype(np.int64) << np.int64(32))


def packed_entries(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of PACKED for all classes of docs(row, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()

        def record(batch: int, parts: list) -> pa.RecordBatch:
            columns = [[*x] for x in zip(*parts, strict=True)]
            parts.clear()
            packed = _pack(batch, *(np.concatenate(columns.pop(0)) for _ in range(len(columns))), buckets)
            types = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(zip(*packed, strict=True), types, strict=True)], ["key", "kind", "batch", "a", "b", "c"])

        parts, size, classes, first = [], 0, 0, None
        for batch in slices(batches, 1):
            rows = batch.column(0).to_pylist()
            for start, shingles, n in shingle_sets(_texts(batch.column(1))):
                keys = class_keys(shingles, n).view(np.int64)
                fresh_set = np.zeros(len(keys), dtype=bool)
                for i, key in enumerate(keys.tolist()):
                    if n[i] >= 4 and key not in seen:
                        seen.add(key)
                        fresh_set[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                shingles, n, keys = shingles[np.repeat(fresh_set, n)], n[fresh_set], keys[fresh_set]
                if not len(keys):
                    continue
                first = rows[start] if first is None else first
                entries, owner, slacks = [], [], np.full((len(keys), 2), 1 << 30, dtype=np.int64)
                for found, sets, lower, slack in _entries(shingles, n):
                    entries.append(found)
                    owner.append(((sets + classes) * 2 + lower).astype(np.int32))
                    slacks[:, lower] = slack
                parts.append((keys, _band_of(n), n, slacks.ravel(), np.concatenate(entries), np.concatenate(owner)))
                size += len(parts[-1][4])
                classes += len(keys)
                if size > BATCH_ENTRIES:
                    yield record(first, parts)
                    parts, size, classes, first = [], 0, 0, None
        if parts:
            yield record(first, parts)

    return docs.mapInArrow(emit, PACKED)


def repeated(low: list[np.ndarray], pieces: int = 8) -> np.ndarray:
    """The numbers of NAME_BITS bits that occur more than once in the arrays, sorted; one piece of their range at a time."""
    out = []
    for k in range(pieces):
        ordered = np.concatenate([x[(x * pieces) >> NAME_BITS == k] for x in low])
        ordered.sort()
        out.append(np.unique(ordered[1:][ordered[1:] == ordered[:-1]]))
    return np.concatenate(out)


def _bucket_hits(group: pa.Table) -> pa.Table:
    """The entries of a bucket that several batches have, or several classes of a batch."""
    names = ["batch", "kind", "a", "b", "c"]
    kind = group.column("kind").to_numpy()
    if kind[0] != ENTRIES:
        return group.select(names)
    key = group.column("key")[0].as_py()
    a, b, c, batch = (group.column(n).to_pylist() for n in ("a", "b", "c", "batch"))
    low = [_low_bits(x) for x in a]
    flags = [np.unpackbits(np.frombuffer(f, dtype=np.uint8))[: len(x)].astype(bool) for f, x in zip(c, low, strict=True)]
    del a
    shared = repeated(low)
    out = []
    for x, f, owners, of in zip(low, flags, b, batch, strict=True):
        # Entries of several classes of the batch are listed there already.
        hit = np.flatnonzero(np.isin(x, shared) & ~f)
        if len(hit):
            out.append((of, ENTRIES, _squeezed((np.int64(key) << np.int64(NAME_BITS)) | x[hit]), _squeezed(np.cumsum(_expanded(owners, np.int32), dtype=np.int32)[hit]), b""))
    fields = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(f, t) for f, t in zip(fields, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)


def _batch_members(group: pa.Table) -> pa.Table:
    """Rows of MEMBERS of one batch; classes whose allocation falls short have the entry SHORT too."""
    kinds, a, b, c = (group.column(n).to_pylist() for n in ("kind", "a", "b", "c"))
    at = kinds.index(CLASSES)
    keys, (own, size), slack = _expanded(a[at], np.int64), _expanded(b[at], np.int32).reshape(2, -1), _expanded(c[at], np.int32)
    rest = [i for i, k in enumerate(kinds) if k != CLASSES]
    entries = np.concatenate([_expanded(a[i], np.int64) for i in rest]) if rest else np.zeros(0, dtype=np.int64)
    owner = np.concatenate([_expanded(b[i], np.int32) for i in rest]) if rest else np.zeros(0, dtype=np.int32)
    # Linked sets share a number of entries at least; with fewer hits a class links with nothing in that band.
    band = np.repeat(own, 2) - np.tile([0, 1], len(own)).astype(own.dtype)
    enough = np.bincount(owner, minlength=len(slack)) >= needed(slack.astype(np.int64), band)
    short = np.flatnonzero(slack < 0).astype(owner.dtype)
    entries = np.concatenate([entries[enough[owner]], np.full(len(short), SHORT, dtype=np.int64)])
    owner = np.concatenate([owner[enough[owner]], short])
    who = owner // 2
    columns = (entries, keys[who], owner % 2, own[who], size[who], slack[owner])
    return pa.table([pa.array(x) for x in columns], names=["entry", "cls", "lower", "own", "size", "slack"])


@cache
def first_plain_band() -> int:
    """From this band on segments are indexed without neighbourhoods."""
    return next(b for b in range(len(bands()) - 1) if not allocation(b)[1])


def needed(slack: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Entries that linked sets share at least: what is allocated beyond the differences, 2 for a segment with neighbourhood."""
    return np.maximum(1, np.where(band >= first_plain_band(), slack + 1, slack // 2 + 1))


def _needed(slack: F.Column, band: F.Column) -> F.Column:
    return F.greatest(F.lit(1), F.when(band >= first_plain_band(), slack + 1).otherwise(F.floor(slack / 2) + 1))


def shared_entries(docs: DataFrame, n_shingles: int) -> DataFrame:
    """Rows of MEMBERS: the entries that several classes have, with each of these classes once or more."""
    buckets = max(1, -(-n_shingles // BUCKET_SHINGLES))
    hits = packed_entries(docs, buckets).groupBy("key").applyInArrow(_bucket_hits, "batch long, kind int, a binary, b binary, c binary")
    return hits.groupBy("batch").applyInArrow(_batch_members, MEMBERS)


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the rows wanted(wanted_row) of docs(row, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            for _, shingles, n in shingle_sets(_texts(batch.column(0))):
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(class_keys(shingles, n).view(np.int64)), lists], ["cls", "shingles"])

    rows = docs.join(wanted, F.col("row") == F.col("wanted_row"), "left_semi").select("text")
    return rows.mapInArrow(sets, "cls long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = pairs.join(sets.withColumnRenamed("shingles", "sa"), pairs.a == sets.cls).select("a", "b", "sa")
    both = left.join(sets.withColumnRenamed("shingles", "sb"), left.b == F.col("cls")).select("a", "b", "sa", "sb")

    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= 80 * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a <> b").distinct()


def _matching_sizes(x, y) -> F.Column:
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return (5 * x >= 4 * y) & (5 * y >= 4 * x)


def _cross_pairs(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, busy): pairs of rows(key, cls, component, ...) with equal key and different components.

    Only members outside a key's largest component are joined with all its members, so members of one
    component never meet.  Keys with more than ``most`` such pairs per member are left out and listed in
    busy (the rows of ``rows`` with these keys).  Pairs have x and y as aliases of their rows.
    """
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("n"))
    stats = sizes.groupBy(key).agg(F.sum("n").alias("members"), F.sum(F.col("n") * F.col("n")).alias("inner"), F.max(F.struct("n", "component")).alias("top"))
    stats = stats.filter(F.col("top.n") < F.col("members")).select(F.col(key).alias("k"), F.col("top.component").alias("largest"), ((F.col("members") * F.col("members") - F.col("inner")) / 2 > F.lit(most) * F.col("members")).alias("busy"))
    open_rows = materialise(rows.join(stats, F.col(key) == F.col("k")).drop("k"), "jaccard-open")
    few = open_rows.filter("NOT busy")
    x, y = few.filter("component <> largest").alias("x"), few.alias("y")
    # Two members outside the largest component meet once.
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.cls") < F.col("y.cls"))
    pairs = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.component") != F.col("y.component")) & once)
    return pairs, open_rows.filter("busy")


def _prefix(n, size) -> F.Column:
    """How many of a set's n tokens, rarest first, hold one that any linked set has too; size: of the whole set."""
    return n - F.ceil(size * 4 / 5) + 1


def hot_part_pairs(tokens: DataFrame, most: int) -> DataFrame:
    """Candidates (a, b) of different components for all links among tokens(cls, component, size, shingle).

    ``size`` is the size of the set; its tokens may be a part of it, where only these can be shared.  Hot are
    shingles of more than ``most`` classes.  Links that share a shingle which is not hot share one in their
    prefixes, where each meets at most ``most`` others.  Links that share hot shingles alone depend on the hot
    parts P, Q and the sizes: with the smallest class of each part, y of Q, a class x of P links if
    9 * |P & Q| >= 4 * (|x| + |y|), and then so does the smallest class of P.  So one candidate y for each x and
    the pairs of smallest classes keep all components together.
    """
    # Members of different components share no shingle that occurs in one component alone.
    counts = tokens.groupBy("shingle").agg(F.count("*").alias("classes"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").drop("c0", "c1")
    ranked = tokens.join(counts, "shingle").withColumn("hot", F.col("classes") > most)
    in_class = Window.partitionBy("cls")
    ranked = ranked.withColumn("rank", F.row_number().over(in_class.orderBy("hot", "classes", "shingle"))).withColumn("n", F.count("*").over(in_class))
    ranked = ranked.filter(_prefix(F.col("n"), F.col("size")) > 0)
    ranked = materialise(ranked.filter(F.col("hot") | (F.col("rank") <= _prefix(F.col("n"), F.col("size")))).drop("classes"), "jaccard-ranked")

    # Shingles that are not hot.
    x, y = ranked.filter("NOT hot").alias("x"), ranked.filter("NOT hot").alias("y")
    rest = F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank")) + 1
    reach = 9 * rest >= 4 * (F.col("x.size") + F.col("y.size"))
    own = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.component") != F.col("y.component")) & reach & _matching_sizes("x.size", "y.size"))
    found = own.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))

    # Hot parts of the classes whose prefix reaches into them.
    part = F.bit_xor(F.xxhash64("shingle")).alias("p"), F.bit_xor(F.xxhash64(F.lit(7), "shingle")).alias("q")
    parts = ranked.filter("hot").groupBy("cls", "component", "size", "n").agg(*part, F.count("*").alias("n_hot"))
    parts = materialise(parts.filter(F.col("n") - F.col("n_hot") < _prefix(F.col("n"), F.col("size"))), "jaccard-parts")
    least = F.min(F.struct("size", "cls", "component")).alias("least")
    groups = parts.groupBy("p", "q", "n_hot").agg(least, F.count("*").alias("members"))
    groups = materialise(groups.select("p", "q", "n_hot", F.col("least.cls").alias("hub"), F.col("least.size").alias("hub_size"), F.col("least.component").alias("hub_component"), "members"), "jaccard-parts")
    inside = parts.join(groups, ["p", "q", "n_hot"]).filter((F.col("component") != F.col("hub_component")) & (9 * F.col("n_hot") >= 4 * (F.col("size") + F.col("hub_size"))))
    found = found.unionByName(inside.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")))
    n_groups = groups.count()
    if n_groups < 2:
        return found.distinct()
    hubs = ranked.filter("hot").join(groups.select(F.col("hub").alias("cls")), "cls", "left_semi").select("cls", "component", "size", "shingle")
    # Hot shingles of classes may be rare among distinct hot parts; where they are not, more pairs are allowed.
    deeper = materialise(hot_part_pairs(hubs, most if n_groups < parts.count() / 2 else 4 * most), "jaccard-hubs")
    bags = hubs.groupBy("cls").agg(F.collect_list("shingle").alias("bag"))
    common = deeper.join(bags.withColumnRenamed("cls", "a").withColumnRenamed("bag", "bag_a"), "a").join(bags.withColumnRenamed("cls", "b").withColumnRenamed("bag", "bag_b"), "b").select("a", "b", F.size(F.array_intersect("bag_a", "bag_b")).alias("shared"))
    both = common.select("a", "b", "shared").union(common.select("b", "a", "shared"))
    other = groups.select(F.col("hub").alias("b"), "hub_size", "hub_component")
    # The other part whose hub takes the largest classes of this one.
    best = both.join(other, "b").groupBy(F.col("a").alias("hub")).agg(F.max(F.struct((F.floor(F.col("shared") * 9 / 4) - F.col("hub_size")).alias("upto"), F.col("b").alias("to"), F.col("hub_component").alias("to_component"))).alias("best"))
    reached = groups.select("p", "q", "n_hot", "hub").join(best, "hub").select("p", "q", "n_hot", "best.*")
    across = parts.join(reached, ["p", "q", "n_hot"]).filter((F.col("size") <= F.col("upto")) & (F.col("component") != F.col("to_component")) & (F.col("cls") != F.col("to")))
    return found.unionByName(deeper.select("a", "b")).unionByName(across.select(F.least("cls", "to").alias("a"), F.greatest("cls", "to").alias("b"))).distinct()


def class_components(docs: DataFrame, per_row: DataFrame) -> DataFrame:
    """(node, component) of the classes that link with another one.  ``docs`` is (row, id, text)."""
    n_shingles = per_row.agg(F.sum("n_shingles")).first()[0] or 0
    raw = materialise(shared_entries(docs.select("row", "text"), int(n_shingles)).distinct(), "jaccard-entries")
    short = raw.filter(F.col("entry") == SHORT).select("cls").distinct()
    entries = raw.filter(F.col("entry") != SHORT)
    centers = entries.groupBy("entry").agg(F.min(F.struct("cls", "size")).alias("center"), F.max("cls").alias("last")).filter("center.cls <> last").select("entry", "center")
    # One row per class and band, with its entries and their centers; classes with too few shared entries go.
    listed = entries.join(centers, "entry").groupBy("cls", "lower", "own", "size", "slack").agg(F.collect_list("entry").alias("entries"), F.collect_set("center").alias("centers"))
    lists = materialise(listed.withColumn("band", F.col("own") - F.col("lower")).filter(F.size("entries") >= _needed(F.col("slack"), F.col("band"))), "jaccard-lists")
    short = materialise(short, "jaccard-short")
    release(raw)
    touched = lists.select("cls").union(short).select(F.col("cls").alias("c")).distinct()
    first_rows = per_row.filter("n_shingles > 0").groupBy("cls").agg(F.min("row").alias("wanted_row"))
    wanted = first_rows.join(touched, F.col("cls") == F.col("c"), "left_semi").select("wanted_row")
    sets = materialise(class_sets(docs.select("row", "text"), wanted), "jaccard-sets")

    # All members of an entry with its least class, if they share enough entries.
    stars = lists.select("cls", "size", F.explode("centers").alias("center")).filter((F.col("cls") != F.col("center.cls")) & _matching_sizes("size", "center.size"))
    pairs = _pairs(stars.select("cls", F.col("center.cls").alias("center")), "cls", "center")
    mine = lists.select("cls", "band", "own", "slack", "entries")
    x, y = (mine.select(*(F.col(c).alias(f"{c}_{side}") for c in mine.columns)) for side in "ab")
    both = pairs.join(x, F.col("a") == F.col("cls_a")).join(y, (F.col("b") == F.col("cls_b")) & (F.col("band_a") == F.col("band_b")))
    likely = both.filter((F.col("band_a") == F.least("own_a", "own_b")) & (F.size(F.array_intersect("entries_a", "entries_b")) >= _needed(F.greatest("slack_a", "slack_b"), F.col("band_a"))))
    tested = materialise(likely.select("a", "b").distinct(), "jaccard-tested")
    edges = materialise(verified(tested, sets), "jaccard-edges")
    labels = connected_components(edges)

    # Entries that still span components.
    named = lists.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "band", "own", "size", "slack", F.coalesce("component", "cls").alias("component"), F.explode("entries").alias("entry"))
    pairs, busy = _cross_pairs(named, "entry", GROUP)
    lost = busy.groupBy("cls", "band").agg((F.count("*") * 2).alias("lost"))
    # What a class has left in a band without the busy entries; none where it is weak.
    state = materialise(lost.join(lists.select("cls", "band", "slack"), ["cls", "band"]).select("cls", "band", (F.col("slack") - F.col("lost")).alias("left"), (2 * (F.col("slack") - F.col("lost")) < F.col("slack")).alias("weak")), "jaccard-left")
    fit = pairs.filter((F.col("x.band") == F.col("y.band")) & (F.col("x.band") == F.least("x.own", "y.own")) & _matching_sizes("x.size", "y.size"))
    first = F.col("x.cls") < F.col("y.cls")
    side = lambda c: (F.when(first, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")), F.when(first, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
    (a, b), (slack_a, slack_b) = side("cls"), side("slack")
    shared = fit.groupBy(a.alias("a"), b.alias("b"), F.col("x.band").alias("band"), slack_a.alias("slack_a"), slack_b.alias("slack_b")).agg(F.count("*").alias("n"))
    for c in ("a", "b"):
        shared = shared.join(state.select(F.col("cls").alias(c), "band", F.when(F.col("weak"), -1).otherwise(F.col("left")).alias(f"left_{c}")), [c, "band"], "left")
    slack = F.greatest(F.coalesce("left_a", "slack_a"), F.coalesce("left_b", "slack_b"))
    likely = shared.filter((slack >= 0) & (F.col("n") >= _needed(slack, F.col("band"))))
    third = materialise(likely.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "jaccard-tested")
    more = materialise(verified(third, sets), "jaccard-edges")
    edges = edges.unionByName(more)

    weak = materialise(state.filter("weak").select("cls").union(short).distinct(), "jaccard-weak")
    if not weak.isEmpty():
        if not more.isEmpty():
            labels = connected_components(edges)
        mine = sets.join(weak, "cls").join(labels, F.col("cls") == F.col("node"), "left")
        tokens = materialise(mine.select("cls", F.coalesce("component", "cls").alias("component"), F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")), "jaccard-tokens")
        last = materialise(hot_part_pairs(tokens, GROUP), "jaccard-tested")
        edges = edges.unionByName(materialise(verified(last, sets), "jaccard-edges"))
        release(tokens)
    release(lists, sets, short)
    return connected_components(edges)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for every row."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    per_row = materialise(document_classes(rows), "jaccard-rows")
    parts = class_components(rows, per_row)
    classes = per_row.filter("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("least"))
    named = classes.join(parts, classes.cls == parts.node, "left").select("cls", "least", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = materialise(named.join(least, "component").select("cls", "component_id"), "jaccard-classes")
    full = per_row.filter("n_shingles > 0").join(of_class, "cls").select(F.col("id").alias(id_col), "n_shingles", "component_id")
    empty = per_row.filter("n_shingles = 0").select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id"))
    return full.unionByName(empty)


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, all columns.  Rows with null ids stay."""
    found = materialise(jaccard_components(docs, id_col, text_col), "jaccard-result")
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(fresh(docs.columns, "_gone")))
    return docs.join(gone, F.col(id_col) == F.col(gone.columns[0]), "left_anti")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
