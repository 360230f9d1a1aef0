"""Substring deduplication with fixed-block anchors (operator 3).

Windows are 50 consecutive words.  Non-overlapping blocks of 25 words of every document are the index,
every rolling run of 25 words is a probe; a window that two documents share holds a block of either.

1. Each batch of documents packs its probes (32 bits of hash, place) and blocks by hash bucket, each
   distinct probe once.  A bucket answers the probes that other documents share and marks those that
   are anchors, i.e. equal a block.
2. Per batch, anchors are extended over neighbouring shared runs: a window is a candidate where the runs
   at its start and 25 words on are shared and an anchor lies within.  Candidate windows of several
   documents of the batch are settled there; only those of the least document go on.
3. Candidate windows meet by hash; those that start in a document with a smaller id are removed, and
   with them the words they cover.  Texts are joined only to write what is left.

Nothing hot gathers anywhere: a passage that a third of all documents share crosses either shuffle once
per batch.  Buckets hold about ``BUCKET_WORDS`` probes; their number follows the input.

Ids are integers.  Rows are told apart by their place in the scan, so ``docs`` should be read from files
(write what comes out of a shuffle first).

Defined results: null and empty texts have no words; a null id is larger than all others; rows that
repeat an id never remove each other's words; documents under 50 words stay whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, slices, table, text_bytes
from .wordhash import chunks, hash_words, mix, windows

WINDOW = 50
BUCKET_WORDS = 1_000_000
#: Words whose probes are packed together, but for a single longer document.
BATCH_WORDS = 2_000_000
NO_ID = (1 << 63) - 1
PACKED = "key long, kind int, batch long, a binary, b binary, c binary"
ANSWER = "batch long, kind int, a binary, b binary, c binary"
INDEX, PROBE, DOCS, SAME = range(4)


def _squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _expanded(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=dtype)


def _pack(rows: np.ndarray, ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray, place: np.ndarray, block: int, buckets: int) -> list[tuple]:
    """Rows of PACKED for one batch; hashes of the runs at ``place`` (words of the batch, counted on)."""
    starts = np.cumsum(counts) - counts
    batch = int(rows[0])
    out = [(-1 - batch, DOCS, batch, _squeezed(rows), _squeezed(ids), _squeezed(counts))]
    if not len(hashes):
        return out
    doc = np.searchsorted(starts, place, side="right") - 1
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    first = order[new]
    # Ids decide, not rows: rows that repeat an id do not share anything with each other.
    several = np.zeros(len(first), dtype=bool)
    several[group[np.flatnonzero(ids[doc[order]] != ids[doc[first[group]]])]] = True
    leader = np.empty(len(order), dtype=np.int64)
    leader[order] = first[group]
    is_first = leader == np.arange(len(order))
    flag = np.zeros(len(order), dtype=bool)
    flag[first] = several
    same = np.flatnonzero(~is_first)
    if len(same):
        out.append((-1 - batch, SAME, batch, _squeezed(place[same].astype(np.int32)), _squeezed(place[leader[same]].astype(np.int32)), b""))
    aligned = np.zeros(len(order), dtype=bool)
    aligned[leader[np.flatnonzero((place - starts[doc]) % block == 0)]] = True
    for kind, chosen in ((INDEX, aligned), (PROBE, is_first)):
        at = np.flatnonzero(chosen)
        bucket = (((hashes[at] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
        at, bucket = at[by], bucket[by]
        low = hashes[at].astype(np.uint32)
        cuts = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if kind == INDEX:
                out.append((int(bucket[x]), kind, batch, low[x:y].tobytes(), b"", b""))
            else:
                out.append((int(bucket[x]), kind, batch, low[x:y].tobytes(), _squeezed(np.diff(place[at[x:y]], prepend=0).astype(np.int32)), np.packbits(flag[at[x:y]]).tobytes()))
    return out


def packed_probes(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Rows of PACKED from docs(row, id, text)."""
    block = window // 2

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(parts):
            rows, ids, counts, hashes, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            packed = _pack(rows, ids, counts, hashes, place, block, buckets)
            fields = list(zip(*packed, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, types, strict=True)], ["key", "kind", "batch", "a", "b", "c"])

        parts, size = [], 0
        for batch in slices(batches, 2):
            row, ident = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [text_bytes(t) for t in batch.column(2).to_pylist()]
            for x, y in chunks(texts):
                words, counts = hash_words(texts[x:y])
                ends = np.cumsum(counts)
                runs = np.where(counts >= window, counts - block + 1, 0)
                place = np.repeat(ends - counts - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
                hashes = windows(words, block)[place] if len(place) else np.zeros(0, dtype=np.uint64)
                if size and size + len(words) > BATCH_WORDS:
                    yield record(parts)
                    parts, size = [], 0
                parts.append((row[x:y], ident[x:y], counts, hashes, place + size))
                size += len(words)
        if parts:
            yield record(parts)

    return docs.mapInArrow(pack, PACKED)


def _answer(group: pa.Table) -> pa.Table:
    """A bucket's shared probes; rows of other kinds go through."""
    kind = group.column("kind").to_numpy()
    if kind[0] in (DOCS, SAME):
        return group.select(["batch", "kind", "a", "b", "c"])
    a, b, c, batch, key = (group.column(n).to_pylist() for n in ("a", "b", "c", "batch", "key"))
    index = [np.frombuffer(a[i], dtype=np.uint32) for i in np.flatnonzero(kind == INDEX)]
    index = np.unique(np.concatenate(index)) if index else np.zeros(0, dtype=np.uint32)
    probes = np.flatnonzero(kind == PROBE)
    out = []
    if len(probes):
        low = [np.frombuffer(a[i], dtype=np.uint32) for i in probes]
        flags = [np.unpackbits(np.frombuffer(c[i], dtype=np.uint8))[: len(x)].astype(bool) for i, x in zip(probes, low, strict=True)]
        everything = np.concatenate(low)
        ordered = np.sort(everything)
        shared = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], everything[np.concatenate(flags)]]))
        anchors = shared[np.isin(shared, index, assume_unique=True)]
        if len(anchors):
            for i, x in zip(probes, low, strict=True):
                at = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
                hit = np.flatnonzero(shared[at] == x)
                if len(hit):
                    place = np.cumsum(_expanded(b[i], np.int32), dtype=np.int32)[hit]
                    name = (np.uint64(key[i]) << np.uint64(32)) | x[hit].astype(np.uint64)
                    out.append((batch[i], PROBE, _squeezed(place), name.tobytes(), np.packbits(np.isin(x[hit], anchors)).tobytes()))
    fields = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(f, t) for f, t in zip(fields, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["batch", "kind", "a", "b", "c"])


WINDOWS = "w long, row long, id long, at int, lead boolean"


def _extend(window: int):
    block = window // 2

    def extend(group: pa.Table) -> pa.Table:
        """Candidate windows of one batch; lead: of the least id that has the window here."""
        kinds, a, b, c = (group.column(n).to_pylist() for n in ("kind", "a", "b", "c"))
        of = lambda k: [i for i, x in enumerate(kinds) if x == k]
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())], names=["w", "row", "id", "at", "lead"])
        hits = of(PROBE)
        if not hits:
            return empty
        d = of(DOCS)[0]
        rows, ids, counts = (_expanded(x[d], np.int64) for x in (a, b, c))
        total = int(counts.sum())
        name = np.zeros(total + window, dtype=np.uint64)
        shared, anchor = np.zeros(total + window, dtype=bool), np.zeros(total + window, dtype=bool)
        for i in hits:
            place = _expanded(a[i], np.int32)
            name[place], shared[place] = np.frombuffer(b[i], dtype=np.uint64), True
            anchor[place] = np.unpackbits(np.frombuffer(c[i], dtype=np.uint8))[: len(place)].astype(bool)
        for i in of(SAME):
            place, leader = _expanded(a[i], np.int32), _expanded(b[i], np.int32)
            name[place], shared[place], anchor[place] = name[leader], shared[leader], anchor[leader]
        anchored = np.concatenate([[0], np.cumsum(anchor)])
        s = np.flatnonzero(shared[:total] & shared[block : block + total])
        ends = np.cumsum(counts)
        doc = np.searchsorted(ends, s, side="right")
        good = (s + window <= ends[doc]) & (anchored[s + block + 1] > anchored[s])
        s, doc = s[good], doc[good]
        if not len(s):
            return empty
        w = mix(name[s] * np.uint64(0x9E3779B97F4A7C15) + mix(name[s + block]))
        order = np.lexsort((ids[doc], w))
        s, doc, w = s[order], doc[order], w[order]
        new = np.ones(len(w), dtype=bool)
        new[1:] = w[1:] != w[:-1]
        least = ids[doc][np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))]
        at = (s - (ends[doc] - counts[doc])).astype(np.int32)
        return pa.table([pa.array(w.view(np.int64)), pa.array(rows[doc]), pa.array(ids[doc]), pa.array(at), pa.array(ids[doc] == least)], names=["w", "row", "id", "at", "lead"])

    return extend


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, at) of the windows that a smaller id has too; rows come sorted by (w, id)."""
    last_w, last_id = None, None
    for batch in batches:
        w, row, ident, at = (batch.column(i).to_numpy() for i in range(4))
        lead = batch.column(4).to_numpy(zero_copy_only=False)
        gone = ~lead
        k = np.flatnonzero(lead)
        if len(k):
            x, y = w[k], ident[k]
            new = np.ones(len(x), dtype=bool)
            new[1:] = x[1:] != x[:-1]
            first = y[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
            if x[0] == last_w:
                first = np.where(np.cumsum(new) == 1, last_id, first)
            last_w, last_id = x[-1], first[-1]
            gone[k[y > first]] = True
        if gone.any():
            yield pa.RecordBatch.from_arrays([pa.array(row[gone]), pa.array(at[gone])], ["row", "at"])


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, starts array<int>) of docs(row, id, text): windows that also start in a document with a smaller id."""
    if window % 2 or window > 128:
        raise ValueError("window must be even and at most 128 words")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(size) // (6 * BUCKET_WORDS)))
    answers = packed_probes(docs, window, buckets).groupBy("key").applyInArrow(_answer, ANSWER)
    found = materialise(answers.groupBy("batch").applyInArrow(_extend(window), WINDOWS), "repeat-windows")
    dealt = found.repartition(shuffle_partitions(spark), F.when(F.col("lead"), F.col("w")).otherwise(F.col("row"))).sortWithinPartitions("w", "id")
    return dealt.mapInArrow(_repeats, "row long, at int").groupBy("row").agg(F.collect_list("at").alias("starts"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space), spans of removed words."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    starts = materialise(repeated_windows(rows, window), "repeat-starts")
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            n_words, n_removed, digests, kept, spans = [], [], [], [], []
            for text, at in zip(batch.column(1), batch.column(2), strict=True):
                words = text_bytes(text.as_py()).split()
                n_words.append(len(words))
                removed: list = []
                if at.is_valid:
                    covered = np.zeros(len(words) + 1, dtype=np.int64)
                    begin = at.values.to_numpy()
                    np.add.at(covered, begin, 1)
                    np.add.at(covered, begin + window, -1)
                    gone = np.cumsum(covered)[:-1] > 0
                    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    removed = [{"at": int(x), "words": int(y - x)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                left = b" ".join(words)
                n_removed.append(sum(r["words"] for r in removed))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace"))
                spans.append(removed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(kept), pa.array(spans, span)], [id_col, "n_words", "n_removed", "kept_sha256", "kept", "spans"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    joined = keyed.join(starts, "row", "left").select("id", "text", "starts")
    return joined.mapInArrow(cut, f"`{id_col}` {id_type}, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<at: bigint, words: bigint>>")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
