"""Language-model scoring with a gated recurrent network (operator 8).

Training documents are those whose crc32(id as text) mod 7 is not 2.  Their words are counted in full
(distributed); the counts give the base score and the vocabulary of the network, its most frequent
words.  Other words are the token UNKNOWN, times their share of the counts outside the vocabulary.

The network is a GRU in numpy with a class-factored softmax (class, then word within class).  Training
is truncated backpropagation: windows of ``STEPS`` tokens, with the state carried from window to window
of a document.  It is one pass over all training documents in ``ROUNDS`` data-parallel rounds, each with
its share of the documents (by hash): every trainer takes whole documents, block after block, in the
order of their keys, and the trainers' parameters are averaged in Spark after the round.  Scoring reads every document whole, state carried to its end.

Defined results: a null text counts as empty, so its tokens are the end alone; a null id counts as the
empty text in the crc32; every input row gives one row, also where ids repeat; without training
documents the counts are 0 and the network is uniform; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import expanded, materialise, release, slices, squeezed, table, text_bytes
from .wordsums import FREQUENT_BYTES, count_words, sum_per_document

CLASSES, PER_CLASS, HIDDEN = 32, 32, 16
VOCABULARY = CLASSES * PER_CLASS
UNKNOWN, END = 0, 1
STEPS = 24
ROUNDS = 4
RATE = 0.01
#: Beyond so many trainers each takes more documents, in blocks of BLOCK_TOKENS (but for a single longer document).
MOST_TRAINERS = 128
BLOCK_TOKENS = 2_000_000
#: A block takes as many steps as its longest document, so a trainer gets a whole one: half a block would fill half the lanes.
TRAINER_TOKENS = BLOCK_TOKENS
#: Few enough lanes and rows in one product that BLAS does it in one thread: more only spin beside Spark's other tasks.
SCORE_LANES, TRAIN_LANES = 256, 256
PRODUCT_ROWS = 224
#: Words that a task gathers for scoring, and tokens that it scores at once, but for a single longer document.
GATHERED_WORDS, SCORE_TOKENS = 1_500_000, 2_000_000
SEGMENTS = 16


def lower_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _shapes() -> dict[str, tuple[int, ...]]:
    h = HIDDEN
    return {"e": (VOCABULARY, 3 * h), "u": (h, 3 * h), "b": (3 * h,), "wc": (h, CLASSES), "bc": (CLASSES,), "ww": (CLASSES, h, PER_CLASS), "bw": (CLASSES, PER_CLASS)}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _shapes().items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start_parameters(counts: np.ndarray) -> np.ndarray:
    """Small random weights; output biases start as the smoothed frequencies of the vocabulary."""
    random = np.random.Generator(np.random.PCG64(8))
    flat = np.concatenate([(random.standard_normal(int(np.prod(s))) * 0.1).astype(np.float32) for s in _shapes().values()])
    p = unpack(flat)
    weight = np.full(VOCABULARY, 1e-30)
    weight[: len(counts)] = counts + 0.5
    weight = weight.reshape(CLASSES, PER_CLASS)
    p["b"][:] = 0
    p["bc"][:] = np.log(weight.sum(1) / weight.sum())
    p["bw"][:] = np.log(weight / weight.sum(1, keepdims=True))
    p["wc"][:] *= 0.1
    p["ww"][:] *= 0.1
    return flat


def _lanes(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid one after another on lanes of about equal length.

    tokens[t, lane] (-1 past the end), input[t, lane] (END before a document), doc[t, lane].  No more
    lanes than keep the tables at about twice the tokens, however long the longest document is: it
    sets the number of steps in any case.
    """
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    longest = max((len(d) for d in docs), default=0)
    room = -(-2 * sum(map(len, docs)) // max(1, longest))
    lanes = max(1, min(lanes, len(docs), room))
    # First the long ones, then always onto the lane with the least.
    heap = [(0, k) for k in range(lanes)]
    placed: list[list[int]] = [[] for _ in range(lanes)]
    size = [0] * lanes
    for i in order:
        n, k = heapq.heappop(heap)
        placed[k].append(i)
        size[k] = n + len(docs[i])
        heapq.heappush(heap, (size[k], k))
    steps = max(size)
    tokens = np.full((steps, lanes), -1, dtype=np.int32)
    before = np.full((steps, lanes), END, dtype=np.int32)
    doc = np.full((steps, lanes), -1, dtype=np.int32)
    for k, mine in enumerate(placed):
        at = 0
        for i in mine:
            n = len(docs[i])
            tokens[at : at + n, k] = docs[i]
            before[at + 1 : at + n, k] = docs[i][:-1]
            doc[at : at + n, k] = i
            at += n
    return tokens, before, doc


def _states(p: dict, x: np.ndarray, starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States after each step of x[t, lane], and the last; starts marks where a document begins (state 0).

    Lanes are columns here, so that gates are whole blocks of memory.
    """
    n = HIDDEN
    states = np.empty((len(x), n, x.shape[1]), dtype=np.float32)
    table, u, begins = np.ascontiguousarray((p["e"] + p["b"]).T), np.ascontiguousarray(p["u"].T), starts.any(1)
    h = np.ascontiguousarray(h.T)
    for t in range(len(x)):
        if begins[t]:
            h = np.where(starts[t], np.float32(0), h)
        a = table.take(x[t], axis=1)
        g = u @ h
        gates = a[: 2 * n]
        gates += g[: 2 * n]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        c = g[2 * n :]
        c *= gates[:n]
        c += a[2 * n :]
        np.tanh(c, out=c)
        d = h - c
        d *= gates[n:]
        h = np.add(c, d, out=states[t])
    return states.transpose(0, 2, 1).reshape(-1, n), h.T


def _forward(p: dict, x: np.ndarray, starts: np.ndarray, h: np.ndarray):
    """States after each step, the last state, and what backpropagation needs (lanes are columns there)."""
    n, (steps, lanes) = HIDDEN, x.shape
    table, u, begins = np.ascontiguousarray((p["e"] + p["b"]).T), np.ascontiguousarray(p["u"].T), starts.any(1)
    before, inner, cand, states = (np.empty((steps, n, lanes), dtype=table.dtype) for _ in range(4))
    gates = np.empty((steps, 2 * n, lanes), dtype=table.dtype)
    h = np.ascontiguousarray(h.T)
    for t in range(steps):
        if begins[t]:
            h = np.where(starts[t], table.dtype.type(0), h)
        before[t] = h
        a, g = table.take(x[t], axis=1), u @ h
        both, c = gates[t], cand[t]
        np.add(a[: 2 * n], g[: 2 * n], out=both)
        np.negative(both, out=both)
        np.exp(both, out=both)
        both += 1
        np.reciprocal(both, out=both)
        inner[t] = g[2 * n :]
        np.multiply(both[:n], g[2 * n :], out=c)
        c += a[2 * n :]
        np.tanh(c, out=c)
        d = h - c
        d *= both[n:]
        h = np.add(c, d, out=states[t])
    return states.transpose(0, 2, 1), h.T, (before, gates, cand, inner)


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(logits) and its sums over classes and over words of a class, one column each.

    logits are lowered by their maxima where they are too large for that.
    """
    halves = np.zeros((CLASSES + PER_CLASS, 2), dtype=logits.dtype)
    halves[:CLASSES, 0] = halves[CLASSES:, 1] = 1
    sums = lambda e: np.concatenate([e[i : i + 8 * PRODUCT_ROWS] @ halves for i in range(0, max(1, len(e)), 8 * PRODUCT_ROWS)])
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(logits)
        total = sums(e)
    if not np.isfinite(total).all() or (total <= 0).any():
        for half in (logits[:, :CLASSES], logits[:, CLASSES:]):
            half -= half.max(1, keepdims=True)
        e = np.exp(logits)
        total = sums(e)
    return e, total


def _softmax_parts(p: dict, h: np.ndarray, y: np.ndarray, grads: dict | None):
    """Natural log probability of each y given h, and (with grads) the gradient on h.

    Rows are sorted by class, so that one product per class gives the logits of all classes and of its words.
    """
    n, kind = len(y), np.result_type(h, p["wc"])
    weights = np.empty((CLASSES, HIDDEN + 1, CLASSES + PER_CLASS), dtype=kind)
    weights[:, :-1, :CLASSES], weights[:, -1, :CLASSES] = p["wc"], p["bc"]
    weights[:, :-1, CLASSES:], weights[:, -1, CLASSES:] = p["ww"], p["bw"]
    order = np.argsort((y // PER_CLASS).astype(np.min_scalar_type(CLASSES)), kind="stable")
    target = y.take(order)
    cls, word, rows = target // PER_CLASS, CLASSES + target % PER_CLASS, np.arange(n)
    bounds = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    parts = [(k, slice(i, min(i + PRODUCT_ROWS, b))) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) for i in range(a, b, PRODUCT_ROWS)]
    states = np.ones((n, HIDDEN + 1), dtype=kind)
    states[:, :-1] = h.take(order, axis=0)
    logits = np.empty((n, CLASSES + PER_CLASS), dtype=kind)
    for k, at in parts:
        np.matmul(states[at], weights[k], out=logits[at])
    e, total = _exponentials(logits)
    logp = np.empty(n, dtype=kind)
    logp[order] = logits[rows, cls] + logits[rows, word] - np.log(total[:, 0]) - np.log(total[:, 1])
    if grads is None:
        return logp, None
    e[:, :CLASSES] /= total[:, :1]
    e[:, CLASSES:] /= total[:, 1:]
    e[rows, cls] -= 1
    e[rows, word] -= 1
    g, given = np.zeros_like(weights), np.empty((n, HIDDEN), dtype=kind)
    for k, at in parts:
        g[k] += states[at].T @ e[at]
        np.matmul(e[at], weights[k, :-1].T, out=given[at])
    grads["wc"] += g[:, :-1, :CLASSES].sum(0)
    grads["bc"] += g[:, -1, :CLASSES].sum(0)
    grads["ww"] += g[:, :-1, CLASSES:]
    grads["bw"] += g[:, -1, CLASSES:]
    dh = np.empty_like(given)
    dh[order] = given
    return logp, dh


def _backward(p: dict, x: np.ndarray, starts: np.ndarray, cache: tuple, dstates: np.ndarray, grads: dict) -> None:
    n, (steps, lanes) = HIDDEN, x.shape
    before, gates, cand, inner = cache
    r, z = gates[:, :n], gates[:, n:]
    # What dh is multiplied by for each gate.
    to_z, to_c, to_r = (before - cand) * z * (1 - z), (1 - z) * (1 - cand * cand), inner * r * (1 - r)
    given, begins = np.ascontiguousarray(dstates.transpose(0, 2, 1)), starts.any(1)
    da, dg = (np.empty((steps, 3 * n, lanes), dtype=gates.dtype) for _ in range(2))
    dh = np.zeros((n, lanes), dtype=gates.dtype)
    for t in range(steps - 1, -1, -1):
        dh += given[t]
        mine = da[t]
        np.multiply(dh, to_c[t], out=mine[2 * n :])
        np.multiply(dh, to_z[t], out=mine[n : 2 * n])
        np.multiply(mine[2 * n :], to_r[t], out=mine[:n])
        dg[t, : 2 * n] = mine[: 2 * n]
        np.multiply(mine[2 * n :], r[t], out=dg[t, 2 * n :])
        dh *= z[t]
        dh += p["u"] @ dg[t]
        if begins[t]:
            dh[:, starts[t]] = 0
    grads["b"] += da.sum((0, 2))
    grads["u"] += np.matmul(before, dg.transpose(0, 2, 1)).sum(0)
    sums = [np.bincount(x.ravel(), weights=row, minlength=VOCABULARY) for row in da.transpose(1, 0, 2).reshape(3 * n, -1)]
    grads["e"] += np.stack(sums, axis=1).astype(da.dtype)


def document_scores(flat: np.ndarray, docs: list[np.ndarray], lanes: int = SCORE_LANES) -> np.ndarray:
    """log10 probability of each document's tokens (each ends with END)."""
    p = unpack(flat)
    out = np.zeros(len(docs))
    if not docs:
        return out
    y, x, doc = _lanes(docs, lanes)
    first = np.vstack([np.full((1, doc.shape[1]), True), doc[1:] != doc[:-1]])
    h = np.zeros((y.shape[1], HIDDEN), dtype=np.float32)
    for t in range(0, len(y), STEPS):
        window = slice(t, t + STEPS)
        live = (y[window] >= 0).any(0)
        columns = slice(None) if live.all() else np.flatnonzero(live)
        states, last = _states(p, x[window][:, columns], first[window][:, columns], h[columns])
        h[columns] = last
        target, of = y[window][:, columns].ravel(), doc[window][:, columns].ravel()
        used = target >= 0
        logp, _ = _softmax_parts(p, states[used], target[used], None)
        out += np.bincount(of[used], weights=logp, minlength=len(docs))
    return out / np.log(10)


def train_documents(flat: np.ndarray, docs: list[np.ndarray], rate: float, lanes: int = TRAIN_LANES) -> tuple[np.ndarray, int]:
    """Parameters after one pass of truncated backpropagation (Adam) over the documents; tokens seen."""
    flat = flat.copy()
    p = unpack(flat)
    if not docs:
        return flat, 0
    y, x, doc = _lanes(docs, lanes)
    first = np.vstack([np.full((1, doc.shape[1]), True), doc[1:] != doc[:-1]])
    h = np.zeros((y.shape[1], HIDDEN), dtype=np.float32)
    mean, square, step, seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0
    for t in range(0, len(y), STEPS):
        window = slice(t, t + STEPS)
        # Lanes end at different steps: those past their end are left out.
        live = (y[window] >= 0).any(0)
        if not live.any():
            break
        columns = slice(None) if live.all() else np.flatnonzero(live)
        inputs, starts = x[window][:, columns], first[window][:, columns]
        states, last, cache = _forward(p, inputs, starts, h[columns])
        h[columns] = last
        target = y[window][:, columns].ravel()
        used = target >= 0
        g = np.zeros_like(flat)
        grads = unpack(g)
        _, dh = _softmax_parts(p, states.reshape(-1, HIDDEN)[used], target[used], grads)
        d = np.zeros((len(target), HIDDEN), dtype=np.float32)
        d[used] = dh
        _backward(p, inputs, starts, cache, d.reshape(states.shape), grads)
        n = int(used.sum())
        g /= n
        seen += n
        step += 1
        mean += 0.1 * (g - mean)
        square += 0.01 * (g * g - square)
        flat -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    return flat, seen


def train_blocks(flat: np.ndarray, docs: Iterable[np.ndarray], rate: float) -> tuple[np.ndarray, int]:
    """``train_documents`` over all documents, ``BLOCK_TOKENS`` at a time; tokens seen."""
    block, size, seen = [], 0, 0
    for one in docs:
        if block and size + len(one) > BLOCK_TOKENS:
            flat, n = train_documents(flat, block, rate)
            block, size, seen = [], 0, seen + n
        block.append(one)
        size += len(one)
    flat, n = train_documents(flat, block, rate)
    return flat, seen + n


def train(texts: DataFrame, vocabulary: dict, flat: np.ndarray, tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """One pass over all of texts(key, text) in data-parallel rounds: train apart, then average in Spark."""
    spark = texts.sparkSession
    trainers = max(1, min(MOST_TRAINERS, -(-tokens // (rounds * TRAINER_TOKENS))))
    words = spark.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = words.value.get
        for b in slices(batches, 1):
            ids = [squeezed(np.array([*map(get, lower_words(text_bytes(t)), repeat(UNKNOWN)), END], dtype=np.int16)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    encoded = materialise(texts.mapInArrow(encode, "key long, ids binary"), "lm-training")
    for k in range(rounds):
        current, rate = spark.sparkContext.broadcast(flat), RATE * (1 - k / (rounds + 1))

        def run(batches: Iterator[pa.RecordBatch], current=current, rate=rate) -> Iterator[pa.RecordBatch]:
            mine, seen = train_blocks(current.value, (expanded(x, np.int16) for b in batches for x in b.column(1).to_pylist()), rate)
            if seen:
                parts = np.array_split(mine.astype(np.float64) * seen, SEGMENTS)
                yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array([float(seen)] * SEGMENTS), pa.array([x.tobytes() for x in parts], pa.binary())], ["segment", "seen", "sums"])

        def average(group: pa.Table) -> pa.Table:
            seen = sum(group.column("seen").to_pylist())
            # In an order that does not depend on which trainer was done first.
            sums = sum(np.frombuffer(x, dtype=np.float64) for x in sorted(group.column("sums").to_pylist()))
            return pa.table([pa.array([group.column("segment")[0].as_py()], pa.int32()), pa.array([seen]), pa.array([(sums / seen).tobytes()], pa.binary())], names=["segment", "seen", "sums"])

        schema = "segment int, seen double, sums binary"
        share = encoded.filter(F.pmod(F.xxhash64("key", F.lit("round")), F.lit(rounds)) == k)
        rows = share.repartition(trainers, "key").sortWithinPartitions("key").mapInArrow(run, schema).groupBy("segment").applyInArrow(average, schema).collect()
        if rows:
            flat = np.concatenate([np.frombuffer(r.sums, dtype=np.float64) for r in sorted(rows, key=lambda r: r.segment)]).astype(np.float32)
    release(encoded)
    return flat


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_unknown for every row."""
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    training = docs.filter(crc % 7 != 2)
    words = materialise(count_words(training, text_col, lower_words).withColumns({"lc": F.log10(F.col("n") + 1.0), "known": F.lit(1.0)}), "lm-words")
    n_docs = training.count()
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = (sums.n or 0) + n_docs, sums.v + (n_docs > 0)
    top = words.filter(F.length("word") <= FREQUENT_BYTES).orderBy(F.desc("n"), "word").limit(VOCABULARY - 2).select("word", "n").collect()
    vocabulary = {bytes(r.word): k + 2 for k, r in enumerate(top)}
    inside = sum(r.n for r in top)
    outside, rest_words = (sums.n or 0) - inside, sums.v - len(top)
    counts = np.array([outside, n_docs, *(r.n for r in top)], dtype=np.float64)
    log_counts = np.zeros(VOCABULARY)
    log_counts[2 : len(counts)] = np.log10(counts[2:] + 1.0)

    # Texts are part of the key, so that rows without an id are spread too.
    key = F.xxhash64(F.col(id_col).cast("string"), text_col)
    flat = train(training.select(key.alias("key"), F.col(text_col).alias("text")), vocabulary, start_parameters(counts), n)
    shared = spark.sparkContext.broadcast((flat, log_counts))

    def network(numbers: np.ndarray, counts: np.ndarray) -> dict:
        """Words are numbered by frequency, so the vocabulary has the least numbers."""
        weights, logs = shared.value
        ids = np.where((numbers >= 0) & (numbers < VOCABULARY - 2), numbers + 2, UNKNOWN)
        ids = np.insert(ids, np.cumsum(counts), END)
        ends = np.cumsum(counts + 1)
        texts = np.split(ids, ends[:-1])
        of = np.repeat(np.arange(len(counts)), counts + 1)
        parts, start, size = [], 0, 0
        for i, one in enumerate([*texts, None]):
            if one is None or (size and size + len(one) > SCORE_TOKENS):
                parts.append(document_scores(weights, texts[start:i]))
                start, size = i, 0
            size += 0 if one is None else len(one)
        return {
            "network": np.concatenate(parts),
            "inside": np.bincount(of, weights=logs[ids], minlength=len(counts)),
            "n_unknown": np.bincount(of, weights=ids == UNKNOWN, minlength=len(counts)),
        }

    out = sum_per_document(docs, words, ["lc", "known"], id_col, text_col, lower_words, extra=network, extra_cols=("network", "inside", "n_unknown"), gathered=GATHERED_WORDS)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    n_tokens = F.col("n_words") + 1
    base = F.col("lc") + F.lit(float(np.log10(n_docs + 1.0))) - n_tokens * F.lit(float(np.log10(n + v + 1.0)))
    score = F.col("network") + F.col("lc") - F.col("inside") - F.col("n_unknown") * F.lit(float(np.log10(outside + rest_words + 1.0)))
    return out.select(
        id_col, held.alias("held_out"), n_tokens.alias("n_tokens"), (F.col("known").cast("long") + F.lit(1 if n_docs else 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), F.col("n_unknown").cast("long").alias("n_unknown")
    )


def op8_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
