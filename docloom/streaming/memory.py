"""Embeddings as a stream with memory: a text is embedded once, over all batches and restarts.

Texts are keyed by the hash of their stripped form and dealt into ``PAGES`` groups for each of ``buckets``, so that a
group's new texts of a batch go to the model together.  A group's texts are numbered as they come and kept as keyed state on
disk, ``SEGMENT`` of them in one value: a call of the state costs far more than a text.  A batch reads the digests of the
groups that it has rows of, once, and of their vectors the segments that it needs; it writes the segments that get new
texts.  Rows of one text are handled as they come, frame by frame; none is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.functions.scalar import strip
from docloom.operators import extraction as ex

BUCKETS = 1024
PAGES = 16
#: Texts whose digests, and vectors, are one value of the state.
SEGMENT = 64
DIGEST = 32
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> SparkSession:
    """A session of its own, which keeps the keyed state of its streams on disk."""
    own = spark.newSession()
    own.conf.set(STATE_STORE, ROCKSDB)
    return own


class _Remembering(StatefulProcessor):
    def __init__(self, factory: Callable[[], Callable], name: str, batch: int):
        self.factory, self.name, self.batch = factory, name, batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.digests = handle.getMapState("digests", "segment int", "packed binary")
        self.vectors = handle.getMapState("segments", "segment int", "vectors array<binary>")

    def _numbers(self) -> dict[bytes, int]:
        """Digest -> number of all texts of the group."""
        out: dict[bytes, int] = {}
        for (segment,), (packed,) in list(self.digests.iterator()):
            whole = bytes(packed)
            out.update((whole[i : i + DIGEST], segment * SEGMENT + i // DIGEST) for i in range(0, len(whole), DIGEST))
        return out

    def _held(self, numbers: dict[bytes, int], wanted: Iterable[bytes]) -> dict[bytes, list[float]]:
        """Vectors of texts that have a number; each segment is read once and left again."""
        by_segment: dict[int, list[bytes]] = {}
        for d in wanted:
            by_segment.setdefault(numbers[d] // SEGMENT, []).append(d)
        out = {}
        for segment, mine in by_segment.items():
            (packed,) = self.vectors.getValue((segment,))
            out.update((d, np.frombuffer(packed[numbers[d] % SEGMENT], dtype=np.float32).tolist()) for d in mine)
        return out

    def _add(self, numbers: dict[bytes, int], made: dict[bytes, list[float]]) -> None:
        """Numbers for new texts; they fill up the last segment first."""
        digests, start = list(made), len(numbers)
        vectors = [np.asarray(v, dtype=np.float32).tobytes() for v in made.values()]
        numbers.update(zip(digests, range(start, start + len(digests)), strict=True))
        at = 0
        while at < len(digests):
            segment, filled = divmod(start + at, SEGMENT)
            end = at + SEGMENT - filled
            packed, held = b"".join(digests[at:end]), vectors[at:end]
            if filled:
                packed = bytes(self.digests.getValue((segment,))[0]) + packed
                held = [*map(bytes, self.vectors.getValue((segment,))[0]), *held]
            self.digests.updateValue((segment,), (packed,))
            self.vectors.updateValue((segment,), (held,))
            at = end

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        numbers = self._numbers()
        for frame in rows:
            digests = frame["digest"].tolist()
            texts = dict(zip(digests, frame["plain"], strict=True))
            new = [d for d in texts if d not in numbers]
            model = ex.once(self.factory, self.name) if new else None
            made: dict[bytes, list[float]] = {}
            for i in range(0, len(new), self.batch):
                piece = new[i : i + self.batch]
                for d, vector in zip(piece, ex.retried(lambda piece=piece: model([texts[d] for d in piece])), strict=True):
                    made[d] = [float(x) for x in vector]
            known = made | self._held(numbers, (d for d in texts if d in numbers))
            self._add(numbers, made)
            out = frame.drop(columns=["digest", "plain", "page"])
            out["embedding"] = [known[d] for d in digests]
            yield out

    def close(self) -> None:
        pass


def embed_stream(rows: DataFrame, text: str, factory: Callable[[], Callable], buckets: int = BUCKETS, batch: int = ex.BATCH) -> DataFrame:
    """Streaming rows without the text, with ``embedding``; a null text is embedded as an empty one.

    The session needs state on disk (``keyed_state``).
    """
    kept = [c for c in rows.columns if c != text]
    # Neutral names inside: the rows reach the processor as named tuples, which take no other ones.
    keyed = rows.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), strip(F.coalesce(F.col(text), F.lit(""))).alias("plain"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("plain", 256))).withColumn("page", F.pmod(F.xxhash64("digest"), F.lit(buckets * PAGES)))
    schema = ", ".join([*(f"c{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), "embedding array<float>"])
    made = keyed.groupBy("page").transformWithStateInPandas(_Remembering(factory, ex.model_name(factory), batch), schema, "append", "none")
    return made.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "embedding")
