"""Task queues as a stream: each micro-batch is split by queue; messages that cannot be handled go to a side table.

A batch's messages are written once before they are handled, so every queue, and every retry, reads the same rows.
A handler that fails is given the halves of its messages, and the halves of the half that fails, until the message that
it fails on is alone; that one is rejected with the error and all others come out.  Each message is in exactly one
piece that was written whole, so none comes out twice.  A handler may also tell failed rows itself, by a column
``_error`` in its result that is null for good ones.

A batch in which every message of a queue fails, or more than ``max_poison`` of them do, is a fault of the handler or of
the cluster: the stream stops with that error and loses nothing, because the batch is run again from its start.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.lifecycle import ERROR_CHARS
from docloom.sources.publish import remove

MESSAGE = "queue string, document_id bigint, payload string"
MAX_POISON = 100
_ROW = "_row"
_DEPTH = 62


def fault(queues: Mapping[str, Callable[[DataFrame], DataFrame]]) -> Column:
    """Why a message is for no handler, else null."""
    known = F.coalesce(F.col("queue").isin(*queues), F.lit(False))
    return F.when(~known, "no such queue").when(F.col("document_id").isNull(), "no document").when(F.col("payload").isNull(), "no payload")


def valid(batch: DataFrame, queues: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return batch.filter(fault(queues).isNull())


class _Isolation:
    """One queue's part of a batch, handled in as few pieces as its poison messages allow."""

    def __init__(self, rows: DataFrame, handler: Callable[[DataFrame], DataFrame], folder: str, max_poison: int):
        self.rows, self.handler, self.folder, self.max_poison = rows, handler, folder, max_poison
        self.rejected: list[tuple[int, str]] = []
        self.written = 0

    def piece(self, depth: int, prefix: int) -> DataFrame:
        return self.rows.filter(F.pmod(F.xxhash64(_ROW), F.lit(1 << depth)) == prefix) if depth else self.rows

    def run(self, depth: int = 0, prefix: int = 0) -> None:
        part = self.piece(depth, prefix)
        path = f"{self.folder}/piece={depth}_{prefix}"
        try:
            self.handler(part.drop(_ROW)).write.mode("overwrite").parquet(path)
            self.written += 1
        except Exception as error:
            remove(part.sparkSession, path)
            alone = part.select(_ROW).limit(2).collect()
            if len(alone) > 1 and depth < _DEPTH:
                self.run(depth + 1, prefix)
                self.run(depth + 1, prefix + (1 << depth))
            elif not alone:
                raise
            else:
                self.rejected += [(r[0], str(error)[:ERROR_CHARS]) for r in alone]
                if len(self.rejected) > self.max_poison:
                    raise RuntimeError(f"more than {self.max_poison} messages fail") from error
        if not depth and self.rejected and len(self.rejected) > 1 and len(self.rejected) == self.rows.count():
            raise RuntimeError(f"all {len(self.rejected)} messages fail: {self.rejected[0][1]}")


def run_queues(messages: DataFrame, queues: Mapping[str, Callable[[DataFrame], DataFrame]], out: str, checkpoint: str, available_now: bool = True, max_poison: int = MAX_POISON) -> StreamingQuery:
    """Every queue's handler gets its part of each batch; results go to out/<queue>, all else with its error to out/_rejected.

    A batch's folders are its own, so a batch that is run again replaces what it wrote.  Intake is bounded
    at the source (maxFilesPerTrigger, maxOffsetsPerTrigger).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        kept = f"{out}/_messages/batch={batch_id}"
        # The place of a row in the batch names it from here on: it is read from files from here on.
        batch.withColumn(_ROW, F.monotonically_increasing_id()).write.mode("overwrite").parquet(kept)
        rows = spark.read.schema(spark.read.parquet(kept).schema).parquet(kept)
        good = valid(rows, queues)
        bad = rows.withColumn("error", fault(queues)).filter("error IS NOT NULL").drop(_ROW)
        for name, handler in queues.items():
            folder = f"{out}/{name}/batch={batch_id}"
            remove(spark, folder)
            mine = good.filter(F.col("queue") == name)
            isolation = _Isolation(mine, handler, folder, max_poison)
            isolation.run()
            if isolation.rejected:
                errors = F.broadcast(spark.createDataFrame(isolation.rejected, f"{_ROW} bigint, error string"))
                bad = bad.unionByName(mine.join(errors, _ROW).select(*columns, "error"))
            if (told := _told(spark, folder, rows.drop(_ROW))) is not None:
                bad = bad.unionByName(told)
        bad.write.mode("overwrite").parquet(f"{out}/_rejected/batch={batch_id}")
        remove(spark, kept)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _told(spark, folder: str, messages: DataFrame) -> DataFrame | None:
    """Rows that a handler marked as failed, as rejected messages; what the result lacks of the message is null."""
    done = spark.read.parquet(folder)
    if "_error" not in done.columns:
        return None
    have = set(done.columns)
    fields = ((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in messages.schema)
    return done.filter("_error IS NOT NULL").select(*fields, F.left("_error", F.lit(ERROR_CHARS)).alias("error"))


def results(spark, out: str, queue: str) -> DataFrame:
    """What a queue's handler made of all batches, without rows that it marked as failed."""
    done = spark.read.parquet(f"{out}/{queue}").drop("batch", "piece")
    return done.filter("_error IS NULL").drop("_error") if "_error" in done.columns else done
