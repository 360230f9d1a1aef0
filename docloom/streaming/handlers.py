"""Handlers of task queues: each turns its part of a micro-batch (document_id, payload) into result rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scalar import hash_embedding
from docloom.operators import extraction as ex

Handler = Callable[[DataFrame], DataFrame]


def parse_handler(blocks: DataFrame) -> Handler:
    """Each message with the number of blocks of its document; unknown documents give no row."""

    def run(batch: DataFrame) -> DataFrame:
        asked = blocks.join(batch.select("document_id").distinct(), "document_id", "left_semi")
        sizes = asked.groupBy("document_id").agg(F.count("*").alias("n_blocks"))
        return batch.join(sizes, "document_id").select("document_id", "payload", "n_blocks")

    return run


def embedding_handler(chunks: DataFrame, guard: DataFrame, dim: int) -> Handler:
    """(document_id, id, embedding) of the chunks of asked documents that are active; a document is embedded once a batch."""

    def run(batch: DataFrame) -> DataFrame:
        live = guard.filter("lifecycle_status = 'ACTIVE'").select("document_id")
        asked = batch.select("document_id").distinct().join(live, "document_id", "left_semi")
        return chunks.join(asked, "document_id", "left_semi").select("document_id", "id", hash_embedding(F.col("content"), dim).alias("embedding"))

    return run


def analysis_handler() -> Handler:
    """Records of the message's text (payload): the text comes with the message."""
    return lambda batch: ex.records(batch, F.col("payload"), ["document_id"])
