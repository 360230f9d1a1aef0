"""Helpers the training-data operators share: tables, the shared work folder, row identity."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_WORK_DIR = "/tmp/checkpoints/docloom"


#: Rows of whole texts in one Arrow batch, which an executor holds several times outside its heap.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS, SPARK_DEFAULT = "1000", "10000"


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of ``TEXT_ROWS`` rows where the session leaves Spark's default, which suits rows of numbers.

    The setting stays: batches are made when the caller runs the plan.  It changes no result.
    """
    if spark.conf.get(ARROW_ROWS, SPARK_DEFAULT) == SPARK_DEFAULT:
        spark.conf.set(ARROW_ROWS, TEXT_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_WORK_DIR
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` made and nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if re.search(r"-[0-9a-f]{32}$", folder):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts with about ``most`` bytes of text each (a longer text is a part of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes + 1) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(x, y - x)


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, weight: str, n_rows: int, share: int = 4096) -> DataFrame:
    """``rows`` left-joined with ``keyed``, which has one row per key and under ``weight`` the number of rows of it.

    No task gets all rows of a key: keys with more than 1/``share`` of all rows, so at most ``share`` of them, are
    broadcast; the others are joined by a shuffle, and null keys, which match nothing, by none.
    """
    other = keyed.withColumnRenamed(key, fresh([*rows.columns, *keyed.columns], "_key"))
    name = next(c for c in other.columns if c not in keyed.columns)
    heavy, light = (F.broadcast(other.filter(F.col(weight) > n_rows / share)), other.filter(F.col(weight) <= n_rows / share))
    full = rows.filter(F.col(key).isNotNull())
    hot = full.join(heavy, F.col(key) == F.col(name)).drop(name)
    rest = full.join(heavy.select(name), F.col(key) == F.col(name), "left_anti").join(light, F.col(key) == F.col(name), "left").drop(name)
    none = rows.filter(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema.fields if f.name != key))
    return hot.unionByName(rest).unionByName(none)


def text_bytes(value) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def fresh(columns: Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores put before it until no column has that name (names ignore case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256_text(column) -> F.Column:
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def squeezed(x: np.ndarray) -> bytes:
    """An array's numbers, compressed, as a field of a row."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def expanded(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=dtype)
