"""Stateful streaming exact deduplication (operator 6), DataFrame and streaming functions only.

A narrow feed (digest, identifier, locator of the row) is read as a stream.  A streaming aggregation
keyed by digest keeps, in RocksDB on disk and without expiry, the row that stays, its locator and the
number of rows seen.  Each micro-batch appends the groups it changed; the newest entry of a digest is
its group.  Where a digest was seen more than once, the full bytes of its rows are compared: a group's
smallest and largest text are equal only if all its texts are.  Groups that fail the comparison are
formed again by their texts, so equal digests never merge different texts.

Hot groups: rows of one text are combined before each shuffle (partial aggregates); where rows meet
their group, digests with more than 1/``HEAVY_SHARE`` of all rows (so at most ``HEAVY_SHARE`` of them)
are broadcast and all others are joined by a shuffle.

Defined results: a null text counts as empty; the largest id stays, a null id is less than any other;
rows that repeat id and text are told apart by their place in the input, of which the last stays;
group_size counts rows; an empty table gives no rows; other columns are carried by ``keep_first_texts``
and ignored by ``duplicate_groups``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import fresh, materialise, sha256_text, table, work_path

HEAVY_SHARE = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Many small stores: no preallocated files, and only changes are written to the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
}
#: What the stream's own session takes over from the caller's.
TAKEN = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")
FEED = "digest string, id {id}, part string, place long"


def digest_state(feed: DataFrame) -> DataFrame:
    """Streaming (or batch) aggregation: per digest the row that stays and the number of rows."""
    return feed.groupBy("digest").agg(F.max(F.struct("id", "part", "place")).alias("keep"), F.count("*").alias("group_size"))


def _feed(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    return docs.select(digest(F.col(text_col)).alias("digest"), F.col(id_col).alias("id"), F.input_file_name().alias("part"), F.monotonically_increasing_id().alias("place"))


def run_stream(spark: SparkSession, feed_path: str, feed_schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Drain the feed through the keyed state; (digest, keep, group_size) with one row per digest."""
    out, log = work_path(spark, "dedup-groups"), work_path(spark, "dedup-state")
    # A session of its own: the state store's settings reach no other query.
    session = spark.newSession()
    for k, v in STATE.items() | {k: spark.conf.get(k) for k in TAKEN}.items():
        session.conf.set(k, v)
    reader = session.readStream.schema(feed_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    changed, written = digest_state(reader.parquet(feed_path)), []

    def append(batch: DataFrame, batch_id: int) -> None:
        # The folder is the batch's own: a batch that is run again after a failure replaces it.
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        written.append(batch_id)

    changed.writeStream.outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(append).start().awaitTermination()
    if not written:
        return spark.createDataFrame([], changed.schema)
    schema = StructType([*changed.schema.fields, StructField("batch", IntegerType())])
    seen = spark.read.schema(schema).option("basePath", out).parquet(out)
    if files_per_batch is None:
        return seen.drop("batch")
    return seen.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("digest", "s.keep", "s.group_size")


def _with_groups(rows: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """Rows with their group, without a task that gets all rows of one digest."""
    heavy = groups.filter(F.col("group_size") > n_rows / HEAVY_SHARE)
    light = groups.filter(F.col("group_size") <= n_rows / HEAVY_SHARE)
    keys = F.broadcast(heavy.select("digest"))
    return rows.join(F.broadcast(heavy), "digest").unionByName(rows.join(keys, "digest", "left_anti").join(light.hint("merge"), "digest"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_text, files_per_batch: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the text itself)."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = FEED.format(id=id_type)
    feed_path = work_path(spark, "dedup-feed")
    _feed(docs, id_col, text_col, digest).write.parquet(feed_path)
    feed = spark.read.schema(schema).parquet(feed_path)
    groups = run_stream(spark, feed_path, schema, files_per_batch)
    n_rows = feed.count()

    # The full bytes on hits: equal digests with unequal texts.
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(digest(F.col(text_col)).alias("digest"), text.alias("text"), F.col(id_col).alias("id"))
    hits = groups.filter("group_size > 1").select("digest", "group_size")
    differ = materialise(_with_groups(keyed, hits, n_rows).groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("digest"), "dedup-differ")

    result = _with_groups(feed, groups, n_rows).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", F.struct("id", "part", "place").eqNullSafe(F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256")
    )
    if digest is sha256_text and differ.isEmpty():
        return result
    # Digests of other kinds, or a collision: the text's own SHA-256, and groups by whole texts.
    exact = docs.select(digest(F.col(text_col)).alias("digest"), text.alias("text"), F.col(id_col).alias("id"), F.input_file_name().alias("part"), F.monotonically_increasing_id().alias("place"))
    exact = exact.join(differ.withColumn("split", F.lit(True)), "digest", "left")
    key = F.struct("digest", F.when(F.col("split"), F.col("text")).alias("text"))
    exact = materialise(exact.select("id", "part", "place", key.alias("key"), sha256_text(F.col("text")).alias("text_sha256")), "dedup-exact")
    by_text = exact.groupBy("key").agg(F.max(F.struct("id", "part", "place")).alias("keep"), F.count("*").alias("group_size"))
    on = F.col("a.key").eqNullSafe(F.col("b.key"))
    return exact.alias("a").join(by_text.alias("b"), on).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", F.struct("id", "part", "place").eqNullSafe(F.col("keep")).alias("kept"), "text_sha256"
    )


def keep_last_of_each_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns.  Rows that repeat both id and text count as one."""
    groups = materialise(duplicate_groups(docs, id_col, text_col), "dedup-result")
    gone = groups.filter(~F.col("kept"))
    stay_id, stay_sha = fresh(docs.columns, "_id"), fresh(docs.columns, "_sha")
    stay = groups.filter("kept").select(F.col(id_col).alias(stay_id), F.col("text_sha256").alias(stay_sha))
    kept = docs.join(stay, F.col(id_col).eqNullSafe(F.col(stay_id)) & (sha256_text(F.col(text_col)) == F.col(stay_sha)), "left_semi")
    repeated = gone.filter(F.col("keep_id").eqNullSafe(F.col(id_col)))
    if repeated.isEmpty():
        return kept
    mark = fresh(docs.columns, "_digest")
    return kept.withColumn(mark, sha256_text(F.col(text_col))).dropDuplicates([id_col, mark]).drop(mark)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
