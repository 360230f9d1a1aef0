"""Mixing sources to target weights by Poisson replication (operator 1), DataFrame functions only.

A source with n documents and target share w of ``total`` output rows has the mean repetition rate
w * total / n.  Each document gets a Poisson number of copies with that mean: a uniform number drawn
from a hash of seed and id is pushed through the inverse of the distribution.  The distribution is
tabulated once per source and cut where the rest of its probability is below what the hash can tell
apart (2^-52).  Documents are exploded by their counts and dealt out by a hash of seed, id and copy.

Rates above ``PIECE`` are split into equal parts of at most ``PIECE``, one hash for each, whose counts
add up; so no power underflows and tables stay short.

Only the table of sources meets the documents.  It is broadcast when it has at most
``BROADCAST_SOURCES`` rows; beyond that documents and sources are joined by a shuffle in which each
source is spread over ``SALTS`` keys.

Defined results: a null source is a source of its own; sources without a weight share what is named
under ``default_weight`` (1 each, before normalising); weights of sources that do not occur are
ignored; negative or null weights count as 0; null ids hash as the empty string; rows that repeat an
id get the same number of copies each; an empty table gives no rows; all columns are carried, and the
added columns take a leading underscore where a name is taken.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

SEED = 20240
PIECE = 16.0
BROADCAST_SOURCES = 100_000
SALTS = 64
#: Enough terms for a mean of PIECE: the rest is below 2^-52.
TERMS = 96


def uniform(*parts) -> F.Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: Mapping[str | None, float] | DataFrame | None, total: int | None, source_col: str, default_weight: float) -> DataFrame:
    """(source, n, rate): the mean number of copies of each source's documents."""
    spark = docs.sparkSession
    if weights is None:
        weights = {}
    if isinstance(weights, Mapping):
        weights = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    named = weights.select(F.col("source").alias("w_source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.lit(True).alias("named"))
    each = counts.join(named, F.col("source").eqNullSafe(F.col("w_source")), "left").withColumn("weight", F.when(F.col("named"), F.col("weight")).otherwise(F.lit(float(default_weight))))
    sums = each.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    size = (sums.n or 0) if total is None else int(total)
    if not sums.weight:
        return each.select("source", "n", F.lit(0.0).alias("rate"))
    return each.select("source", "n", (F.col("weight") / F.lit(sums.weight) * F.lit(size) / F.col("n")).alias("rate"))


def poisson_table(mean) -> F.Column:
    """P(X <= 0), P(X <= 1), ... up to TERMS values, from one pass over the terms."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("t"))

    def step(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.when((k > mean) & (p < 2.0**-53), s["t"]).otherwise(F.concat(s["t"], F.array(s["c"] + p))).alias("t"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["t"])


def poisson_mix(docs: DataFrame, weights: Mapping[str | None, float] | DataFrame | None = None, total: int | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", default_weight: float = 1.0) -> DataFrame:
    """All columns of ``docs`` plus copy_no (0, 1, ...), one row per copy, in a random global order."""
    # Rows travel as one struct, so no column of theirs can clash with those used here.
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), ident.alias("ident"), F.col(source_col).cast("string").alias("source"))
    rates = repetition_rates(docs, weights, total, source_col, default_weight)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    rates = rates.select(F.col("source").alias("named"), pieces.alias("pieces"), poisson_table(F.col("rate") / pieces).alias("table"))
    same = F.col("source").eqNullSafe(F.col("named"))
    if rates.select("named").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), same)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int"))
        spread = rates.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(spread, same & (F.col("salt") == F.col("of_salt")))
    draws = F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda j: uniform(F.lit(str(seed)), F.col("ident"), j.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col("table"), lambda c: c <= u)))
    copies = joined.select("doc", "ident", count.alias("copies")).filter("copies > 0").select("doc", "ident", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    order = uniform(F.lit(str(seed)), F.lit("order"), F.col("ident"), F.col("copy").cast("string"))
    shuffled = copies.withColumn("order", order).repartition(F.col("order")).sortWithinPartitions("order")
    return shuffled.select("doc.*", F.col("copy").alias(fresh(docs.columns, "copy_no")))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal target weights for all sources, as many rows as documents (in the mean)."""
    return poisson_mix(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents", seed: int = SEED) -> str:
    """The same rows in DuckDB: equal weights, total = number of documents."""
    unit = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM {documents} GROUP BY source),
 sums AS (SELECT count(*)::DOUBLE AS all_weight, sum(n) AS all_n FROM counts),
 rates AS (SELECT source, 1.0 / all_weight * all_n / n AS rate FROM counts, sums),
 split AS (SELECT source, greatest(1, ceil(rate / {PIECE}))::INT AS pieces, rate / greatest(1, ceil(rate / {PIECE}))::INT AS mean FROM rates),
 terms AS (SELECT source, pieces, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM split
   UNION ALL SELECT source, pieces, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k < {TERMS} AND NOT (k + 1 > mean AND p * mean / (k + 1) < {2.0**-53!r})),
 tables AS (SELECT source, any_value(pieces) AS pieces, list(c ORDER BY k) AS t FROM terms GROUP BY source),
 drawn AS (SELECT d.*, list_sum([len(list_filter(t, lambda c: c <= {unit.format(f"'{seed}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j::VARCHAR")})) for j in range(1, pieces + 1)])::INT AS copies
   FROM {documents} d JOIN tables s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, copies))::INT AS copy_no FROM drawn WHERE copies > 0
"""
