"""Quality rules with host verdicts (operator 13).

Every text is measured once and judged by two rules (too few words, too many repeated words).  The
failures are counted per host, a Beta prior is fitted to the hosts' failure rates by moments, and each
host's rate is shrunk towards the mean of all hosts by that prior: a host with few documents is judged
mostly by the others, one with many by its own.  A host whose shrunk rate is over ``HOST_RATE`` loses
all its documents.

The host of a document is its ``source``.  Only counts go through the shuffle, summed per task first, and
the prior is fitted on one row of sums, so neither many hosts nor a hot one gather anywhere.  Verdicts on
rejected hosts are broadcast up to ``BROADCAST_HOSTS`` of them; beyond that they are joined by a shuffle in
which hot hosts are spread.

Defined results: a null text counts as empty (0 words, so it fails); a null host is no host, its documents
are judged by the rules alone and do not count for the prior; every input row gives one row, also where
ids are null or repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, materialise, slices, table, text_bytes

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: Hosts whose shrunk share of failing documents is higher lose all documents.
HOST_RATE = 0.5
BROADCAST_HOSTS = 100_000

_SPACES = b"\t\n\v\f\r "
_NOT_FIRST = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: np.ndarray, counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Of each text, the words in a window of ``width`` words that the text has at least twice.

    ``words``: numbers of the words of all texts, one text after another; ``counts``: words of each text.
    Windows are sorted by text and by a 64-bit number made of their words; neighbours with equal numbers are
    compared word by word, and a text in which two different windows share a number is counted without numbers.
    """
    out = np.zeros(len(counts), dtype=np.int64)
    total = len(words) - width + 1
    if total <= 0:
        return out
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(text[:total] == text[width - 1 :])
    number = np.zeros(len(starts), dtype=np.uint64)
    for k in range(width):
        number = (number ^ (words[starts + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        number ^= number >> np.uint64(29)
    order = np.lexsort((number, text[starts]))
    at, number = starts[order], number[order]
    same = (number[1:] == number[:-1]) & (text[at[1:]] == text[at[:-1]])
    pairs = np.flatnonzero(same)
    equal = np.ones(len(pairs), dtype=bool)
    for k in range(width):
        equal &= words[at[pairs] + k] == words[at[pairs + 1] + k]
    twice = np.zeros(len(at), dtype=bool)
    twice[pairs] = twice[pairs + 1] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[at[twice] + k] = True
    out += np.bincount(text[covered], minlength=len(counts))
    ends = np.cumsum(counts)
    for i in np.unique(text[at[pairs[~equal]]]).tolist():
        out[i] = _repeated_exactly(words[ends[i] - counts[i] : ends[i]], width)
    return out


def _repeated_exactly(words: np.ndarray, width: int) -> int:
    view = np.lib.stride_tricks.sliding_window_view(words, width)
    _, inverse, times = np.unique(view, axis=0, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(times[inverse.ravel()] > 1).tolist():
        covered[i : i + width] = True
    return int(covered.sum())


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, ``COUNTS`` and base_failed for every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            words, n_words, chars, symbols, lines = [], [], [], [], []
            for raw in map(text_bytes, batch.column(2).to_pylist()):
                own = raw.split()
                words += own
                n_words.append(len(own))
                chars.append(len(raw.translate(None, _SPACES + _NOT_FIRST)))
                symbols.append(len(raw) - len(raw.translate(None, _SYMBOLS)))
                filled = [x for x in raw.split(b"\n") if x.strip()]
                lines.append(len(filled) - len(set(filled)))
            counts = np.array(n_words, dtype=np.int64)
            numbers = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
            found = (counts, np.array(chars, dtype=np.int64), np.array(symbols, dtype=np.int64), np.array(lines, dtype=np.int64), repeated_words(numbers, counts))
            failed = (counts < MIN_WORDS) | (100 * found[-1] > REPEAT_PERCENT * counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found), pa.array(failed)], ["id", "host", *COUNTS, "base_failed"])

    id_type, host_type = (docs.schema[c].dataType.simpleString() for c in (id_col, host_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    return rows.mapInArrow(measure, f"id {id_type}, host {host_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean")


@dataclass(frozen=True)
class Prior:
    """Beta prior of the failure rates: their mean and how many documents it weighs (infinite: all hosts are alike)."""

    mean: float
    weight: float

    def shrunk(self, failed, n):
        """Posterior mean of a host's failure rate, for columns or numbers."""
        if self.weight == float("inf"):
            return failed * 0.0 + self.mean
        return (failed + self.mean * self.weight) / (n + self.weight)


def fit_prior(hosts: int, n: int, failed: int, n_squared: float, failed_squared_by_n: float) -> Prior:
    """Moments of the Beta-binomial, hosts weighted by their documents.

    The sums run over hosts: documents, failures, documents squared, failures squared by documents.
    """
    if not n:
        return Prior(0.0, float("inf"))
    mean = failed / n
    spread = mean * (1 - mean)
    freedom = n - n_squared / n
    if spread <= 0 or hosts < 2:
        return Prior(mean, float("inf"))
    between = failed_squared_by_n - failed * failed / n
    alike = between - spread * (hosts - 1)
    apart = spread * (freedom - (hosts - 1))
    if alike <= 0 or apart <= 0:
        return Prior(mean, float("inf"))
    return Prior(mean, max(apart / alike - 1, 0.0))


def host_counts(rows: DataFrame) -> DataFrame:
    """(host, host_docs, host_failed) of rows(host, base_failed) whose host is not null."""
    return rows.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))


def prior_of(hosts: DataFrame) -> Prior:
    n, f = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    r = hosts.agg(F.count("*").alias("hosts"), F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(n * n).alias("n2"), F.sum(f * f / n).alias("f2")).first()
    return fit_prior(r.hosts, r.n or 0, r.f or 0, r.n2 or 0.0, r.f2 or 0.0)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE, broadcast_limit: int = BROADCAST_HOSTS) -> DataFrame:
    """id, ``COUNTS``, base_failed, host_rejected, kept for every row."""
    rows = materialise(measures(docs, id_col, text_col, host_col), "host-measures")
    hosts = materialise(host_counts(rows), "host-counts")
    prior = prior_of(hosts)
    bad = hosts.filter(prior.shrunk(F.col("host_failed"), F.col("host_docs")) > host_rate).select("host", F.col("host_docs").alias("bad_docs"))
    if bad.limit(broadcast_limit + 1).count() <= broadcast_limit:
        joined = rows.join(F.broadcast(bad), "host", "left")
    else:
        joined = join_spread(rows, bad, "host", "bad_docs", rows.count())
    rejected = F.col("bad_docs").isNotNull()
    return joined.select(F.col("id").alias(id_col), *COUNTS, "base_failed", rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


#: DuckDB's form of the query: windows and lines as rows, the prior and the verdicts by the same formulas.
ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, u.w, u.i FROM (SELECT r, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM texts) t,
       LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) u),
windows AS (
  SELECT r, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS k, lead(i, 4) OVER o AS last
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS times FROM windows WHERE last IS NOT NULL) WHERE times > 1),
repeated AS (
  SELECT r, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS d) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counted AS (SELECT r, count(*) AS n FROM words GROUP BY r),
measured AS (
  SELECT t.doc_id, t.host, coalesce(c.n, 0) AS n_words, length(regexp_replace(t.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN counted c USING (r) LEFT JOIN lines l USING (r) LEFT JOIN repeated p USING (r)),
ruled AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM measured),
hosts AS (
  SELECT host, count(*)::DOUBLE AS n, sum(base_failed::BIGINT)::DOUBLE AS f FROM ruled WHERE host IS NOT NULL GROUP BY host),
sums AS (
  SELECT count(*) AS m, sum(n) AS n, sum(f) AS f, sum(f) / sum(n) AS mean, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS between_hosts,
         sum(n) - sum(n * n) / sum(n) AS freedom FROM hosts),
moments AS (
  SELECT mean, between_hosts - mean * (1 - mean) * (m - 1) AS alike, mean * (1 - mean) * (freedom - (m - 1)) AS apart FROM sums),
prior AS (
  SELECT mean, CASE WHEN alike > 0 AND apart > 0 THEN greatest(apart / alike - 1, 0) END AS weight FROM moments),
bad AS (
  SELECT host FROM hosts, prior WHERE CASE WHEN weight IS NULL THEN mean ELSE (f + mean * weight) / (n + weight) END > {HOST_RATE})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       bad.host IS NOT NULL AS host_rejected, NOT base_failed AND bad.host IS NULL AS kept
FROM ruled LEFT JOIN bad ON ruled.host = bad.host
"""
