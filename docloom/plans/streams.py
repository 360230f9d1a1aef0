"""Queries of the streams that remember: embeddings once per text, leases that end by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.plans import queries as q
from docloom.plans import views as v
from docloom.session import shared_path
from docloom.streaming import leases, memory

LEASE = 3600


def counting_model():
    """A stand-in whose vectors count characters, vowels and words."""
    return lambda texts: [[len(t), sum(map(t.count, "aeiou")), len(t.split(" "))] for t in texts]


_PLAIN = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


@q.query(
    "embedding_stream",
    v.with_views(
        "d_lines",
        body=f"""SELECT document_id, pos, length(t) AS n_chars, length(regexp_replace(t, '[^aeiou]', '', 'g')) AS n_vowels, len(string_split(t, ' ')) AS n_words
FROM (SELECT document_id, pos, {_PLAIN} AS t FROM d_lines)""",
    ),
)
def embedding_stream(spark, sf):
    """Every line of every document, embedded in a stream that asks the model once per distinct text."""
    base = shared_path(spark, "embedding-stream")
    v.d_lines(spark, sf).write.parquet(f"{base}/in")
    rows = memory.keyed_state(spark).readStream.schema("document_id bigint, pos int, text string").parquet(f"{base}/in")
    made = memory.embed_stream(rows, "text", counting_model, buckets=64)
    made.writeStream.format("parquet").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    number = lambda i, name: F.col("embedding")[i].cast("int").alias(name)
    return spark.read.parquet(f"{base}/out").select("document_id", "pos", number(0, "n_chars"), number(1, "n_vowels"), number(2, "n_words"))


_LEASES = f"""WITH RECURSIVE asked AS (
  SELECT user_id, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAIL' ELSE 'CLAIM' END AS kind, 'w' || event_id % 3 AS owner, date_trunc('millisecond', ts) AS moment FROM events),
 e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, kind, owner) AS n FROM asked),
 r AS (
  SELECT user_id, 0 AS n, 'PENDING' AS state, NULL::VARCHAR AS owner, NULL::TIMESTAMP AS ends, NULL::TIMESTAMP AS expired, NULL::VARCHAR AS change, NULL::VARCHAR AS who, NULL::TIMESTAMP AS moment
  FROM e GROUP BY user_id
  UNION ALL
  SELECT user_id, n,
   CASE WHEN wins THEN 'RUNNING' WHEN ended THEN CASE kind WHEN 'DONE' THEN 'COMPLETED' ELSE 'FAILED' END ELSE s END,
   CASE WHEN wins THEN claimant ELSE holder END, CASE WHEN wins THEN moment + INTERVAL {LEASE} SECONDS WHEN s = 'RUNNING' AND NOT ended THEN ends END,
   CASE WHEN over THEN ends END,
   CASE WHEN wins THEN 'RUNNING' WHEN kind = 'CLAIM' THEN 'HELD' WHEN ended THEN CASE kind WHEN 'DONE' THEN 'COMPLETED' ELSE 'FAILED' END END, claimant, moment
  FROM (SELECT *, kind = 'CLAIM' AND NOT (s = 'COMPLETED' OR (s = 'RUNNING' AND holder <> claimant)) AS wins, kind <> 'CLAIM' AND s = 'RUNNING' AND holder = claimant AS ended
   FROM (SELECT e.user_id, e.n, e.kind, e.owner AS claimant, e.moment, r.owner AS holder, r.ends, r.state = 'RUNNING' AND r.ends <= e.moment AS over, CASE WHEN r.state = 'RUNNING' AND r.ends <= e.moment THEN 'PENDING' ELSE r.state END AS s
    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))),
 final AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id AS document_id, change AS state, who AS owner_id, moment AS changed_at FROM r WHERE change IS NOT NULL
UNION ALL SELECT user_id, 'PENDING', NULL, expired FROM r WHERE expired IS NOT NULL
UNION ALL SELECT user_id, 'PENDING', NULL, ends FROM final WHERE state = 'RUNNING' AND ends <= (SELECT max(moment) FROM asked)"""


@q.query("lease_stream", _LEASES)
def lease_stream(spark, sf):
    """Changes of state of one job per user; leases end with the stream's clock, after the last event too."""
    base = shared_path(spark, "lease-stream")
    kind = F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "error", "FAIL").otherwise("CLAIM")
    key = [F.lit(1).cast("long").alias("tenant_id"), F.col("user_id").cast("long").alias("document_id"), F.lit(1).cast("long").alias("index_version")]
    owner = F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string"))
    v.t(spark, sf, "events").select(*key, kind.alias("kind"), owner.alias("owner_id"), F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("at")).write.parquet(f"{base}/in")
    own = memory.keyed_state(spark)
    rows = own.readStream.schema(own.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    leases.lease_stream(rows, LEASE).writeStream.format("parquet").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("document_id", "state", "owner_id", F.col("at").alias("changed_at"))
