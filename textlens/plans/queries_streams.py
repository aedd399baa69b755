"""Queries of group J that hold state, as batch twins and as streams over the given tables, and the results' sink (A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..streaming import streams as st
from .queries_text import BANDED, WORDS
from .registry import query, table


def events(s, d):
    return table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream(s, d, name: str) -> DataFrame:
    """The given table, a file or a folder of files, as a stream; a pattern for the path, as a stream's base must not be a file."""
    return s.readStream.schema(s.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]")


def run(df: DataFrame, what: str) -> DataFrame:
    """All that a stream appends until its input is used up."""
    path = files.scratch(df.sparkSession, what)
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- J2: conversations as texts that grow while they are typed: eight prefixes of each turn, 1 to 7 seconds apart

TYPED = """ty AS (SELECT conv_id, turn * 10 + k AS number, turn * 1000 + k * (1 + n % 7) AS sec, regexp_replace(substr(text, 1, (n * k // 8)::INT), '^\\s+|\\s+$', '', 'g') AS t
 FROM (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL), (SELECT unnest(range(1, 9)) AS k))"""


def typed(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.char_length("text").cast("long"))
    c = c.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    at = F.col("turn") * 1000 + F.col("k") * (1 + F.col("n") % 7)
    return c.select("conv_id", F.timestamp_seconds(F.lit(1_704_067_200) + at).alias("ts"), (F.col("turn") * 10 + F.col("k")).alias("number"), F.substring(F.col("text"), F.lit(1), F.expr("cast(n * k div 8 as int)")).alias("text"))


@query("j2_debounce_texts", f"""WITH RECURSIVE {TYPED}, q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sec, number) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM ty),
m AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, NULL::VARCHAR AS last, NULL::VARCHAR AS waiting, NULL::BIGINT AS wnum, NULL::BIGINT AS at0, NULL::BIGINT AS ended, NULL::BIGINT AS passed FROM q
  UNION ALL
  SELECT conv_id, i, CASE WHEN passes THEN t ELSE l END, CASE WHEN passes OR skips THEN NULL ELSE t END, CASE WHEN passes OR skips THEN NULL ELSE number END, sec, ended, CASE WHEN passes THEN number END
  FROM (SELECT *, NOT skips AND abs(length(t) - length(coalesce(l, ''))) > 0.15::DOUBLE * greatest(1, length(coalesce(l, ''))) AS passes
    FROM (SELECT q.conv_id, q.i, q.sec, q.t, q.number, CASE WHEN wnum IS NOT NULL AND at0 + 4 <= q.sec THEN wnum END AS ended,
        CASE WHEN at0 + 500 <= q.sec THEN NULL WHEN wnum IS NOT NULL AND at0 + 4 <= q.sec THEN waiting ELSE last END AS l, length(q.t) < 3 OR coalesce(q.t = CASE WHEN at0 + 500 <= q.sec THEN NULL WHEN wnum IS NOT NULL AND at0 + 4 <= q.sec THEN waiting ELSE last END, false) AS skips
      FROM m JOIN q ON m.conv_id = q.conv_id AND q.i = m.i + 1)))
SELECT conv_id, ended AS number, 'burst_end' AS reason FROM m WHERE ended IS NOT NULL UNION ALL SELECT conv_id, passed, 'length' FROM m WHERE passed IS NOT NULL
UNION ALL SELECT m.conv_id, wnum, 'burst_end' FROM m JOIN (SELECT conv_id, max(n) AS n FROM q GROUP BY 1) x ON m.conv_id = x.conv_id AND m.i = x.n WHERE wnum IS NOT NULL""")
def _(s, d):
    return st.debounce_batch(typed(s, d), 4, 500, "conv_id", "ts", "number")


# --- J3

@query("j3_correlate", """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT user_id, ts, event_id AS rid FROM events WHERE event_type = 'view'),
j AS (SELECT a.event_id, a.ts, rid, b.ts AS t, rid IS NOT NULL AND b.ts <= a.ts + INTERVAL 2 HOURS AS timely FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOURS),
g AS (SELECT event_id, arg_min(rid, (t, rid)) FILTER (rid IS NOT NULL) AS response_id, count_if(timely) AS answers, count(rid) - count_if(timely) AS late_answers FROM j GROUP BY 1)
SELECT *, answers = 0 AS partial, answers = 0 AND late_answers > 0 AS late FROM g""")
def _(s, d):
    e = events(s, d)
    return st.correlate_batch(e.where("event_type = 'click'"), e.where("event_type = 'view'"), 7200, 43_200)


# --- J4: windows of a user that begin with the first request after the last one

ANCHORED = """q AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
m AS (
  SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS t, NULL::BIGINT AS reset, 0 AS n, false AS excess FROM (SELECT DISTINCT user_id FROM q)
  UNION ALL
  SELECT user_id, i, event_id, t, r, CASE WHEN c >= 2 THEN c ELSE c + 1 END, c >= 2
  FROM (SELECT q.user_id, q.i, q.event_id, q.t, CASE WHEN reset IS NULL OR q.t > reset THEN q.t + 86400000000 ELSE reset END AS r, CASE WHEN reset IS NULL OR q.t > reset THEN 0 ELSE n END AS c FROM m JOIN q ON q.user_id = m.user_id AND q.i = m.i + 1))"""


@query("j4_rate_limit", f"WITH RECURSIVE {ANCHORED} SELECT user_id, event_id, excess, CASE WHEN excess THEN ceil((reset - t) / 1000000.0::DOUBLE)::BIGINT ELSE 0 END AS retry_after FROM m WHERE i > 0")
def _(s, d):
    return st.rate_limit_batch(events(s, d), 86_400, 2)


@query("j4_rate_limit_stream", f"WITH RECURSIVE {ANCHORED} SELECT user_id, event_id, excess, CASE WHEN excess THEN ceil((reset - t) / 1000000.0::DOUBLE)::BIGINT ELSE 0 END AS retry_after FROM m WHERE i > 0")
def _(s, d):
    return run(st.rate_limit(stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), 86_400, 2, watermark="0 seconds", ordered=True), "rates")


# --- J5, J6: streams over all events; the watermark ends at the last one

@query("j5_user_state_stream", "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event, max(ts) AS t FROM events WHERE user_id IS NOT NULL GROUP BY 1) SELECT user_id, last_event FROM l WHERE last_event <> 'error' AND t + INTERVAL 6 HOURS >= (SELECT max(ts) FROM events)")
def _(s, d):
    updates = run(st.user_state(stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), 6 * 3600, watermark="0 seconds", ordered=True), "users")
    # a removal at the same time as its user's last event comes after it
    last = updates.groupBy("user_id").agg(F.max_by("event", F.struct("at", F.col("event").isNull())).alias("last_event"))
    return last.where("last_event is not null")


@query("j6_status_stream", """WITH o AS (SELECT 'u' || user_id AS domain, event_id, event_type <> 'error' AS up, event_type <> 'purchase' AS reg, ts FROM events WHERE user_id IS NOT NULL),
l AS (SELECT *, lag(up) OVER w AS pu, lag(reg) OVER w AS pr FROM o WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id))
SELECT domain, event_id, coalesce(up <> pu OR reg <> pr, false) AS changed, coalesce(pr AND NOT reg, false) AS became_available FROM l""")
def _(s, d):
    e = stream(s, d, "events").where("user_id is not null")
    status = e.select(F.concat(F.lit("u"), "user_id").alias("domain"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") != "error").alias("is_up"), (F.col("event_type") != "purchase").alias("registered"))
    return run(st.stream_status_changes(status, watermark="0 seconds", ordered=True), "status")


# --- J8: the request that answers each document's text, documents a minute apart

@query("j8_reuse", """WITH RECURSIVE q AS MATERIALIZED (SELECT md5(coalesce(text, '')) AS key, doc_id, doc_id * 60 AS t, CASE WHEN length(coalesce(text, '')) < 1000 THEN 7200 WHEN length(coalesce(text, '')) <= 10000 THEN 3600 ELSE 1800 END AS r, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS i FROM documents),
m AS (SELECT key, i, doc_id, doc_id AS by_, t + r AS until FROM q WHERE i = 1
  UNION ALL SELECT q.key, q.i, q.doc_id, CASE WHEN q.t < m.until THEN by_ ELSE q.doc_id END, CASE WHEN q.t < m.until THEN m.until ELSE q.t + q.r END FROM m JOIN q ON q.key = m.key AND q.i = m.i + 1)
SELECT key, doc_id, by_ AS answered_by FROM m""")
def _(s, d):
    return st.dedupe_texts_batch(table(s, d, "documents").select("doc_id", "text", F.timestamp_seconds(F.col("doc_id") * 60).alias("ts")), reuse=True)


# --- J1, J10 and A12 as streams into tables

@query("j1_stream_readability", f"WITH {BANDED} SELECT doc_id, lix, rix, lix_band, rix_band FROM bd")
def _(s, d):
    return run(st.stream_readability(stream(s, d, "documents").select("doc_id", "text")).select("doc_id", "lix", "rix", "lix_band", "rix_band"), "readability")


@query("j10_online_words", f"SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM documents) GROUP BY 1")
def _(s, d):
    path = files.scratch(s, "words")
    files.write_results(st.online_word_counts(stream(s, d, "documents").select("doc_id", "text")), path, path + "-log", ("word",), "n", "update").awaitTermination()
    return files.read_results(s, path, ("word",), "n").select("word", "n")


# three batches by event, one of them replayed with other values, which changes nothing; then merged into a base
@query("a12_results", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(s, d):
    path, keys = files.scratch(s, "results"), ("user_id", "event_type")
    e = table(s, d, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    third = lambda k: e.where(F.pmod("at.event_id", F.lit(3)) == k)
    for k in (0, 1, 2):
        files.merge_batch(third(k), k, path, keys, "at")
    files.merge_batch(third(2).withColumn("value", F.lit(-1.0)), 2, path, keys, "at")
    files.compact_results(s, path, keys, "at")
    return files.read_results(s, path, keys, "at").select("user_id", "event_type", "value", "at.*")
