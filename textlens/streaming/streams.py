"""Structured Streaming operators with their batch twins (group J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import readability as rd
from ..plans import tables as tb
from . import stateful as sf

WATERMARK = "10 minutes"


def stream_readability(requests: DataFrame) -> DataFrame:
    """Requests (id, doc_id, text, error null) with lix, rix and bands; stateless."""
    spark = requests.sparkSession
    x = rd.rix(rd.lix(rd.text_statistics(requests, simple=True)))
    bands = tb.BANDS.df(spark)
    return rd.classify(rd.classify(x, bands, "lix", "lix"), bands, "rix", "rix")


def _us(seconds: float) -> int:
    return int(seconds * 1_000_000)


def last_of_burst(events: DataFrame, gap: str) -> DataFrame:
    """The last event of each burst of a user: nothing follows within the gap. For events without a text."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.lead("ts").over(w)
    return events.withColumn("_n", n).where(F.col("_n").isNull() | (F.col("_n") - F.col("ts") >= F.expr(f"INTERVAL {gap}"))).drop("_n")


def debounce_batch(requests: DataFrame, gap_s: float, forget_s: float = 86_400, client: str = "user_id", time: str = "ts", number: str = "event_id", text: str = "text") -> DataFrame:
    """(client, number, reason): the requests that pass, see Debounce; what still waits at the end passes."""
    return sf.run_batch(requests, sf.Debounce(_us(gap_s), _us(forget_s)), client, time, number, [text]).withColumnRenamed("number", number)


def debounce(requests: DataFrame, gap_s: float, forget_s: float = 86_400, client: str = "user_id", time: str = "ts", number: str = "event_id", text: str = "text", **more) -> DataFrame:
    """Stream form; more: watermark, ordered, or event_time=False for a timer of the processor's clock."""
    return sf.run_stream(requests, sf.Debounce(_us(gap_s), _us(forget_s)), client, time, number, [text], **more).withColumnRenamed("number", number)


def correlate_batch(requests: DataFrame, responses: DataFrame, timeout_s: int, late_s: int) -> DataFrame:
    """(event_id, response_id, answers, late_answers, partial, late): answers of the same user within the timeout of a request, then
    those up to `late_s`; response_id is the earliest of both, null for none. partial: none came in time; late: one came after.

    Users are cut into spans of late_s; a response also stands in the span before, so that each request finds its answers in its
    own. In a span, running counts of responses at a request, its deadline and its end give the answers: no request meets a
    response, and a user with a third of all events is as many groups as spans.
    """
    at, span = F.unix_micros(F.col("ts").cast("timestamp")), F.lit(late_s * 1_000_000)
    a = requests.select("user_id", at.alias("t"), "event_id", F.floor(at / span).cast("long").alias("span"))
    b = responses.select("user_id", at.alias("t"), "event_id", F.explode(F.array(F.floor(at / span).cast("long"), F.floor(at / span).cast("long") - 1)).alias("span"))
    mark = lambda kind, by: a.select("user_id", "span", (F.col("t") + by).alias("t"), F.lit(kind).alias("kind"), "event_id")
    both = mark(0, 0).union(b.select("user_id", "span", "t", F.lit(1), "event_id")).union(mark(2, timeout_s * 1_000_000)).union(mark(3, late_s * 1_000_000))
    w = Window.partitionBy("user_id", "span")
    seen = F.count(F.when(F.col("kind") == 1, 1)).over(w.orderBy("t", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    # from behind: the response nearest to what comes before it, and its time
    first = F.last(F.when(F.col("kind") == 1, F.struct("t", "event_id")), ignorenulls=True).over(w.orderBy(F.desc("t"), F.desc("kind"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0))
    marks = both.select("*", seen.alias("seen"), first.alias("first")).where("kind <> 1")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    g = marks.groupBy("user_id", "event_id").agg(of(0, "seen").alias("s0"), of(2, "seen").alias("s2"), of(3, "seen").alias("s3"), of(0, "first").alias("first"), of(0, "t").alias("t"))
    answers, late = F.col("s2") - F.col("s0"), F.col("s3") - F.col("s2")
    return g.select("event_id", F.when(F.col("first.t") <= F.col("t") + span, F.col("first.event_id")).alias("response_id"), answers.alias("answers"), late.alias("late_answers"), (answers == 0).alias("partial"), ((answers == 0) & (late > 0)).alias("late"))


def correlate(requests: DataFrame, responses: DataFrame, timeout_s: int, late_s: int, watermark: str = WATERMARK) -> DataFrame:
    """Stream form, rows (event_id, user_id, ts, response_id, partial, late): each answer in time, or one partial row when the time of
    a request without is over, by a watermarked left outer interval join; and by a second, wider one each late answer, which
    updates the partial row."""
    a = requests.withWatermark("ts", watermark)
    b = responses.select(F.col("user_id").alias("_u"), F.col("ts").alias("response_ts"), F.col("event_id").alias("response_id")).withWatermark("response_ts", watermark)
    end = lambda s: F.col("ts") + F.expr(f"INTERVAL {s} SECONDS")
    mine = F.col("user_id") == F.col("_u")
    timely = a.join(b, mine & (F.col("response_ts") >= F.col("ts")) & (F.col("response_ts") <= end(timeout_s)), "left")
    after = a.join(b, mine & (F.col("response_ts") > end(timeout_s)) & (F.col("response_ts") <= end(late_s)))
    row = lambda j, partial, late: j.select("event_id", "user_id", "ts", "response_id", partial.alias("partial"), F.lit(late).alias("late"))
    return row(timely, F.col("response_id").isNull(), False).union(row(after, F.lit(False), True))


def rate_limit_batch(events: DataFrame, window_s: float, most: int, key: str = "user_id", time: str = "ts", number: str = "event_id") -> DataFrame:
    """(key, number, excess, retry_after), see RateLimit."""
    return sf.run_batch(events, sf.RateLimit(_us(window_s), most), key, time, number, []).withColumnRenamed("number", number)


def rate_limit(events: DataFrame, window_s: float, most: int, key: str = "user_id", time: str = "ts", number: str = "event_id", **more) -> DataFrame:
    return sf.run_stream(events, sf.RateLimit(_us(window_s), most), key, time, number, [], **more).withColumnRenamed("number", number)


def user_state_batch(events: DataFrame, now: str, ttl: str) -> DataFrame:
    """Users whose last event isn't a removal and no older than the time to live."""
    g = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.max("ts").alias("ts"))
    return g.where((F.col("last_event") != "error") & (F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {ttl}")))


def user_state(events: DataFrame, ttl_s: float, **more) -> DataFrame:
    """Stream form: updates (user_id, at, event), see UserState; a null event takes the user away. The last update of each user, if it
    has an event, is user_state_batch() as of the watermark."""
    return sf.run_stream(events, sf.UserState(_us(ttl_s)), "user_id", "ts", "event_id", ["event_type"], **more)


def stream_status_changes(status: DataFrame, ttl_s: float = 30 * 86_400, **more) -> DataFrame:
    """Stream form of status_changes(): (domain, event_id, changed, became_available), see StatusChanges."""
    return sf.run_stream(status, sf.StatusChanges(_us(ttl_s)), "domain", "ts", "event_id", ["is_up", "registered"], **more)


def service_metrics(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", share: float = 0.05, watermark: str | None = WATERMARK) -> DataFrame:
    """(start, requests, mean_value, errors) of the sliding windows whose share of errors is over the limit."""
    e = events.withWatermark("ts", watermark) if watermark else events
    g = e.groupBy(F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("requests"), F.avg("value").alias("mean_value"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.where(F.col("errors") / F.col("requests") > share).select(F.col("w.start").alias("start"), "requests", "mean_value", "errors")


def dedupe_texts_batch(docs: DataFrame, reuse: bool = False) -> DataFrame:
    """(key, doc_id, n, reuse_s): texts answered once, and for how long by their length. With reuse=True and a time `ts`:
    (key, doc_id, answered_by), the document whose answer serves each one, as in the stream."""
    if reuse:
        keyed = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), "ts", "doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"))
        return sf.run_batch(keyed, sf.Reuse(), "key", "ts", "doc_id", ["chars"]).withColumnRenamed("number", "doc_id")
    seconds = F.when(F.max(F.char_length("text")) < 1000, 7200).when(F.max(F.char_length("text")) <= 10000, 3600).otherwise(1800)
    return docs.groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), seconds.alias("reuse_s"))


def dedupe_texts(requests: DataFrame, time: str = "ts", number: str = "event_id", **more) -> DataFrame:
    """Stream form: (key, number, answered_by): the request whose answer serves each one, for as long as its text's length allows."""
    keyed = requests.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), time, number, F.char_length(F.coalesce("text", F.lit(""))).alias("chars"))
    return sf.run_stream(keyed, sf.Reuse(), "key", time, number, ["chars"], **more).withColumnRenamed("number", number)


def liveness(pings: DataFrame, gap: str = "30 seconds", watermark: str | None = WATERMARK) -> DataFrame:
    p = pings.withWatermark("ts", watermark) if watermark else pings
    return p.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("pings")).select("user_id", F.col("w.start").alias("start"), "pings")


def online_word_counts(docs: DataFrame) -> DataFrame:
    """Running counts of words; output mode update or complete."""
    from ..operators.text import tokenize

    return tokenize(docs).groupBy(F.col("lower").alias("word")).agg(F.count("*").alias("n"))
