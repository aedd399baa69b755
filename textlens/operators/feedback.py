"""Votes, trust and the life of suggested words (group H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trust_scores(events: DataFrame, mode: str = "spelling") -> DataFrame:
    """events (event_id, ts, user_id, positive) with trust: +1 for a positive vote, +0.5 for another. Spelling counts the vote
    itself, grammar those before it; trusted from 5 (spelling) or 10 (grammar) on."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0 if mode == "spelling" else -1)
    trust = F.coalesce(F.sum(F.when(F.col("positive"), 1.0).otherwise(0.5)).over(w), F.lit(0.0))
    return events.withColumn("trust", trust).withColumn("trusted", F.col("trust") >= (5 if mode == "spelling" else 10))


def word_votes(events: DataFrame) -> DataFrame:
    """(word, correct, incorrect, users, last_update, trusted_positive): the first vote of each user on a word, weight 2 if the
    user was trusted then."""
    first = Window.partitionBy("word", "user_id").orderBy("ts", "event_id")
    v = trust_scores(events).withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("weight", F.when(F.col("trusted"), 2).otherwise(1))
    weight = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0))
    return v.groupBy("word").agg(weight(F.col("positive")).alias("correct"), weight(~F.col("positive")).alias("incorrect"), F.count("*").alias("users"), F.max("ts").alias("last_update"), F.max(F.col("positive") & F.col("trusted")).alias("trusted_positive"))


def auto_accept(votes: DataFrame, custom: DataFrame) -> DataFrame:
    """(word, decision): accept, or remove for a custom word with more incorrect votes than correct ones."""
    known = custom.select("word", F.lit(True).alias("_c"))
    accept = ((F.col("correct") >= 3) & (F.col("correct") > 2 * F.col("incorrect"))) | F.col("trusted_positive")
    kind = F.when(F.col("_c") & (F.col("incorrect") > F.col("correct")), "remove").when(F.col("_c").isNull() & accept, "accept")
    return votes.join(known, "word", "left").select("word", kind.alias("decision")).where("decision is not null")


def expire_votes(votes: DataFrame, custom: DataFrame, now: str, days: int = 90, least: int = 2) -> DataFrame:
    """What stays: custom words, and words voted on within `days` by at least `least` users."""
    old = (F.col("last_update") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")) | (F.col("users") < least)
    gone = votes.where(old).join(custom.select("word"), "word", "left_anti").select("word")
    return votes.join(gone, "word", "left_anti")


def suggestion_state(events: DataFrame) -> DataFrame:
    """(lang, word, status, votes, voters, last_user, last_ts) from events (event_id, ts, lang, word, user_id, action):
    suggest/vote keep a word pending, approve and reject decide, restore makes it pending again, delete removes it."""
    order = F.struct("ts", "event_id")
    deciding = F.col("action").isin("approve", "reject", "restore", "delete")
    g = events.groupBy("lang", "word").agg(
        F.max_by("action", F.when(deciding, order)).alias("_last"), F.count_if(F.col("action").isin("suggest", "vote")).alias("votes"),
        F.count_distinct(F.when(F.col("action").isin("suggest", "vote"), F.col("user_id"))).alias("voters"), F.max_by("user_id", order).alias("last_user"), F.max("ts").alias("last_ts"), F.max(F.when(deciding, 1)).alias("_d"))
    status = F.when(F.col("_d").isNull(), "pending").when(F.col("_last") == "approve", "approved").when(F.col("_last") == "reject", "rejected").when(F.col("_last") == "restore", "pending")
    return g.withColumn("status", status).where("status is not null").drop("_last", "_d")


def pending_queue(state: DataFrame, k: int = 100) -> DataFrame:
    return state.where("status = 'pending'").orderBy(F.desc("votes"), F.desc("last_ts"), "lang", "word").limit(k)


def suggestion_stats(state: DataFrame) -> DataFrame:
    return state.cube("status", "lang").agg(F.count("*").alias("n"))


def admin_stats(state: DataFrame, events: DataFrame, custom: DataFrame, now: str) -> DataFrame:
    """(lang, custom_words, added_7d, active_users, pending, approved) for each language of the custom words. state: see
    suggestion_state()."""
    recent = F.col("added_at") >= F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    c = custom.groupBy("lang").agg(F.count("*").alias("custom_words"), F.count_if(recent).alias("added_7d"))
    u = events.select("lang", "user_id").union(custom.select("lang", "user_id")).groupBy("lang").agg(F.count_distinct("user_id").alias("active_users"))
    s = state.groupBy("lang").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("pending", "approved")])
    return c.join(u, "lang").join(s, "lang", "left").fillna(0, ["pending", "approved"])


def issue_feedback(events: DataFrame) -> DataFrame:
    """(fingerprint, total, negative, ignored): ignored from 3 votes on, 5 of them negative, over 70 per cent."""
    g = events.groupBy("fingerprint").agg(F.count("*").alias("total"), F.count_if(~F.col("positive")).alias("negative"))
    return g.withColumn("ignored", (F.col("total") >= 3) & (F.col("negative") >= 5) & (F.col("negative") / F.col("total") > 0.7))


def best_modification(events: DataFrame) -> DataFrame:
    """(fingerprint, modification, n): the most frequent replacement proposed at least twice, the earlier one of equals."""
    g = events.where("modification is not null").groupBy("fingerprint", "modification").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("_f")).where("n >= 2")
    w = Window.partitionBy("fingerprint").orderBy(F.desc("n"), "_f")
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("fingerprint", "modification", "n")


def apply_issue_feedback(issues: DataFrame, feedback: DataFrame, modifications: DataFrame) -> DataFrame:
    """issues (with fingerprint, suggestion, confidence) without the ignored ones, proposed replacements put in at 0.95."""
    kept = issues.join(feedback.where("ignored").select("fingerprint"), "fingerprint", "left_anti")
    m = modifications.select("fingerprint", "modification")
    return kept.join(m, "fingerprint", "left").withColumns({"suggestion": F.coalesce("modification", "suggestion"), "confidence": F.when(F.col("modification").isNotNull(), 0.95).otherwise(F.col("confidence"))}).drop("modification")


def upsert_custom_words(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(lang, word, category) by language and lower-cased word: the last change of each wins; remove takes a word out.
    changes: (ts, event_id, lang, word, action, category)."""
    last = changes.groupBy("lang", F.lower("word").alias("_k")).agg(F.max_by(F.struct("word", "action", "category"), F.struct("ts", "event_id")).alias("c"))
    j = current.withColumn("_k", F.lower("word")).join(last, ["lang", "_k"], "full").where(F.col("c").isNull() | (F.col("c.action") != "remove"))
    return j.select("lang", F.coalesce("word", "c.word").alias("word"), F.coalesce("c.category", "category").alias("category"))


def search_words(words: DataFrame, status: str, lang: str, term: str) -> DataFrame:
    return words.where((F.col("status") == status) & (F.col("lang") == lang) & F.lower("word").contains(term.lower()))
