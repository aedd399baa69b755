"""Domain observations: status, changes, history, cycles, notifications (group I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def site_status(obs: DataFrame) -> DataFrame:
    """obs (status_code, error_code) with is_up (a code below 500) and the kind of failure."""
    kind = F.when(F.col("error_code").isin("ENOTFOUND", "EAI_AGAIN"), "dns").when(F.col("error_code").isin("ETIMEDOUT", "ECONNABORTED"), "timeout").when(F.col("error_code") == "ECONNREFUSED", "refused").when(F.col("error_code").isNotNull(), "other")
    return obs.withColumns({"is_up": F.coalesce(F.col("status_code") < 500, F.lit(False)), "failure": kind})


def registration(payloads: DataFrame) -> DataFrame:
    """(domain, is_registered, registrar, expires) from WHOIS answers of four shapes in `json`; an error counts as registered."""
    g = lambda *paths: F.coalesce(*[F.get_json_object("json", p) for p in paths])
    registrar = g("$.WhoisRecord.registrarName", "$.registrar.name", "$.registrar", "$.result.registrar")
    expires = g("$.WhoisRecord.expiresDate", "$.expiration_date", "$.dates.expiry", "$.result.expires")
    found = F.coalesce(g("$.registered", "$.result.registered").cast("boolean"), registrar.isNotNull() | expires.isNotNull())
    return payloads.select("domain", F.when(F.col("error").isNotNull() | F.col("json").isNull(), True).otherwise(found).alias("is_registered"), registrar.alias("registrar"), F.to_date(F.substring(expires, 1, 10)).alias("expires"))


def domain_status(obs: DataFrame) -> DataFrame:
    """obs (is_up, is_registered) with registered: WHOIS counts only when the site is down, unknown as registered."""
    reg = F.when(F.col("is_up"), True).otherwise(F.coalesce("is_registered", F.lit(True)))
    return obs.withColumns({"registered": reg, "description": F.when(F.col("is_up"), "active").when(reg, "registered, site down").otherwise("available")})


def status_changes(status: DataFrame) -> DataFrame:
    """status (domain, ts, event_id, is_up, registered) with changed and became_available against the check before; both false
    for a domain's first check."""
    w = Window.partitionBy("domain").orderBy("ts", "event_id")
    up, reg = F.lag("is_up").over(w), F.lag("registered").over(w)
    return status.withColumns({"changed": F.coalesce((up != F.col("is_up")) | (reg != F.col("registered")), F.lit(False)), "became_available": F.coalesce(reg & ~F.col("registered"), F.lit(False))})


def status_history(status: DataFrame, k: int = 100) -> DataFrame:
    w = Window.partitionBy("domain").orderBy(F.desc("ts"), F.desc("event_id"))
    return status.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def current_status(status: DataFrame) -> DataFrame:
    """The latest check of each domain."""
    s = F.struct("ts", "event_id", "is_up", "registered")
    return status.groupBy("domain").agg(F.max(s).alias("s"), F.count("*").alias("checks")).select("domain", "s.*", "checks")


def upsert_registry(registry: DataFrame, current: DataFrame) -> DataFrame:
    """The registry with the current status; unknown domains come in as active."""
    c = current.select(F.col("domain").alias("_d"), "ts", "is_up", "registered")
    return registry.join(c, F.lower("name") == F.col("_d"), "full").select(F.coalesce("name", "_d").alias("name"), F.coalesce("is_active", F.lit(True)).alias("is_active"), "ts", "is_up", "registered")


def active_domains(registry: DataFrame) -> DataFrame:
    return registry.where("is_active").select(F.lower("name").alias("name"))


def add_domains(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry and the new names that it lacks, whatever their case."""
    fresh = new.select(F.lower("name").alias("name")).distinct().join(registry.select(F.lower("name").alias("name")), "name", "left_anti")
    return registry.select("name", "is_active").union(fresh.select("name", F.lit(True)))


def monitoring_cycles(status: DataFrame, every: str = "1 hour") -> DataFrame:
    """Per tumbling window: checks, distinct domains, available ones and their names, failures."""
    free = ~F.col("registered")
    g = status.groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("checked"), F.count_distinct("domain").alias("domains"), F.array_join(F.array_sort(F.collect_set(F.when(free, F.col("domain")))), ",").alias("available"), F.count_if(~F.col("is_up")).alias("failures"))
    return g.select(F.col("w.start").alias("start"), "checked", "domains", "available", "failures")


def purchase_links(domains: DataFrame, registrars: DataFrame) -> DataFrame:
    """(domain, link): the preferred registrar's template, the one named Default when it is unknown. registrars: a small table."""
    from ..functions.checks import checked_small

    r = F.broadcast(checked_small(registrars))
    default = r.where("registrar = 'Default'").select(F.col("template").alias("_default"))
    j = domains.join(r, F.col("preferred_registrar") == F.col("registrar"), "left").crossJoin(F.broadcast(default))
    return j.select("domain", F.replace(F.coalesce("template", "_default"), F.lit("{d}"), F.col("domain")).alias("link"))


def notifications(changes: DataFrame) -> DataFrame:
    """(domain, ts, event_id, subject, preview) for every domain that became available; previews of 100 characters."""
    body = F.format_string("The domain %s became available at %s. Buy it before someone else does, for example from your preferred registrar.", F.col("domain"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return changes.where("became_available").select("domain", "ts", "event_id", F.concat(F.lit("Domain available: "), F.col("domain")).alias("subject"), F.substring(body, 1, 100).alias("preview"))


def recent_notifications(log: DataFrame, k: int = 20) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def domain_counts(current: DataFrame) -> DataFrame:
    return current.agg(F.count("*").alias("total"), F.count_if("is_up").alias("active"), F.count_if("registered").alias("registered"), F.count_if(~F.col("registered")).alias("available"))
