"""Distinct counts that add up: HyperLogLog sketches by day, language or source, stored once and merged over any range; exact counts
of trailing days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch as a power of two: a standard error of some 0.8 per cent, at most some 8 kB a sketch; up to some hundred
#: distinct values a sketch holds them one by one and is exact.
LG_K = 14


def distinct_sketches(rows: DataFrame, by: list[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """(by, n, sketch): the rows of each group and a sketch of their distinct values. Nulls aren't counted by the sketch. Tasks send a
    sketch a group, whatever its rows, so a group with a third of all rows is no heavier than others."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of each group of `by` as one, as if made of all their rows at once."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def trailing(sketches: DataFrame, by: list[str], day: str, days: int) -> DataFrame:
    """For each day of `by` that has a sketch the union of it and the days - 1 before: each sketch goes to the days it counts for."""
    ahead = sketches.withColumn("_end", F.explode(F.sequence(F.col(day), F.date_add(day, days - 1))))
    merged = merge_sketches(ahead.select(*by, F.col("_end").alias(day), "n", "sketch"), [*by, day])
    return merged.join(sketches.select(*by, day), [*by, day], "left_semi")


def estimate(sketches: DataFrame, name: str = "n_distinct") -> DataFrame:
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


def trailing_exact(rows: DataFrame, day: str, value: str, days: int) -> DataFrame:
    """(day, n, users, trailing) of each day that has rows: its rows, its distinct values and those of it and the days - 1 before, exact.

    A value's days stand in one row, sorted; each counts from there until the next one or the last day that it trails to, so a value
    gives a day one row at most and tasks add them up before they are sent. Null values aren't counted, null days have no trail.
    """
    n = rows.groupBy(day).agg(F.count("*").alias("n"))
    seen = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.array_sort(F.collect_set(day)).alias("_d"), F.max(F.col(day).isNull()).alias("_undated"))
    last = F.transform("_d", lambda d, i: F.least(F.date_add(d, days - 1), F.coalesce(F.date_sub(F.get("_d", i + 1), 1), F.date_add(d, days - 1))))
    spans = F.flatten(F.zip_with("_d", last, lambda d, e: F.transform(F.sequence(d, e), lambda x: F.struct(x.alias("at"), (x == d).alias("own")))))
    undated = F.when(F.col("_undated"), F.array(F.struct(F.lit(None).cast("date").alias("at"), F.lit(True).alias("own")))).otherwise(F.array().cast("array<struct<at:date,own:boolean>>"))
    counted = seen.select(F.explode(F.concat(spans, undated)).alias("x")).groupBy(F.col("x.at").alias("_at")).agg(F.count_if("x.own").alias("users"), F.count("x.at").alias("trailing"))
    return n.join(counted, F.col(day).eqNullSafe(F.col("_at")), "left").select(day, "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("users", "trailing")])
