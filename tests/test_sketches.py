"""Sketches against exact distinct counts, and their unions against the whole."""

from pyspark.sql import functions as F

from textlens.operators import sketches, text

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_within_two_per_cent(spark, tmp_path):
    t = text.tokenize(spark.read.parquet(DOCS)).join(spark.read.parquet(DOCS).select("doc_id", "lang", "source"), "doc_id")
    parts = sketches.distinct_sketches(t, ["lang", "source"], "lower")
    parts.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    exact = {r.lang: (r.n, r.d) for r in t.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("lower").alias("d")).collect()}
    got = {r.lang: (r.n, r.n_distinct) for r in sketches.estimate(sketches.merge_sketches(stored, ["lang"])).collect()}
    assert got.keys() == exact.keys()
    for lang, (n, d) in exact.items():
        assert got[lang][0] == n and abs(got[lang][1] - d) <= 0.02 * d
    # a union of the parts is the sketch of the whole: joined to it, the whole adds nothing
    whole = sketches.distinct_sketches(t, ["lang"], "lower").select("lang", F.lit(0).alias("n"), "sketch")
    both = sketches.merge_sketches(stored.select("lang", "n", "sketch").union(whole), ["lang"])
    assert {r.lang: (r.n, r.n_distinct) for r in sketches.estimate(both).collect()} == got


def test_trailing_days(spark):
    rows = [("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 2), ("2024-01-03", None), ("2024-01-05", 3), ("2024-01-09", 4)]
    day = spark.createDataFrame(rows, "day string, user_id long").withColumn("day", F.to_date("day"))
    s = sketches.distinct_sketches(day, ["day"], "user_id")
    got = {str(r.day): (r.n, r.n_distinct) for r in sketches.estimate(sketches.trailing(s, [], "day", 3)).collect()}
    assert got == {"2024-01-01": (2, 2), "2024-01-02": (3, 2), "2024-01-03": (4, 2), "2024-01-05": (2, 1), "2024-01-09": (1, 1)}
    assert sketches.estimate(sketches.merge_sketches(s.limit(0), ["day"])).collect() == []


def test_trailing_days_of_many_users_are_exact(spark):
    """Far more users than a sketch counts one by one; days without rows between, a null user, a null day."""
    rows = [("2024-01-01", u) for u in range(30_000)] + [("2024-01-02", u) for u in range(20_000, 45_001)] + [("2024-01-05", 7), ("2024-01-05", 7), ("2024-01-20", None), (None, 3)]
    day = spark.createDataFrame(rows, "day string, user_id long").withColumn("day", F.to_date("day"))
    got = {str(r.day): (r.n, r.users, r.trailing) for r in sketches.trailing_exact(day, "day", "user_id", 4).collect()}
    assert got == {"2024-01-01": (30_000, 30_000, 30_000), "2024-01-02": (25_001, 25_001, 45_001), "2024-01-05": (2, 1, 25_002), "2024-01-20": (1, 0, 0), "None": (1, 1, 0)}
