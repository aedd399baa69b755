"""Size checks of tables that every task is to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows above which a rule or lexicon table is refused as the broadcast side of a join.
MAX_THETA_ROWS = 10_000


def checked_small(df: DataFrame, limit: int = MAX_THETA_ROWS) -> DataFrame:
    """df, after a check that it has at most `limit` rows; for the side of a theta join that every task holds."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"a rule table has over {limit} rows; a theta join would not scale")
    return df
