"""Extension points: checkers, models, metrics, templates, registrars (group K)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.readability import classify


class CheckerRegistry:
    """Named functions from documents (or tokens) to issues. A checker that can't be planned is left out and kept in `failed`; if
    none is left there are no issues."""

    def __init__(self):
        self.checkers: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.failed: dict[str, str] = {}

    def register(self, name: str, checker: Callable[[DataFrame], DataFrame]) -> None:
        if not callable(checker):
            raise TypeError(f"checker {name} is not callable")
        self.checkers[name] = checker

    def run(self, source: DataFrame) -> DataFrame:
        found = []
        for name, checker in self.checkers.items():
            try:
                out = checker(source)
                out.schema  # noqa: B018  planning finds unknown columns
                found.append(out)
            except Exception as e:
                self.failed[name] = str(e).splitlines()[0]
        if not found:
            return source.sparkSession.createDataFrame([], "doc_id long, type string, issue string")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def score_with_model(docs: DataFrame, predict: Callable[[list[str]], list[float]], text: str = "text") -> DataFrame:
    """docs with model_score: `predict` gets batches of texts (null as empty) in Arrow batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(predict(batch.fillna("").tolist()), dtype="float64")

    return docs.withColumn("model_score", score(F.col(text))).drop(text)


def register_metric(stats: DataFrame, name: str, value: Column, bands: DataFrame) -> DataFrame:
    return classify(stats.withColumn(name, value), bands, name, name)


def render_template(df: DataFrame, template: str, out: str = "message") -> DataFrame:
    """df with a message in which `{column}` stands for the column's value."""
    message = F.lit(template)
    for c in df.columns:
        if f"{{{c}}}" in template:
            message = F.replace(message, F.lit(f"{{{c}}}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return df.withColumn(out, message)


def register_registrar(registrars: DataFrame, name: str, template: str) -> DataFrame:
    new = registrars.sparkSession.createDataFrame([(name, template)], "registrar string, template string")
    return registrars.where(F.col("registrar") != name).union(new)
